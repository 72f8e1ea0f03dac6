"""Registered geometry and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.functions import geo
from fleetgrain.operators import matching, shapes, timetable
from fleetgrain.sources import tables

R = Registry()
c = F.col


def _pair(v):
    """Each ping with the position of the order of the same number."""
    return v.pings.select(
        "event_id", c("latitude").alias("la1"), c("longitude").alias("lo1"),
        (c("latitude") + (c("k") - 50) * 0.001).alias("la2"), (c("longitude") + (c("event_id") % 41 - 20) * 0.001).alias("lo2"))


PAIR_SQL = "p AS (SELECT event_id, latitude AS la1, longitude AS lo1, latitude + (k - 50) * CAST(0.001 AS DOUBLE) AS la2, longitude + (event_id % 41 - 20) * CAST(0.001 AS DOUBLE) AS lo2 FROM pings)"


def hav(la1: str, lo1: str, la2: str, lo2: str) -> str:
    return f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * pow(sin(radians({lo2} - {lo1}) / 2), 2))))"


def ends():
    return (c("la1"), c("lo1"), c("la2"), c("lo2"))



R.add(
    "G01_haversine_m", "event_id:i, metres:f", lambda v: _pair(v).select("event_id", geo.haversine_m(*ends()).alias("metres")),
    f"WITH {PAIR_SQL} SELECT event_id, {hav('la1', 'lo1', 'la2', 'lo2')} AS metres FROM p", "pings",
)
BEARING = "degrees(atan2(sin(radians(lo2 - lo1)) * cos(radians(la2)), cos(radians(la1)) * sin(radians(la2)) - sin(radians(la1)) * cos(radians(la2)) * cos(radians(lo2 - lo1))))"
R.add(
    "G02_bearing_deg", "event_id:i, bearing:f", lambda v: _pair(v).select("event_id", geo.bearing_deg(*ends()).alias("bearing")),
    f"WITH {PAIR_SQL} SELECT event_id, CASE WHEN b < 0 THEN b + 360 ELSE b END AS bearing FROM (SELECT event_id, {BEARING} AS b FROM p) x", "pings",
)
R.add(
    "G03_angular_difference", "event_id:i, difference:f",
    lambda v: v.pings.select("event_id", geo.angular_difference((c("event_id") * 37 % 360).cast("double"), (c("k") * 13 % 360).cast("double")).alias("difference")),
    "SELECT event_id, least(abs(a - b), 360 - abs(a - b)) AS difference FROM (SELECT event_id, event_id * 37 % 360 AS a, k * 13 % 360 AS b FROM pings) x", "pings",
)
AZIMUTH = "degrees(atan2(lo2 - lo1, la2 - la1))"
R.add(
    "G04_planar_azimuth", "event_id:i, azimuth:f", lambda v: _pair(v).select("event_id", geo.planar_azimuth(*ends()).alias("azimuth")),
    f"WITH {PAIR_SQL} SELECT event_id, CASE WHEN a < 0 THEN a + 360 ELSE a END AS azimuth FROM (SELECT event_id, {AZIMUTH} AS a FROM p) x", "pings",
)
R.add(
    "G05_assemble_lines", "shape_id:s, point_count:i, first_lat:f, last_lon:f",
    lambda v: shapes.assemble_lines(v.shape_points).select("shape_id", "point_count", F.element_at("points", 1)["lat"].alias("first_lat"), F.element_at("points", -1)["lon"].alias("last_lon")),
    "SELECT shape_id, count(*) AS point_count, arg_min(latitude, sequence) AS first_lat, arg_max(longitude, sequence) AS last_lon FROM shape_points GROUP BY 1 HAVING count(*) >= 2", "shape_points",
)
SEG_SQL = f"""pp AS (SELECT shape_id, sequence AS segment_sequence, latitude AS la1, longitude AS lo1, lead(latitude) OVER w AS la2, lead(longitude) OVER w AS lo2 FROM shape_points WINDOW w AS (PARTITION BY shape_id ORDER BY sequence)),
mm AS (SELECT *, {hav('la1', 'lo1', 'la2', 'lo2')} AS len, sqrt((lo2 - lo1) * (lo2 - lo1) + (la2 - la1) * (la2 - la1)) AS plen, {AZIMUTH} AS az FROM pp WHERE la2 IS NOT NULL AND NOT (la1 = la2 AND lo1 = lo2)),
qq AS (SELECT *, coalesce(sum(len) OVER b, 0) AS start_m, sum(len) OVER a AS total_m, coalesce(sum(plen) OVER b, 0) AS pstart, sum(plen) OVER a AS ptotal FROM mm
 WINDOW b AS (PARTITION BY shape_id ORDER BY segment_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY shape_id)),
seg AS (SELECT shape_id, segment_sequence, la1, lo1, la2, lo2, len, start_m, start_m + len AS end_m, start_m / total_m AS f0, (start_m + len) / total_m AS f1, CASE WHEN az < 0 THEN az + 360 ELSE az END AS bearing, pstart / ptotal AS pf0, (pstart + plen) / ptotal AS pf1, total_m FROM qq WHERE total_m > 0)"""
R.add(
    "G06_shape_segments", "shape_id:s, segment_sequence:i, segment_length_m:f, start_distance_m:f, end_distance_m:f, start_fraction:f, end_fraction:f, bearing_degrees:f",
    lambda v: shapes.shape_segments(v.shape_points),
    f"WITH {SEG_SQL} SELECT shape_id, segment_sequence, len AS segment_length_m, start_m AS start_distance_m, end_m AS end_distance_m, f0 AS start_fraction, f1 AS end_fraction, bearing AS bearing_degrees FROM seg", "shape_points",
)


def projection_sql(points: str) -> str:
    """All pairs of a point and a segment of its shape, for the small oracle side."""
    return f"""{SEG_SQL}, pr0 AS (SELECT p.ping_id, p.latitude AS la, p.longitude AS lo, s.*, greatest(0.0, least(1.0, ((p.longitude - lo1) * (lo2 - lo1) + (p.latitude - la1) * (la2 - la1)) / ((lo2 - lo1) * (lo2 - lo1) + (la2 - la1) * (la2 - la1)))) AS t FROM {points} p JOIN seg s USING (shape_id)),
pr1 AS (SELECT *, la1 + t * (la2 - la1) AS nla, lo1 + t * (lo2 - lo1) AS nlo FROM pr0),
pr AS (SELECT *, {hav('la', 'lo', 'nla', 'nlo')} AS dist, sqrt((nlo - lo) * (nlo - lo) + (nla - la) * (nla - la)) AS planar, start_m + t * len AS progress_m, f0 + t * (f1 - f0) AS shape_position, pf0 + t * (pf1 - pf0) AS planar_position FROM pr1)"""


def segments(v):
    return shapes.shape_segments(v.shape_points)


R.add(
    "G07_project_on_segment", "event_id:i, fraction:f, metres:f, progress_m:f",
    lambda v: _pair(v).select(
        "event_id", c("la1").alias("latitude"), c("lo1").alias("longitude"), c("la2").alias("start_lat"), c("lo2").alias("start_lon"), (c("la2") + 0.01).alias("end_lat"), (c("lo2") - 0.005).alias("end_lon"),
        F.lit(0).alias("segment_sequence"), F.lit(10.0).alias("start_distance_m"), F.lit(200.0).alias("segment_length_m"), F.lit(0.1).alias("start_fraction"), F.lit(0.2).alias("end_fraction"), F.lit(1.0).alias("bearing_degrees"))
    .withColumn("p", geo.project_on_segment(c("latitude"), c("longitude"))).select("event_id", c("p.segment_fraction").alias("fraction"), c("p.distance_to_shape_m").alias("metres"), "p.progress_m"),
    f"""WITH {PAIR_SQL}, q AS (SELECT *, greatest(0.0, least(1.0, ((lo1 - lo2) * CAST(-0.005 AS DOUBLE) + (la1 - la2) * CAST(0.01 AS DOUBLE)) / CAST(0.000125 AS DOUBLE))) AS t FROM p),
r AS (SELECT *, la2 + t * CAST(0.01 AS DOUBLE) AS nla, lo2 - t * CAST(0.005 AS DOUBLE) AS nlo FROM q)
SELECT event_id, t AS fraction, {hav('la1', 'lo1', 'nla', 'nlo')} AS metres, 10 + t * 200 AS progress_m FROM r""",
    "pings",
)
R.add(
    "G08_project_on_shape", "ping_id:i, shape_position:f, shape_progress_m:f, distance_to_shape_m:f, projection_quality:s",
    lambda v: shapes.project_on_shape(v.shape_pings, segments(v), ["ping_id"]),
    f"""WITH {projection_sql('shape_pings')}, b AS (SELECT *, row_number() OVER (PARTITION BY ping_id ORDER BY planar, segment_sequence) AS rn FROM pr)
SELECT ping_id, planar_position AS shape_position, planar_position * total_m AS shape_progress_m, dist AS distance_to_shape_m, CASE WHEN dist <= 30 THEN 'valid' WHEN dist <= 50 THEN 'reduced' ELSE 'fallback_required' END AS projection_quality FROM b WHERE rn = 1""",
    "shape_points shape_pings",
)
R.add(
    "G09_nearby_segments", "ping_id:i, segment_sequence:i, progress_m:f, distance_to_shape_m:f",
    lambda v: shapes.nearby_segments(v.shape_pings, segments(v), ["ping_id"]).select("ping_id", "candidate.segment_sequence", "candidate.progress_m", "candidate.distance_to_shape_m"),
    f"""WITH {projection_sql('shape_pings')}, near AS (SELECT * FROM pr WHERE dist <= 50 AND lo BETWEEN least(lo1, lo2) - 0.001 AND greatest(lo1, lo2) + 0.001 AND la BETWEEN least(la1, la2) - 0.001 AND greatest(la1, la2) + 0.001)
SELECT q.ping_id, n.segment_sequence, n.progress_m, n.dist AS distance_to_shape_m FROM shape_pings q LEFT JOIN near n USING (ping_id)""",
    "shape_points shape_pings",
)
R.add(
    "G10_nearest_segment", "ping_id:i, segment_sequence:i, planar_distance:f, distance_to_shape_m:f",
    lambda v: shapes.nearest_segment(v.shape_pings, segments(v), ["ping_id"]).select("ping_id", "nearest.candidate.segment_sequence", (c("nearest.planar_distance") * 1000).alias("planar_distance"), "nearest.candidate.distance_to_shape_m"),
    f"WITH {projection_sql('shape_pings')}, b AS (SELECT *, row_number() OVER (PARTITION BY ping_id ORDER BY planar, segment_sequence) AS rn FROM pr) SELECT ping_id, segment_sequence, planar * 1000 AS planar_distance, dist AS distance_to_shape_m FROM b WHERE rn = 1",
    "shape_points shape_pings",
)
R.add(
    "G11_segment_at_progress", "ping_id:i, route_bearing_degrees:f",
    lambda v: shapes.segment_at_progress(v.shape_pings.withColumn("shape_progress_m", (c("ping_id") * 31 % 4000) - 100.0), segments(v), ["ping_id"]),
    f"""WITH {SEG_SQL}, j AS (SELECT p.ping_id, s.bearing, row_number() OVER (PARTITION BY p.ping_id ORDER BY CASE WHEN x BETWEEN start_m AND end_m THEN 0 ELSE least(abs(x - start_m), abs(x - end_m)) END, segment_sequence) AS rn
 FROM (SELECT *, (ping_id * 31 % 4000) - 100.0 AS x FROM shape_pings) p JOIN seg s USING (shape_id))
SELECT p.ping_id, j.bearing AS route_bearing_degrees FROM shape_pings p LEFT JOIN j ON p.ping_id = j.ping_id AND j.rn = 1""",
    "shape_points shape_pings",
)
R.add(
    "G12_line_slice", "shape_id:s, points:i, first_lat:f, last_lat:f, rest:i",
    lambda v: shapes.assemble_lines(v.shape_points).withColumn("s", geo.line_slice(c("points"), F.lit(0.7), F.lit(0.2))).withColumn("r", geo.split_line(c("points"), F.lit(0.25))["remaining"])
    .select("shape_id", F.size("s").alias("points"), F.element_at("s", 1)["lat"].alias("first_lat"), F.element_at("s", -1)["lat"].alias("last_lat"), F.size("r").alias("rest")),
    """WITH p AS (SELECT *, lead(latitude) OVER w AS la2, lead(longitude) OVER w AS lo2 FROM shape_points WINDOW w AS (PARTITION BY shape_id ORDER BY sequence)),
l AS (SELECT *, sqrt(pow((lo2 - longitude) * cos(radians((la2 + latitude) / 2)), 2) + pow(la2 - latitude, 2)) AS len FROM p WHERE la2 IS NOT NULL),
t AS (SELECT *, sum(len) OVER (PARTITION BY shape_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS e, sum(len) OVER (PARTITION BY shape_id) AS total FROM l),
cut AS (SELECT shape_id, min(sequence) FILTER (e >= total * 0.2) AS s0, min(sequence) FILTER (e >= total * 0.7) AS s1, min(sequence) FILTER (e >= total * 0.25) AS s2, max(sequence) AS last FROM t GROUP BY 1),
a AS (SELECT t.shape_id, latitude + (la2 - latitude) * (total * 0.2 - (e - len)) / len AS first_lat FROM t JOIN cut ON t.shape_id = cut.shape_id AND sequence = s0),
b AS (SELECT t.shape_id, latitude + (la2 - latitude) * (total * 0.7 - (e - len)) / len AS last_lat FROM t JOIN cut ON t.shape_id = cut.shape_id AND sequence = s1)
SELECT cut.shape_id, s1 - s0 + 2 AS points, first_lat, last_lat, last - s2 + 2 AS rest FROM cut JOIN a USING (shape_id) JOIN b USING (shape_id)""",
    "shape_points",
)
R.add(
    "G13_simplify_line", "shape_id:s, before:i, after:i",
    lambda v: shapes.assemble_lines(v.shape_points).select("shape_id", F.size("points").alias("before"), F.size(geo.simplify_line(c("points"), 0.0002)).alias("after")),
    """WITH RECURSIVE pts AS (SELECT shape_id, sequence, longitude AS x, latitude AS y FROM shape_points),
ends AS (SELECT shape_id, min(sequence) AS lo, max(sequence) AS hi, count(*) AS before FROM pts GROUP BY 1 HAVING count(*) >= 2),
parts AS (SELECT shape_id, lo, hi FROM ends UNION ALL
 SELECT shape_id, CASE WHEN half = 0 THEN lo ELSE mid END, CASE WHEN half = 0 THEN mid ELSE hi END FROM (
  SELECT shape_id, lo, hi, arg_max(sequence, (gap, -sequence)) AS mid, max(gap) AS worst FROM (
   SELECT q.shape_id, lo, hi, p.sequence, sqrt(pow(p.x - a.x - t.t * (b.x - a.x), 2) + pow(p.y - a.y - t.t * (b.y - a.y), 2)) AS gap
   FROM parts q JOIN pts a ON a.shape_id = q.shape_id AND a.sequence = lo JOIN pts b ON b.shape_id = q.shape_id AND b.sequence = hi JOIN pts p ON p.shape_id = q.shape_id AND p.sequence > lo AND p.sequence < hi,
   LATERAL (SELECT CASE WHEN pow(b.x - a.x, 2) + pow(b.y - a.y, 2) > 0 THEN greatest(0.0, least(1.0, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / (pow(b.x - a.x, 2) + pow(b.y - a.y, 2)))) ELSE 0.0 END AS t) t) g GROUP BY 1, 2, 3) m, (VALUES (0), (1)) AS h(half) WHERE worst > 0.0002)
SELECT ends.shape_id, any_value(before) AS before, 2 + (count(*) - 1) // 2 AS after FROM ends JOIN parts USING (shape_id) GROUP BY 1""",
    "shape_points",
)
R.add(
    "W13_progress_clusters", "ping_id:i, segment_sequence:i, cluster:i",
    lambda v: shapes.progress_clusters(
        shapes.nearby_segments(v.shape_pings, segments(v), ["ping_id"]).filter("candidate IS NOT NULL").select("ping_id", "candidate.segment_sequence", F.round("candidate.progress_m", 6).alias("progress_m"))
        .withColumn("progress_m", c("progress_m") + c("segment_sequence") * 1e-4), ["ping_id"]),
    f"""WITH {projection_sql('shape_pings')}, near AS (SELECT ping_id, segment_sequence, round(progress_m, 6) + segment_sequence * 1e-4 AS progress_m FROM pr WHERE dist <= 50 AND lo BETWEEN least(lo1, lo2) - 0.001 AND greatest(lo1, lo2) + 0.001 AND la BETWEEN least(la1, la2) - 0.001 AND greatest(la1, la2) + 0.001),
g AS (SELECT *, CASE WHEN progress_m - lag(progress_m) OVER (PARTITION BY ping_id ORDER BY progress_m) > 15 THEN 1 ELSE 0 END AS s FROM near)
SELECT ping_id, segment_sequence, sum(s) OVER (PARTITION BY ping_id ORDER BY progress_m ROWS UNBOUNDED PRECEDING) AS cluster FROM g""",
    "shape_points shape_pings",
)
R.add(
    "S09_to_geojson", "vehicle_prefix:s, feature:s",
    lambda v: tables.point_features(v.states.filter("latitude IS NOT NULL"), ["current_line", "map_match_status"], "vehicle_prefix"),
    """SELECT vehicle_prefix, concat('{"type":"Feature","id":"', vehicle_prefix, '","properties":{"current_line":"', current_line, '","map_match_status":"', map_match_status, '"},"geometry":{"type":"Point","coordinates":[', CAST(longitude AS VARCHAR), ',', CAST(latitude AS VARCHAR), ']}}') AS feature
 FROM states WHERE latitude IS NOT NULL""",
    "states",
)
R.add(
    "S09_line_features", "shape_id:s, feature:s",
    lambda v: tables.line_features(shapes.assemble_lines(v.shape_points), ["point_count"], "shape_id"),
    """WITH l AS (SELECT shape_id, count(*) AS n, string_agg(concat('[', CAST(round(longitude, 6) AS VARCHAR), ',', CAST(round(latitude, 6) AS VARCHAR), ']'), ',' ORDER BY sequence) AS pts FROM shape_points GROUP BY 1 HAVING count(*) >= 2)
SELECT shape_id, concat('{"type":"Feature","id":"', shape_id, '","properties":{"point_count":', CAST(n AS VARCHAR), '},"geometry":{"type":"LineString","coordinates":[', pts, ']}}') AS feature FROM l""",
    "shape_points",
)


def walks(v):
    """Three samples per ping moving along its shape, as window states."""
    start = F.lit("2024-01-10 00:00:00").cast("timestamp")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("sample_index"), F.lit(2 - i).alias("ahead")) for i in (0, 1, 2)]))
    return v.shape_pings.select("ping_id", "feed_id", "shape_id", "latitude", "longitude", step.alias("s")).select(
        "ping_id", "feed_id", "shape_id", "s.sample_index",
        F.timestamp_micros(F.unix_micros(start) + c("s.ahead") * 30_000_000).alias("sample_timestamp"),
        (c("latitude") + c("s.ahead") * 0.0003).alias("latitude"), (c("longitude") + c("s.ahead") * 0.0002).alias("longitude"))


def matched(v):
    keys = ["ping_id", "sample_index"]
    near = shapes.nearby_segments(walks(v), segments(v), keys)
    return matching.match_three_samples(matching.sample_windows(near, ["ping_id"]))


R.add(
    "M01_match_three_samples", "ping_id:i, match_status:s, progress_m:f, previous_progress_m:f",
    lambda v: matched(v).select("ping_id", "match_status", F.try_element_at("path", F.lit(-1))["progress_m"].alias("progress_m"), F.try_element_at("path", F.lit(-2))["progress_m"].alias("previous_progress_m")),
)
R.add(
    "M02_resolve_positions", "ping_id:i, map_match_status:s, shape_progress_m:f, distance_to_shape_m:f, projection_quality:s, previous_1_progress_m:f, previous_2_progress_m:f",
    lambda v: matching.resolve_positions(
        v.shape_pings.withColumn("map_match_status", F.lit("collecting")).withColumn("shape_progress_m", F.lit(None).cast("double")), matched(v), ["ping_id"]),
)


def stop_places(v):
    """Stops standing beside the shape of their trip, one set per shape and stop."""
    walk = timetable.stop_patterns(v.trips, v.stop_times)
    distinct = timetable.distinct_patterns(walk)
    exploded = distinct.select("pattern_id", "feed_id", "shape_id", F.posexplode("stop_ids").alias("p", "stop_id"))
    return exploded.select(
        "pattern_id", "feed_id", "shape_id", "stop_id", (c("p") + 1).alias("stop_ordinal"),
        (-15.8 + 0.0006 * (3 * (c("p") + 1)) + 0.0001).alias("latitude"), (-47.9 + 0.0004 * (3 * (c("p") + 1)) + 0.00005).alias("longitude"))


R.add(
    "M03_monotonic_stop_path", "pattern_id:s, stops:i, last_progress_m:f, total_distance_m:f",
    lambda v: _paths(v).filter("NOT used_fallback").select(
        "pattern_id", F.size("path").alias("stops"), F.element_at("path", -1)["progress_m"].alias("last_progress_m"), F.aggregate("path", F.lit(0.0), lambda a, x: a + x["distance_to_shape_m"]).alias("total_distance_m")),
)
R.add(
    "M04_monotonic_with_fallback", "pattern_id:s, stop_ordinal:i, shape_progress_m:f, quality:s",
    lambda v: matching.path_assignments(_paths(v)),
)


def _paths(v):
    stops = stop_places(v)
    # candidates are shared per shape and stop, so a stop must stand in one place on a shape
    places = stops.withColumn("stop_id", F.concat_ws("/", "stop_id", c("stop_ordinal").cast("string")))
    return matching.monotone_with_fallback(places, segments(v))
