"""Registered timetable queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.catalog.positions import DOW, active_sql
from fleetgrain.operators import crossings, timetable
from fleetgrain.operators.shapes import assemble_lines, shape_segments, shape_totals
from fleetgrain.session import materialize

R = Registry()
c = F.col
DAY = "2024-01-04"
AT_MORNING = "2024-01-04 12:00:00"
DATES = ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-06"]

R.add(
    "S11_latest_feed", "feed_id:s", lambda v: timetable.latest_feed(v.feeds),
    "SELECT feed_id FROM feeds ORDER BY retrieved_at DESC, feed_id DESC LIMIT 1", "feeds",
)
R.add(
    "J02_active_trips", "trip_id:i, line:s, direction:s, planned_time:s", lambda v: timetable.active_trips(v.trips, v.routes, v.services, v.exceptions, DAY),
    f"WITH {active_sql(DAY)} SELECT trip_id, line, direction, planned_time FROM active", "trips routes services exceptions",
)


def days_sql(dates: list[str]) -> str:
    values = ", ".join(f"(DATE '{d}')" for d in dates)
    return f"""days AS (SELECT s.service_id, d.service_date FROM services s CROSS JOIN (VALUES {values}) AS d(service_date)
 LEFT JOIN exceptions e ON e.service_id = s.service_id AND e.service_date = d.service_date
 WHERE e.exception_type = 1 OR (e.exception_type IS NULL AND start_date <= d.service_date AND end_date >= d.service_date AND {DOW.format('d.service_date')}))"""


R.add(
    "J03_service_days", "service_id:s, service_date:d", lambda v: timetable.service_days(v.services, v.exceptions, DATES),
    f"WITH {days_sql(DATES)} SELECT * FROM days", "services exceptions",
)
NEXT_SQL = """nxt AS (SELECT o.trip_id, o.stop_id AS origin_stop_id, o.stop_sequence AS origin_stop_sequence, o.departure_seconds, o.shape_progress_m AS op, o.shape_position AS opos, o.quality AS oq,
 d.stop_id AS destination_stop_id, d.stop_sequence AS destination_stop_sequence, d.arrival_seconds, d.shape_progress_m AS dp, d.shape_position AS dpos, d.quality AS dq
 FROM stop_times o JOIN stop_times d ON d.trip_id = o.trip_id AND d.stop_sequence = (SELECT min(x.stop_sequence) FROM stop_times x WHERE x.trip_id = o.trip_id AND x.stop_sequence > o.stop_sequence))"""
PAIR_OUT = "trip_id:i, origin_stop_id:s, destination_stop_id:s, origin_stop_sequence:i, destination_stop_sequence:i"
R.add(
    "J04_next_stop_pairs", PAIR_OUT, lambda v: timetable.next_stop_pairs(v.stop_times), f"WITH {NEXT_SQL} SELECT * FROM nxt", "stop_times",
)
ADJ_SQL = """adj AS (SELECT o.trip_id, o.stop_id AS origin_stop_id, o.stop_sequence AS origin_stop_sequence, o.departure_seconds, o.shape_progress_m AS op, o.shape_position AS opos,
 d.stop_id AS destination_stop_id, d.stop_sequence AS destination_stop_sequence, d.shape_progress_m AS dp, d.shape_position AS dpos, d.arrival_seconds - o.departure_seconds AS duration_seconds
 FROM stop_times o JOIN stop_times d ON d.trip_id = o.trip_id AND d.stop_sequence = o.stop_sequence + 1 WHERE d.arrival_seconds > o.departure_seconds)"""
R.add(
    "J05_adjacent_stop_pairs", f"{PAIR_OUT}, duration_seconds:i", lambda v: timetable.adjacent_stop_pairs(v.stop_times), f"WITH {ADJ_SQL} SELECT * FROM adj", "stop_times",
)


def requested(v):
    """Stop pairs with route and direction, as asked for by vehicles on the road."""
    pairs = timetable.adjacent_stop_pairs(v.stop_times).join(v.trips.select("feed_id", "trip_id", "route_id", "direction_id"), ["feed_id", "trip_id"])
    return pairs.filter("origin_stop_id <> destination_stop_id").select("origin_stop_id", "destination_stop_id", "route_id", "direction_id").distinct()


REQ_SQL = f"{ADJ_SQL}, req AS (SELECT DISTINCT origin_stop_id, destination_stop_id, route_id, direction_id FROM adj JOIN trips USING (trip_id) WHERE origin_stop_id <> destination_stop_id)"


def traversals(v, pairs):
    return timetable.planned_traversals(pairs, v.stop_times, v.trips, v.services, v.exceptions, DATES)


TRAV_SQL = f"""{REQ_SQL}, {days_sql(DATES)}, trav AS (SELECT a.origin_stop_id, a.destination_stop_id, t.route_id, t.direction_id, d.service_date + CAST(a.departure_seconds // 86400 AS INTEGER) AS departure_date,
 a.departure_seconds % 86400 // 300 AS slot_index, a.duration_seconds FROM adj a JOIN (SELECT DISTINCT origin_stop_id, destination_stop_id FROM req) r USING (origin_stop_id, destination_stop_id)
 JOIN trips t ON t.trip_id = a.trip_id JOIN days d ON d.service_id = t.service_id)"""
R.add(
    "J10_planned_traversals", "origin_stop_id:s, destination_stop_id:s, route_id:s, direction_id:i, departure_date:d, slot_index:i, duration_seconds:i, n:i",
    lambda v: traversals(v, requested(v)).groupBy("origin_stop_id", "destination_stop_id", "route_id", "direction_id", "departure_date", "slot_index", "duration_seconds").agg(F.count("*").alias("n")),
    f"WITH {TRAV_SQL} SELECT *, count(*) AS n FROM trav GROUP BY ALL", "stop_times trips services exceptions",
)
MEANS_SQL = """means AS (SELECT 'physical' AS scope, origin_stop_id, destination_stop_id, CAST(NULL AS VARCHAR) AS route_id, CAST(NULL AS INTEGER) AS direction_id, departure_date, slot_index, avg(duration_seconds) AS mean_seconds, count(*) AS trip_count FROM trav GROUP BY ALL
UNION ALL SELECT 'service', t.origin_stop_id, t.destination_stop_id, t.route_id, t.direction_id, departure_date, slot_index, avg(duration_seconds), count(*) FROM trav t JOIN req USING (origin_stop_id, destination_stop_id, route_id, direction_id) GROUP BY ALL)"""


def _slot_means(v):
    pairs = materialize(requested(v))
    return timetable.planned_slot_means(traversals(v, pairs), pairs)


R.add(
    "A06_planned_slot_means", "scope:s, origin_stop_id:s, destination_stop_id:s, route_id:s, direction_id:i, departure_date:d, slot_index:i, mean_seconds:f, trip_count:i",
    _slot_means, f"WITH {TRAV_SQL}, {MEANS_SQL} SELECT * FROM means", "stop_times trips services exceptions",
)


def in_windows(v):
    return timetable.planned_in_windows(requested(v), v.stop_times, v.trips, v.services, v.exceptions, AT_MORNING, ["2024-01-03", "2024-01-04"])


WIN_SQL = f"""{NEXT_SQL}, {REQ_SQL}, {days_sql(["2024-01-03", "2024-01-04"])},
off AS (SELECT * FROM (VALUES (1,0),(2,-5),(3,5),(4,-10),(5,10),(6,-15),(7,15),(8,-20),(9,20),(10,-25),(11,25),(12,-30),(13,30)) AS o(rank, offset_minutes)),
win AS (SELECT rank, offset_minutes, CAST(w AS DATE) AS service_date, hour(w) * 3600 + minute(w) // 5 * 300 AS slot_start FROM (SELECT *, TIMESTAMP '{AT_MORNING}' - INTERVAL 3 HOUR + to_minutes(offset_minutes) AS w FROM off) a
 UNION ALL SELECT rank, offset_minutes, CAST(w AS DATE) - 1, hour(w) * 3600 + minute(w) // 5 * 300 + 86400 FROM (SELECT *, TIMESTAMP '{AT_MORNING}' - INTERVAL 3 HOUR + to_minutes(offset_minutes) AS w FROM off) b),
runs_ AS (SELECT n.origin_stop_id, n.destination_stop_id, t.route_id, t.direction_id, w.rank, w.offset_minutes, n.arrival_seconds - n.departure_seconds AS duration_seconds
 FROM nxt n JOIN (SELECT DISTINCT origin_stop_id, destination_stop_id FROM req) r USING (origin_stop_id, destination_stop_id) JOIN trips t ON t.trip_id = n.trip_id JOIN days d ON d.service_id = t.service_id
 JOIN win w ON w.service_date = d.service_date AND n.departure_seconds >= w.slot_start AND n.departure_seconds < w.slot_start + 300 WHERE n.arrival_seconds > n.departure_seconds)"""
R.add(
    "J11_planned_in_windows", "origin_stop_id:s, destination_stop_id:s, route_id:s, direction_id:i, offset_minutes:i, n:i, total:i",
    lambda v: in_windows(v).groupBy("origin_stop_id", "destination_stop_id", "route_id", "direction_id", "offset_minutes").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("total")),
    f"WITH {WIN_SQL} SELECT origin_stop_id, destination_stop_id, route_id, direction_id, offset_minutes, count(*) AS n, sum(duration_seconds) AS total FROM runs_ GROUP BY ALL", "stop_times trips services exceptions",
)
R.add(
    "A07_first_offset_mean", "origin_stop_id:s, destination_stop_id:s, offset_minutes:i, mean_seconds:f, sample_count:i",
    lambda v: timetable.first_offset_mean(in_windows(v), ["origin_stop_id", "destination_stop_id"]),
    f"WITH {WIN_SQL}, g AS (SELECT origin_stop_id, destination_stop_id, rank, offset_minutes, avg(duration_seconds) AS mean_seconds, count(*) AS sample_count FROM runs_ GROUP BY ALL) SELECT * FROM g QUALIFY rank = min(rank) OVER (PARTITION BY origin_stop_id, destination_stop_id)",
    "stop_times trips services exceptions",
)
PATTERN_SQL = "pat AS (SELECT t.trip_id, t.shape_id, string_agg(stop_id, ',' ORDER BY stop_sequence) AS stops FROM trips t JOIN stop_times USING (trip_id) GROUP BY 1, 2)"


def _joined(column):
    return F.array_join(column, ",")


R.add(
    "A08_stop_patterns", "shape_id:s, stops:s, trip_count:i",
    lambda v: timetable.distinct_patterns(timetable.stop_patterns(v.trips, v.stop_times)).select("shape_id", _joined("stop_ids").alias("stops"), "trip_count"),
    f"WITH {PATTERN_SQL} SELECT shape_id, stops, count(*) AS trip_count FROM pat GROUP BY 1, 2", "trips stop_times",
)


def _members(v):
    patterns = timetable.stop_patterns(v.trips, v.stop_times)
    distinct = timetable.distinct_patterns(patterns)
    return timetable.pattern_members(patterns, distinct).join(distinct.select("pattern_id", "shape_id", "stop_ids"), "pattern_id")


R.add(
    "J17_pattern_members", "trip_id:i, shape_id:s, stops:s", lambda v: _members(v).select("trip_id", "shape_id", _joined("stop_ids").alias("stops")),
    f"WITH {PATTERN_SQL} SELECT trip_id, shape_id, stops FROM pat", "trips stop_times",
)


def _assigned(v):
    patterns = timetable.stop_patterns(v.trips, v.stop_times)
    distinct = timetable.distinct_patterns(patterns)
    per_stop = distinct.select("pattern_id", F.posexplode("stop_ids").alias("p", "s"))
    new = per_stop.select(
        "pattern_id", (c("p") + 1).alias("stop_ordinal"), (c("p") / 10.0).alias("shape_position"), (c("p") * 100.0).alias("shape_progress_m"),
        F.lit(12.0).alias("distance_to_shape_m"), F.lit("valid").alias("quality"))
    return timetable.assign_pattern_stops(v.stop_times, timetable.pattern_members(patterns, distinct), new)


R.add(
    "J18_assign_pattern_stops", "trip_id:i, stop_sequence:i, shape_position:f, shape_progress_m:f, distance_to_shape_m:f, quality:s", _assigned,
    """WITH o AS (SELECT s.*, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS n, t.shape_id FROM stop_times s LEFT JOIN trips t USING (trip_id))
SELECT trip_id, stop_sequence, CASE WHEN shape_id IS NOT NULL THEN (n - 1) / 10.0 ELSE shape_position END AS shape_position, CASE WHEN shape_id IS NOT NULL THEN (n - 1) * 100.0 ELSE shape_progress_m END AS shape_progress_m,
 CASE WHEN shape_id IS NOT NULL THEN 12.0 END AS distance_to_shape_m, CASE WHEN shape_id IS NOT NULL THEN 'valid' ELSE quality END AS quality FROM o""",
    "stop_times trips",
)
R.add(
    "A09_trip_start_seconds", "trip_id:i, start_seconds:i", lambda v: timetable.trip_start_seconds(v.stop_times),
    "SELECT trip_id, departure_seconds AS start_seconds FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS rn FROM stop_times) x WHERE rn = 1", "stop_times",
)
R.add(
    "W01_previous_stop_sequence", "trip_id:i, stop_sequence:i, previous_stop_sequence:i", lambda v: timetable.previous_stop_sequence(v.stop_times),
    "SELECT trip_id, stop_sequence, lag(stop_sequence) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS previous_stop_sequence FROM stop_times", "stop_times",
)


def totals(v):
    return v.trips.select("feed_id", "shape_id").distinct().withColumn("shape_total_m", F.lit(2500.0))


def wrapped(v):
    """Stop times whose fifth stop falls back on the shape, as a loop terminal does."""
    return v.stop_times.withColumn("shape_progress_m", F.when(c("stop_sequence") == 5, F.lit(10.0)).otherwise(c("shape_progress_m")))


PLANNED_SQL = """st2 AS (SELECT *, CASE WHEN stop_sequence = 5 THEN 10.0 ELSE shape_progress_m END AS prog FROM stop_times),
w AS (SELECT *, lead(stop_id) OVER t AS d_stop, lead(stop_sequence) OVER t AS d_seq, lead(arrival_seconds) OVER t AS d_arr, lead(prog) OVER t AS d_prog0, lead(quality) OVER t AS d_q, lead(stop_sequence, 2) OVER t IS NULL AS is_last
 FROM st2 WINDOW t AS (PARTITION BY trip_id ORDER BY stop_sequence)),
w2 AS (SELECT *, is_last AND d_prog0 <= prog AND 2500.0 > prog AND trip_id IN (SELECT trip_id FROM trips) AS wrap FROM w WHERE d_seq IS NOT NULL AND trip_id IN (SELECT trip_id FROM trips)),
w3 AS (SELECT *, CASE WHEN wrap THEN 2500.0 ELSE d_prog0 END AS d_prog FROM w2),
plan AS (SELECT trip_id, stop_id AS origin_stop_id, d_stop AS destination_stop_id, stop_sequence AS origin_stop_sequence, d_seq AS destination_stop_sequence, prog AS origin_progress_m, d_prog AS destination_progress_m, d_arr - departure_seconds AS duration_seconds
 FROM w3 WHERE (stop_id <> d_stop OR wrap) AND d_prog > prog AND d_arr > departure_seconds AND quality IN ('valid', 'reduced') AND d_q IN ('valid', 'reduced'))"""
R.add(
    "W07_planned_segments", f"{PAIR_OUT}, origin_progress_m:f, destination_progress_m:f, duration_seconds:f", lambda v: timetable.planned_segments(wrapped(v), v.trips, totals(v)),
    f"WITH {PLANNED_SQL} SELECT * FROM plan", "stop_times trips",
)
R.add(
    "A22_index_counts", "active_trips:i, planned_segments:i",
    lambda v: timetable.index_counts(timetable.active_trips(v.trips, v.routes, v.services, v.exceptions, DAY), timetable.planned_segments(wrapped(v), v.trips, totals(v))),
    f"WITH {active_sql(DAY)}, {PLANNED_SQL} SELECT count(*) AS active_trips, (SELECT count(*) FROM plan WHERE trip_id IN (SELECT trip_id FROM active)) AS planned_segments FROM active", "stop_times trips routes services exceptions",
)
R.add(
    "A10_shape_totals", "shape_id:s, shape_total_m:f", lambda v: shape_totals(shape_segments(v.shape_points)),
    """WITH p AS (SELECT *, lead(latitude) OVER w AS la2, lead(longitude) OVER w AS lo2 FROM shape_points WINDOW w AS (PARTITION BY shape_id ORDER BY sequence)),
m AS (SELECT shape_id, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(la2 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(la2)) * pow(sin(radians(lo2 - longitude) / 2), 2)))) AS d FROM p WHERE la2 IS NOT NULL)
SELECT shape_id, sum(d) AS shape_total_m FROM m GROUP BY 1 HAVING sum(d) > 0""",
    "shape_points",
)
R.add(
    "J19_trip_geometry", "trip_id:i, route_id:s, short_name:s, shape_id:s, point_count:i, stop_count:i, first_stop:s",
    lambda v: timetable.trip_geometry(v.trips, v.routes, v.feeds.withColumn("feed_id", F.lit("F1")).groupBy("feed_id").agg(F.max("retrieved_at").alias("retrieved_at")), assemble_lines(v.shape_points), v.stop_times, v.stops)
    .select("*", F.size("points").alias("point_count"), F.size("stops").alias("stop_count"), F.try_element_at("stops", F.lit(1))["stop_id"].alias("first_stop")),
    """WITH pts AS (SELECT shape_id, count(*) AS point_count FROM shape_points GROUP BY 1 HAVING count(*) >= 2), st AS (SELECT trip_id, count(*) AS n, arg_min(stop_id, stop_sequence) AS f FROM stop_times GROUP BY 1)
SELECT t.trip_id, t.route_id, r.short_name, t.shape_id, p.point_count, st.n AS stop_count, st.f AS first_stop FROM trips t JOIN routes r USING (route_id) JOIN pts p USING (shape_id) LEFT JOIN st USING (trip_id)""",
    "trips routes shape_points stop_times",
)


def _moves(v):
    """Movements along trips: per order, from one progress to a later one."""
    t = v.trips
    start = F.lit("2024-01-10 00:00:00").cast("timestamp")
    shift = lambda s: F.timestamp_micros(F.unix_micros(start) + s.cast("long") * 1_000_000)
    return t.select(
        "feed_id", "trip_id", F.concat(F.lit("V"), c("trip_id").cast("string")).alias("vehicle_prefix"), F.lit(1).alias("session_id"), "route_id", "direction_id",
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        "*", shift(c("trip_id") % 1000 * 60 + c("i") * 120).alias("previous_timestamp"), shift(c("trip_id") % 1000 * 60 + (c("i") + 1) * 120).alias("current_timestamp"),
        (c("i") * 700.0 + c("trip_id") % 100).alias("previous_progress_m"), ((c("i") + 1) * 700.0 + c("trip_id") % 100).alias("current_progress_m"))


MOVES_SQL = """moves AS (SELECT trip_id, i, TIMESTAMP '2024-01-10' + to_seconds(trip_id % 1000 * 60 + i * 120) AS pt, TIMESTAMP '2024-01-10' + to_seconds(trip_id % 1000 * 60 + (i + 1) * 120) AS ct, i * 700.0 + trip_id % 100 AS pp, (i + 1) * 700.0 + trip_id % 100 AS cp
 FROM trips, (VALUES (0), (1), (2), (3)) AS x(i)),
bnd AS (SELECT *, lag(stop_sequence) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS prev_seq FROM stop_times),
crs AS (SELECT m.trip_id, b.stop_id, b.stop_sequence, b.prev_seq, b.shape_progress_m AS prog, b.quality, m.ct AS obs, m.pt + to_microseconds(CAST(round_even((epoch_us(m.ct) - epoch_us(m.pt)) * CAST((b.shape_progress_m - m.pp) / (m.cp - m.pp) AS DOUBLE), 0) AS BIGINT)) AS xat
 FROM moves m JOIN bnd b ON b.trip_id = m.trip_id AND b.shape_progress_m > m.pp AND b.shape_progress_m <= m.cp)"""
R.add(
    "J07_crossed_boundaries", "trip_id:i, i:i, stop_sequence:i, progress_m:f", lambda v: crossings.crossed_boundaries(_moves(v), crossings.trip_boundaries(v.stop_times)),
    f"WITH {MOVES_SQL} SELECT m.trip_id, m.i, b.stop_sequence, b.shape_progress_m AS progress_m FROM moves m JOIN stop_times b ON b.trip_id = m.trip_id AND b.shape_progress_m > m.pp AND b.shape_progress_m <= m.cp", "trips stop_times",
)
R.add(
    "W11_interpolate_crossings", "trip_id:i, stop_sequence:i, crossed_at:t, observation_end:t", lambda v: crossings.interpolate_crossings(_moves(v), crossings.trip_boundaries(v.stop_times)),
    f"WITH {MOVES_SQL} SELECT trip_id, stop_sequence, xat AS crossed_at, obs AS observation_end FROM crs", "trips stop_times",
)
R.add(
    "W12_completed_segments", f"{PAIR_OUT}, duration_seconds:f, distance_m:f, confidence:s, average_speed_kmh:f", lambda v: crossings.completed_segments(crossings.interpolate_crossings(_moves(v), crossings.trip_boundaries(v.stop_times))),
    f"""WITH {MOVES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY xat, prog, stop_sequence) AS rn FROM crs),
o AS (SELECT n.*, max(stop_sequence) OVER (PARTITION BY trip_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM n),
j AS (SELECT d.*, p.stop_id AS o_stop, p.stop_sequence AS o_seq, p.xat AS o_at, p.prog AS o_prog, p.quality AS o_q, p.obs AS o_obs FROM o d JOIN n p ON p.trip_id = d.trip_id AND p.rn = (SELECT min(x.rn) FROM n x WHERE x.trip_id = d.trip_id AND x.rn < d.rn AND x.stop_sequence = d.best))
SELECT trip_id, o_stop AS origin_stop_id, stop_id AS destination_stop_id, o_seq AS origin_stop_sequence, stop_sequence AS destination_stop_sequence, (epoch_us(xat) - epoch_us(o_at)) / 1000000.0 AS duration_seconds, prog - o_prog AS distance_m,
 CASE WHEN o_obs = obs OR o_q = 'reduced' OR quality = 'reduced' THEN 'reduced' ELSE 'high' END AS confidence, (prog - o_prog) / ((epoch_us(xat) - epoch_us(o_at)) / 1000000.0) * 3.6 AS average_speed_kmh
 FROM j WHERE prev_seq = o_seq AND quality <> 'fallback_required' AND o_q <> 'fallback_required' AND xat > o_at""",
    "trips stop_times",
)
R.add(
    "J06_locate_current_segment", "vehicle_prefix:s, origin_stop_id:s, destination_stop_id:s, origin_seq:i, destination_seq:i",
    lambda v: crossings.locate_current_segment(v.states, v.stop_times).select(
        "vehicle_prefix", c("current_origin_stop_id").alias("origin_stop_id"), c("current_destination_stop_id").alias("destination_stop_id"),
        c("current_origin_stop_sequence").alias("origin_seq"), c("current_destination_stop_sequence").alias("destination_seq")),
    f"""WITH {NEXT_SQL}, h AS (SELECT s.vehicle_prefix, n.*, row_number() OVER (PARTITION BY s.vehicle_prefix ORDER BY n.opos DESC, n.origin_stop_sequence DESC) AS rn FROM states s JOIN nxt n ON n.trip_id = s.trip_id
 AND n.opos <= s.shape_position AND n.dpos > s.shape_position AND n.oq <> 'fallback_required' AND n.dq <> 'fallback_required' WHERE s.map_match_status = 'resolved')
SELECT vehicle_prefix, origin_stop_id, destination_stop_id, origin_stop_sequence AS origin_seq, destination_stop_sequence AS destination_seq FROM h WHERE rn = 1""",
    "states stop_times",
)
R.add(
    "U01_union_scopes", "scope:s, trip_id:i, stop_sequence:i",
    lambda v: v.stop_times.select(F.lit("physical").alias("scope"), "trip_id", "stop_sequence").unionByName(v.stop_times.select(F.lit("service").alias("scope"), "trip_id", "stop_sequence")),
    "SELECT 'physical' AS scope, trip_id, stop_sequence FROM stop_times UNION ALL SELECT 'service', trip_id, stop_sequence FROM stop_times", "stop_times",
)
R.add(
    "U02_union_candidates", "trip_id:i, stop_id:s",
    lambda v: v.stop_times.select("trip_id", "stop_id").union(timetable.next_stop_pairs(v.stop_times).select("trip_id", "destination_stop_id")).distinct(),
    f"WITH {NEXT_SQL} SELECT trip_id, stop_id FROM stop_times UNION SELECT trip_id, destination_stop_id FROM nxt", "stop_times",
)
