"""Registered estimate and arrival queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.catalog.metrics import stats_sql
from fleetgrain.catalog.timetable import ADJ_SQL, NEXT_SQL, PLANNED_SQL, days_sql, totals, wrapped
from fleetgrain.operators import estimates, eta, metrics, samples, timetable
from fleetgrain.functions.times import at_lit
from fleetgrain.session import materialize

R = Registry()
c = F.col
NOW = "2024-01-31 12:00:00"
DAY = date(2024, 1, 31)
DATES = ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02"]
LOCAL = "(completed_at - INTERVAL 3 HOUR)"
TABLES = "stop_times trips services exceptions states"


def traversed(v):
    """Measured traversals of the week before NOW, derived from the timetable's stop pairs."""
    pairs = timetable.adjacent_stop_pairs(v.stop_times).join(v.trips.select("feed_id", "trip_id", "route_id", "direction_id"), ["feed_id", "trip_id"])
    start = F.lit("2024-01-24 12:00:00").cast("timestamp")
    shift = (c("trip_id") * 7919 + c("origin_stop_sequence") * 613) % 604800
    return pairs.select(
        "origin_stop_id", "destination_stop_id", "route_id", "direction_id",
        F.timestamp_micros(F.unix_micros(start) + shift * 1_000_000).alias("completed_at"),
        (60 + (c("trip_id") * 31 + c("origin_stop_sequence") * 17) % 120).cast("double").alias("duration_seconds"),
        (c("trip_id") % 10 > 0).alias("accepted"),
        F.when(c("trip_id") % 10 == 0, 0.0).when(c("trip_id") % 3 == 0, 0.5).otherwise(1.0).alias("weight"))


def observed(v):
    """Those traversals once per scope, with their metric keys."""
    return samples.metric_identities(traversed(v))


OBS_SQL = f"""{ADJ_SQL}, obs0 AS (SELECT a.origin_stop_id AS o, a.destination_stop_id AS d, t.route_id AS r, t.direction_id AS dir, TIMESTAMP '2024-01-24 12:00:00' + to_seconds((a.trip_id * 7919 + a.origin_stop_sequence * 613) % 604800) AS completed_at,
 60.0 + (a.trip_id * 31 + a.origin_stop_sequence * 17) % 120 AS duration_seconds, a.trip_id % 10 > 0 AS accepted, CASE WHEN a.trip_id % 10 = 0 THEN 0.0 WHEN a.trip_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS weight
 FROM adj a JOIN trips t USING (trip_id) WHERE a.origin_stop_id <> a.destination_stop_id),
obs AS (SELECT concat_ws('|', 'physical', o, d) AS mk, * FROM obs0 UNION ALL SELECT concat_ws('|', 'service', o, d, r, CAST(dir AS VARCHAR)), * FROM obs0),
lw AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, completed_at) AS window_start FROM obs), lnew AS (SELECT * FROM lw QUALIFY window_start = max(window_start) OVER (PARTITION BY mk)),
live AS (SELECT mk, mean_seconds AS val, reliability AS rel, sample_count_accepted AS cnt, window_start, window_start + INTERVAL 5 MINUTE AS window_end FROM ({stats_sql('lnew', 'mk, window_start')}) s WHERE sample_count_accepted > 0 AND window_start <= TIMESTAMP '{NOW}'),
ds AS (SELECT *, CAST({LOCAL} AS DATE) AS service_date, hour({LOCAL}) * 12 + minute({LOCAL}) // 5 AS slot_index, CASE isodow({LOCAL}) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS day_type FROM obs),
hist AS (SELECT mk, day_type, slot_index, sum(duration_seconds * weight) FILTER (accepted) / sum(weight) FILTER (accepted) AS val, least(1.0, sum(weight) FILTER (accepted) / 5.0) * count(*) FILTER (accepted) / count(*) AS rel, count(*) FILTER (accepted) AS cnt
 FROM ds WHERE service_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1, 2, 3 HAVING count(*) FILTER (accepted) > 0)"""
REMAIN_SQL = f"""{NEXT_SQL}, st AS (SELECT *, source_age_s <= 300 AS recent FROM states),
ah AS (SELECT s.vehicle_prefix, s.route_id, s.direction_id, s.shape_progress_m AS vp, s.current_origin_stop_sequence AS cos, s.current_destination_stop_sequence AS cds, n.*, n.arrival_seconds > n.departure_seconds AS timed, n.origin_stop_id = n.destination_stop_id AS same
 FROM st s JOIN nxt n ON n.trip_id = s.trip_id AND n.origin_stop_sequence >= s.current_origin_stop_sequence WHERE s.recent),
ok AS (SELECT vehicle_prefix FROM ah GROUP BY 1 HAVING bool_or(origin_stop_sequence = cos AND destination_stop_sequence = cds AND dp > op) AND NOT bool_or(same AND timed)),
rem AS (SELECT a.*, CASE WHEN origin_stop_sequence = cos THEN greatest(0.0, least(1.0, (dp - vp) / (dp - op))) ELSE 1.0 END AS frac, CASE WHEN timed THEN arrival_seconds - departure_seconds END AS own FROM ah a JOIN ok USING (vehicle_prefix) WHERE NOT same)"""


def current(v):
    """States as seen shortly before NOW."""
    later = c("source_timestamp") + F.expr("INTERVAL 12 HOURS")
    return v.states.withColumn("source_timestamp", later).withColumn("projected_at", later)


def remaining(v):
    able = eta.eligible_for_eta(current(v), NOW).filter("eta_reason IS NULL").drop("eta_reason")
    return materialize(eta.remaining_segments(able, v.stop_times))


R.add(
    "W08_remaining_segments", "vehicle_prefix:s, origin_stop_sequence:i, origin_stop_id:s, destination_stop_id:s, remaining_fraction:f, planned_duration_seconds:f", remaining,
    f"WITH {REMAIN_SQL} SELECT vehicle_prefix, origin_stop_sequence, origin_stop_id, destination_stop_id, frac AS remaining_fraction, own AS planned_duration_seconds FROM rem", "stop_times states",
)


def measured(v, at=None):
    """Live and profile metrics; with `at`, live ones that can still be used then.

    Traversals are dealt by stop pair, which both scopes of a metric key hold, before they get
    their keys: one shuffle of short rows serves all three metrics.
    """
    seen = samples.metric_identities(traversed(v).repartition(*timetable.PAIR))
    live = metrics.live_metrics(seen, samples.KEYED, at)
    profiles = metrics.rolling_profile(metrics.daily_metrics(seen, samples.KEYED), DAY, samples.KEYED)
    return live, profiles


def catalog(v, requests, at=None):
    live, profiles = measured(v, at)
    return estimates.stored_catalog(
        estimates.estimate_catalog(requests, live, profiles, v.stop_times, v.trips, v.services, v.exceptions, NOW, DAY, DATES))


def _case(name):
    return f"CASE WHEN age <= 3600 AND k % 4 > 0 THEN {name[0]} WHEN k % 3 = 0 THEN {name[1]} WHEN k % 5 > 0 THEN {name[2]} ELSE {name[3]} END"


def _candidates(v):
    end = c("completed_at") + F.expr("INTERVAL 5 MINUTES")
    live = F.when(c("k") % 4 > 0, F.struct(c("duration_seconds").alias("value_seconds"), F.lit(0.9).alias("reliability"), F.lit(4).alias("sample_count"), end.alias("window_end")))
    historical = F.when(c("k") % 3 == 0, F.struct((c("duration_seconds") + 1).alias("value_seconds"), F.lit(0.5).alias("reliability"), F.lit(9).alias("sample_count"), F.lit(-5).alias("offset_minutes")))
    planned = F.when(c("k") % 5 > 0, F.struct((c("duration_seconds") + 2).alias("value_seconds"), F.lit(1.0).alias("reliability"), F.lit(2).alias("sample_count")))
    return v.completions.withColumn("est", estimates.resolve_estimate(at_lit("2024-01-15 00:00:00"), live, historical, planned)).select("event_id", "est.*")


R.add(
    "E01_resolve_estimate", "event_id:i, value_seconds:f, reliability:f, sample_count:i, source:s, age_seconds:f, historical_offset_minutes:i", _candidates,
    f"""WITH a AS (SELECT *, greatest(0, (epoch_us(TIMESTAMP '2024-01-15') - epoch_us(completed_at + INTERVAL 5 MINUTE)) / 1000000.0) AS age FROM completions)
SELECT event_id, {_case(('duration_seconds', 'duration_seconds + 1', 'duration_seconds + 2', 'NULL'))} AS value_seconds, {_case(('0.9', '0.5', '1.0', '0.0'))} AS reliability, {_case(('4', '9', '2', '0'))} AS sample_count,
 {_case(("'live'", "'historical'", "'gtfs_planned'", "'unavailable'"))} AS source, {_case(('age', 'NULL', 'NULL', 'NULL'))} AS age_seconds, {_case(('NULL', '-5', 'NULL', 'NULL'))} AS historical_offset_minutes FROM a""",
    "completions",
)
PLANNED_SLOTS = f"""{days_sql(DATES)}, trav AS (SELECT a.origin_stop_id AS o, a.destination_stop_id AS d, t.route_id AS r, t.direction_id AS dir, y.service_date + CAST(a.departure_seconds // 86400 AS INTEGER) AS dd, a.departure_seconds % 86400 // 300 AS slot, a.duration_seconds AS dur
 FROM adj a JOIN trips t USING (trip_id) JOIN days y ON y.service_id = t.service_id WHERE a.origin_stop_id <> a.destination_stop_id),
plan AS (SELECT concat_ws('|', 'physical', o, d) AS mk, dd, slot, avg(dur) AS val, count(*) AS cnt FROM trav GROUP BY 1, 2, 3 UNION ALL SELECT concat_ws('|', 'service', o, d, r, CAST(dir AS VARCHAR)), dd, slot, avg(dur), count(*) FROM trav GROUP BY 1, 2, 3)"""
ASK_SQL = "ask AS (SELECT DISTINCT concat_ws('|', 'physical', origin_stop_id, destination_stop_id) AS mk FROM rem UNION SELECT DISTINCT concat_ws('|', 'service', origin_stop_id, destination_stop_id, route_id, CAST(direction_id AS VARCHAR)) FROM rem)"
R.add(
    "E03_estimate_catalog", "source:s, day_type:s, service_date:d, slot_index:i, n:i, total:f, samples:i",
    lambda v: catalog(v, remaining(v)).groupBy("source", "day_type", "service_date", "slot_index").agg(F.count("*").alias("n"), F.sum("value_seconds").alias("total"), F.sum("sample_count").alias("samples")),
    f"""WITH {OBS_SQL}, {REMAIN_SQL}, {PLANNED_SLOTS}, {ASK_SQL}, cat AS (SELECT 'live' AS source, CAST(NULL AS VARCHAR) AS day_type, CAST(NULL AS DATE) AS service_date, CAST(NULL AS BIGINT) AS slot_index, val, cnt FROM live JOIN ask USING (mk)
UNION ALL SELECT 'historical', day_type, NULL, slot_index, val, cnt FROM hist JOIN ask USING (mk) UNION ALL SELECT 'gtfs_planned', NULL, dd, slot, val, cnt FROM plan JOIN ask USING (mk))
SELECT source, day_type, service_date, slot_index, count(*) AS n, sum(val) AS total, sum(cnt) AS samples FROM cat GROUP BY ALL""",
    TABLES,
)
OFFSETS = "off AS (SELECT * FROM (VALUES (1,0),(2,-5),(3,5),(4,-10),(5,10),(6,-15),(7,15),(8,-20),(9,20),(10,-25),(11,25),(12,-30),(13,30)) AS o(rank, mins))"
RESOLVE_SQL = f"""{OFFSETS}, slots AS (SELECT rank, mins, CAST(w AS DATE) AS ld, hour(w) * 12 + minute(w) // 5 AS slot, CASE isodow(w) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS dt FROM (SELECT *, TIMESTAMP '{NOW}' - INTERVAL 3 HOUR + to_minutes(mins) AS w FROM off) x),
hb AS (SELECT * FROM (SELECT h.mk, h.val, h.rel, h.cnt, s.mins, row_number() OVER (PARTITION BY h.mk ORDER BY s.rank) AS rn FROM hist h JOIN slots s ON s.dt = h.day_type AND s.slot = h.slot_index) x WHERE rn = 1),
pb AS (SELECT * FROM (SELECT p.mk, p.val, p.cnt, row_number() OVER (PARTITION BY p.mk ORDER BY s.rank) AS rn FROM plan p JOIN slots s ON s.ld = p.dd AND s.slot = p.slot) x WHERE rn = 1),
sc AS (SELECT vehicle_prefix, 'physical' AS scope, origin_stop_sequence AS seq, origin_stop_id AS o, destination_stop_id AS d, frac, own, concat_ws('|', 'physical', origin_stop_id, destination_stop_id) AS mk FROM rem
 UNION ALL SELECT vehicle_prefix, 'service', origin_stop_sequence, origin_stop_id, destination_stop_id, frac, own, concat_ws('|', 'service', origin_stop_id, destination_stop_id, route_id, CAST(direction_id AS VARCHAR)) FROM rem),
res AS (SELECT sc.*, CASE WHEN l.mk IS NOT NULL AND age <= 3600 THEN 'live' WHEN h.mk IS NOT NULL THEN 'historical' WHEN p.mk IS NOT NULL OR own IS NOT NULL THEN 'gtfs_planned' ELSE 'unavailable' END AS source,
 CASE WHEN l.mk IS NOT NULL AND age <= 3600 THEN l.val WHEN h.mk IS NOT NULL THEN h.val WHEN p.mk IS NOT NULL THEN p.val ELSE own END AS val,
 CASE WHEN l.mk IS NOT NULL AND age <= 3600 THEN l.rel WHEN h.mk IS NOT NULL THEN h.rel WHEN p.mk IS NOT NULL OR own IS NOT NULL THEN 1.0 ELSE 0.0 END AS rel,
 CASE WHEN l.mk IS NOT NULL AND age <= 3600 THEN NULL WHEN h.mk IS NOT NULL THEN h.mins END AS mins
 FROM sc LEFT JOIN (SELECT *, greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(window_end)) AS age FROM live) l USING (mk) LEFT JOIN hb h USING (mk) LEFT JOIN pb p USING (mk))"""
FULL_SQL = f"WITH {OBS_SQL}, {REMAIN_SQL}, {PLANNED_SLOTS}, {RESOLVE_SQL}"


def resolved(v):
    segments = remaining(v)
    return eta.resolve_remaining(segments, catalog(v, segments, NOW), NOW)


R.add(
    "E04_catalog_resolve", "vehicle_prefix:s, scope:s, origin_stop_sequence:i, source:s, value_seconds:f, reliability:f, historical_offset_minutes:i",
    lambda v: resolved(v).select("vehicle_prefix", "scope", "origin_stop_sequence", "estimate.source", "estimate.value_seconds", "estimate.reliability", "estimate.historical_offset_minutes"),
    f"{FULL_SQL} SELECT vehicle_prefix, scope, seq AS origin_stop_sequence, source, val AS value_seconds, rel AS reliability, mins AS historical_offset_minutes FROM res", TABLES,
)


def asked_pairs(v):
    """Every measured pair once, some with a route and direction."""
    seen = observed(v).groupBy("origin_stop_id", "destination_stop_id").agg(F.min("route_id").alias("r"))
    # route given for about half the pairs: by the parity of the stop numbers
    with_route = F.expr("try_cast(substr(origin_stop_id, 2) AS BIGINT) % 2 = 0")
    return seen.select("origin_stop_id", "destination_stop_id", F.when(with_route, c("r")).alias("route_id"), F.when(with_route, F.lit(1)).alias("direction_id"))


R.add(
    "E02_segment_estimates", "scope:s, origin_stop_id:s, destination_stop_id:s, route_id:s, source:s, value_seconds:f, reliability:f, sample_count:i, historical_offset_minutes:i",
    lambda v: estimates.segment_estimates(asked_pairs(v), *measured(v, NOW), v.stop_times, v.trips, v.services, v.exceptions, NOW, DAY, ["2024-01-30", "2024-01-31"]),
    f"""WITH {OBS_SQL}, {NEXT_SQL}, {days_sql(['2024-01-30', '2024-01-31'])}, {OFFSETS},
w0 AS (SELECT *, TIMESTAMP '{NOW}' - INTERVAL 3 HOUR + to_minutes(mins) AS w FROM off), slots AS (SELECT rank, mins, hour(w) * 12 + minute(w) // 5 AS slot, CASE isodow(w) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS dt FROM w0),
win AS (SELECT rank, CAST(w AS DATE) AS sd, hour(w) * 3600 + minute(w) // 5 * 300 AS s0 FROM w0 UNION ALL SELECT rank, CAST(w AS DATE) - 1, hour(w) * 3600 + minute(w) // 5 * 300 + 86400 FROM w0),
ap AS (SELECT o, d, CASE WHEN CAST(substr(o, 2) AS INTEGER) % 2 = 0 THEN min(r) END AS r FROM obs0 GROUP BY o, d),
q AS (SELECT 'physical' AS scope, o, d, CAST(NULL AS VARCHAR) AS r, concat_ws('|', 'physical', o, d) AS mk FROM ap UNION ALL SELECT 'service', o, d, r, concat_ws('|', 'service', o, d, r, '1') FROM ap WHERE r IS NOT NULL),
hb AS (SELECT * FROM (SELECT h.*, s.mins, row_number() OVER (PARTITION BY h.mk ORDER BY s.rank) AS rn FROM hist h JOIN slots s ON s.dt = h.day_type AND s.slot = h.slot_index) x WHERE rn = 1),
pr AS (SELECT n.origin_stop_id AS o, n.destination_stop_id AS d, t.route_id AS r, t.direction_id AS dir, w.rank, n.arrival_seconds - n.departure_seconds AS dur FROM nxt n JOIN trips t USING (trip_id) JOIN days y ON y.service_id = t.service_id JOIN win w ON w.sd = y.service_date AND n.departure_seconds >= w.s0 AND n.departure_seconds < w.s0 + 300 WHERE n.arrival_seconds > n.departure_seconds),
pm AS (SELECT concat_ws('|', 'physical', o, d) AS mk, rank, avg(dur) AS val, count(*) AS cnt FROM pr GROUP BY 1, 2 UNION ALL SELECT concat_ws('|', 'service', o, d, r, CAST(dir AS VARCHAR)), rank, avg(dur), count(*) FROM pr GROUP BY 1, 2),
pb AS (SELECT * FROM pm QUALIFY rank = min(rank) OVER (PARTITION BY mk)),
x AS (SELECT q.*, l.val AS lv, l.rel AS lr, l.cnt AS lc, h.val AS hv, h.rel AS hr, h.cnt AS hc, h.mins, p.val AS pv, p.cnt AS pc FROM q LEFT JOIN (SELECT * FROM live WHERE epoch(TIMESTAMP '{NOW}') - epoch(window_end) <= 3600) l USING (mk) LEFT JOIN hb h USING (mk) LEFT JOIN pb p USING (mk))
SELECT scope, o AS origin_stop_id, d AS destination_stop_id, r AS route_id, CASE WHEN lv IS NOT NULL THEN 'live' WHEN hv IS NOT NULL THEN 'historical' WHEN pv IS NOT NULL THEN 'gtfs_planned' ELSE 'unavailable' END AS source, coalesce(lv, hv, pv) AS value_seconds,
 CASE WHEN lv IS NOT NULL THEN lr WHEN hv IS NOT NULL THEN hr WHEN pv IS NOT NULL THEN 1.0 ELSE 0.0 END AS reliability, coalesce(CASE WHEN lv IS NOT NULL THEN lc END, hc, pc, 0) AS sample_count, CASE WHEN lv IS NULL THEN mins END AS historical_offset_minutes FROM x""",
    TABLES,
)
ETA_OUT = "vehicle_prefix:s, scope:s, value_seconds:f, reliability:f, segments_covered:i, segments_total:i, count_live:i, count_historical:i, count_gtfs_planned:i, complete:b, missing_origin_stop_id:s, missing_destination_stop_id:s"
FOLD_SQL = """run AS (SELECT *, min(CASE WHEN source = 'unavailable' THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_prefix, scope ORDER BY seq ROWS UNBOUNDED PRECEDING) AS good, row_number() OVER (PARTITION BY vehicle_prefix, scope ORDER BY seq) AS rn FROM res),
tot AS (SELECT vehicle_prefix, scope, sum(val * frac) FILTER (good = 1) AS total, sum(val * frac * rel) FILTER (good = 1) AS weighted, count(*) FILTER (good = 1) AS segments_covered, count(*) AS segments_total,
 count(*) FILTER (good = 1 AND source = 'live') AS count_live, count(*) FILTER (good = 1 AND source = 'historical') AS count_historical, count(*) FILTER (good = 1 AND source = 'gtfs_planned') AS count_gtfs_planned,
 arg_min(o, seq) FILTER (source = 'unavailable') AS mo, arg_min(d, seq) FILTER (source = 'unavailable') AS md FROM run GROUP BY 1, 2)"""
R.add(
    "E05_eta_current_time", ETA_OUT, lambda v: eta.eta_current_time(resolved(v)),
    f"{FULL_SQL}, {FOLD_SQL} SELECT *, CASE WHEN segments_covered = segments_total THEN total END AS value_seconds, CASE WHEN total > 0 THEN weighted / total ELSE 0 END AS reliability, segments_covered = segments_total AS complete, mo AS missing_origin_stop_id, md AS missing_destination_stop_id FROM tot",
    TABLES,
)


def future(v):
    segments = remaining(v)
    return eta.eta_future_time(eta.reachable_candidates(segments, catalog(v, segments, NOW), NOW))


R.add("E06_eta_future_time", ETA_OUT, future)
R.add(
    "E07_eta_next_stop", "vehicle_prefix:s, scope:s, value_seconds:f, reliability:f, source:s, complete:b, next_stop_id:s", lambda v: eta.eta_next_stop(eta.eta_current_time(resolved(v))),
    f"{FULL_SQL}, {FOLD_SQL} SELECT vehicle_prefix, scope, CASE WHEN good = 1 THEN val * frac END AS value_seconds, CASE WHEN good = 1 THEN rel ELSE 0 END AS reliability, CASE WHEN good = 1 THEN source END AS source, good = 1 AS complete, d AS next_stop_id FROM run WHERE rn = 1",
    TABLES,
)


def nested(v):
    segments = remaining(v)
    return eta.vehicle_eta(current(v), v.stop_times, catalog(v, segments, NOW), NOW, segments)


R.add(
    "E08_vehicle_eta", "vehicle_prefix:s, next_stop_id:s, terminal_stop_id:s, planned_trip_end_at:t, remaining_segment_count:i, now_seconds:f, later_seconds:f, later_complete:b",
    lambda v: nested(v).select(
        "vehicle_prefix", "next_stop_id", "terminal_stop_id", "planned_trip_end_at", "remaining_segment_count", c("current_time.physical.trip_end.value_seconds").alias("now_seconds"),
        c("future_time.service.trip_end.value_seconds").alias("later_seconds"), c("future_time.service.trip_end.complete").alias("later_complete")),
)
R.add(
    "E09_fleet_eta_snapshot", "vehicle_prefix:s, trip_id:i, generated_at:t, calculation_mode:s, payload_bytes:i",
    lambda v: eta.as_snapshots(nested(v), current(v), NOW, "enriched").withColumn("payload_bytes", F.length("payload")),
)


def planned(v):
    return timetable.planned_segments(wrapped(v), v.trips, totals(v))


LOC_SQL = f"""{PLANNED_SQL}, cand AS (SELECT s.vehicle_prefix, s.shape_progress_m AS vp, s.current_origin_stop_sequence AS cos, s.current_destination_stop_sequence AS cds, p.* FROM states s JOIN plan p USING (trip_id)),
loc AS (SELECT vehicle_prefix, coalesce(min(origin_stop_sequence) FILTER (origin_stop_sequence = cos AND destination_stop_sequence = cds), min(origin_stop_sequence) FILTER (origin_progress_m <= vp AND vp < destination_progress_m),
  CASE WHEN max(vp) < arg_min(origin_progress_m, origin_stop_sequence) THEN min(origin_stop_sequence) END) AS start_, max(vp) >= arg_max(destination_progress_m, origin_stop_sequence) AS past FROM cand GROUP BY 1),
ahead AS (SELECT c.*, CASE WHEN origin_stop_sequence = start_ THEN greatest(0.0, least(1.0, (destination_progress_m - vp) / (destination_progress_m - origin_progress_m))) ELSE 1.0 END AS frac, false AS arrived FROM cand c JOIN loc USING (vehicle_prefix) WHERE origin_stop_sequence >= start_),
arr AS (SELECT vehicle_prefix FROM loc WHERE start_ IS NULL AND past)"""
R.add(
    "W09_remaining_planned_segments", "vehicle_prefix:s, origin_stop_sequence:i, remaining_fraction:f",
    lambda v: eta.located_planned_segments(v.states.select("vehicle_prefix", "feed_id", "trip_id", "shape_progress_m", "current_origin_stop_sequence", "current_destination_stop_sequence"), planned(v)).filter("NOT arrived"),
    f"WITH {LOC_SQL} SELECT vehicle_prefix, origin_stop_sequence, frac AS remaining_fraction FROM ahead", "stop_times trips states",
)
R.add(
    "E10_planned_eta", "vehicle_prefix:s, arrived:b, value_seconds:f, remaining_segment_count:i, next_stop_seconds:f, next_stop_id:s",
    lambda v: eta.planned_eta(v.states, planned(v), eta.trip_terminals(v.stop_times), "2024-01-31 00:00:00"),
    f"""WITH {LOC_SQL}, term AS (SELECT trip_id, arg_max(stop_id, stop_sequence) AS t FROM stop_times GROUP BY 1)
SELECT vehicle_prefix, false AS arrived, sum(frac * duration_seconds) AS value_seconds, count(*) AS remaining_segment_count, arg_min(frac * duration_seconds, origin_stop_sequence) AS next_stop_seconds, arg_min(destination_stop_id, origin_stop_sequence) AS next_stop_id FROM ahead GROUP BY 1
UNION ALL SELECT a.vehicle_prefix, true, 0.0, 0, 0.0, t FROM arr a JOIN states s USING (vehicle_prefix) JOIN term USING (trip_id)""",
    "stop_times trips states",
)
R.add(
    "E10_planned_eta_snapshot", "vehicle_prefix:s, trip_id:i, calculation_mode:s, complete:b, seconds:f, reliability:f",
    lambda v: eta.planned_eta_snapshot(v.states, v.snapshots, planned(v), eta.trip_terminals(v.stop_times), "2024-01-31 00:00:00").select(
        "vehicle_prefix", "trip_id", "calculation_mode", *[
            F.get_json_object("payload", f"$.future_time.service.trip_end.{n}").cast(k).alias(a) for n, k, a in (("complete", "boolean", "complete"), ("value_seconds", "double", "seconds"), ("reliability", "double", "reliability"))]),
    f"""WITH {LOC_SQL}, e AS (SELECT vehicle_prefix, sum(frac * duration_seconds) AS seconds FROM ahead GROUP BY 1 UNION ALL SELECT vehicle_prefix, 0.0 FROM arr)
SELECT s.vehicle_prefix, s.trip_id, 'planned_baseline' AS calculation_mode, true AS complete, e.seconds, CASE WHEN e.seconds > 0 OR e.vehicle_prefix IN (SELECT vehicle_prefix FROM arr) THEN 1.0 ELSE 0.0 END AS reliability
 FROM states s JOIN e USING (vehicle_prefix) LEFT JOIN snapshots n USING (vehicle_prefix) WHERE source_age_s <= 60 AND map_match_status = 'resolved' AND projection_quality IN ('valid', 'reduced') AND (n.generated_at IS NULL OR n.trip_id <> s.trip_id OR n.generated_at < TIMESTAMP '2024-01-30 23:50:00')""",
    "stop_times trips states snapshots",
)
R.add(
    "E13_segment_speed_map", "origin_stop_id:s, destination_stop_id:s, source:s, duration_seconds:f, reliability:f, sample_count:i, historical_offset_minutes:i",
    lambda v: estimates.segment_speed_map(estimates.remaining_traversals(current(v), v.stop_times, v.trips, v.stops, NOW), *measured(v, NOW), NOW, DAY, "weekday", 108),
    f"""WITH {OBS_SQL}, veh AS (SELECT trip_id, shape_progress_m AS vp FROM states WHERE source_age_s <= 300),
tv AS (SELECT DISTINCT a.origin_stop_id AS o, a.destination_stop_id AS d, a.departure_seconds, a.duration_seconds, t.shape_id, a.opos, a.dpos, a.dp - a.op AS dist FROM veh JOIN adj a USING (trip_id) JOIN trips t USING (trip_id) WHERE a.op >= vp AND a.dp > a.op AND a.dpos > a.opos),
pl AS (SELECT o, d, avg(duration_seconds) AS pv, count(*) AS pc FROM tv GROUP BY 1, 2),
hx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mk ORDER BY abs(slot_index - 108), slot_index DESC) AS rn FROM hist WHERE mk LIKE 'physical|%' AND day_type = 'weekday' AND abs(slot_index - 108) <= 6) x WHERE rn = 1)
SELECT o AS origin_stop_id, d AS destination_stop_id, CASE WHEN l.val IS NOT NULL THEN 'live' WHEN h.val IS NOT NULL THEN 'historical' ELSE 'gtfs_planned' END AS source, coalesce(l.val, h.val, pv) AS duration_seconds,
 coalesce(l.rel, h.rel, 1.0) AS reliability, coalesce(l.cnt, h.cnt, pc) AS sample_count, CASE WHEN l.val IS NULL THEN (h.slot_index - 108) * 5 END AS historical_offset_minutes
FROM pl LEFT JOIN (SELECT * FROM live WHERE window_end >= TIMESTAMP '2024-01-31 11:00:00') l ON l.mk = concat_ws('|', 'physical', o, d) LEFT JOIN hx h ON h.mk = concat_ws('|', 'physical', o, d)""",
    TABLES,
)
