"""Registered fleet, dashboard and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.catalog.scalars import CLASS_SQL, FLEET_SQL, FLEET_VIEWS, PROJECTED_SQL, ROSTER_SQL, fleet_view
from fleetgrain.catalog.shapes import SEG_SQL, segments
from fleetgrain.catalog.timetable import ADJ_SQL
from fleetgrain.catalog.views import AT
from fleetgrain.operators import decisions, estimates, eta, fleet
from fleetgrain.plans.jobs import fleet_map

R = Registry()
c = F.col
T = f"TIMESTAMP '{AT}'"
MIDDLE = "2024-01-15 00:00:00"

PROJ_SQL = f"""{SEG_SQL}, proj AS (SELECT s.vehicle_prefix, s.shape_progress_m, r.short_name AS route_short_name, t.headsign, o.name AS current_origin_stop_name, d.name AS current_destination_stop_name, s.shape_id, s.latitude, s.longitude
 FROM states s JOIN trips t ON t.trip_id = s.trip_id JOIN routes r ON r.route_id = t.route_id LEFT JOIN stops o ON o.stop_id = s.current_origin_stop_id LEFT JOIN stops d ON d.stop_id = s.current_destination_stop_id
 WHERE s.source_age_s <= 60 AND {PROJECTED_SQL}),
bear AS (SELECT p.vehicle_prefix, g.bearing, row_number() OVER (PARTITION BY p.vehicle_prefix ORDER BY CASE WHEN shape_progress_m BETWEEN start_m AND end_m THEN 0 ELSE least(abs(shape_progress_m - start_m), abs(shape_progress_m - end_m)) END, segment_sequence) AS rn FROM proj p JOIN seg g USING (shape_id))"""
PROJ_OUT = "vehicle_prefix:s, route_short_name:s, headsign:s, current_origin_stop_name:s, current_destination_stop_name:s, route_bearing_degrees:f"


def projected(v):
    states = v.states.drop("headsign", "direction_id")
    return fleet.projected_positions(states, v.trips, v.routes, v.stops, segments(v), AT)


R.add(
    "J13_projected_positions", PROJ_OUT, projected,
    f"WITH {PROJ_SQL} SELECT p.*, b.bearing AS route_bearing_degrees FROM proj p LEFT JOIN bear b ON b.vehicle_prefix = p.vehicle_prefix AND b.rn = 1", "states trips routes stops shape_points",
)
RAW_SQL = f"SELECT vehicle_prefix, {CLASS_SQL} AS operational_class, latitude FROM states WHERE source_age_s <= 60 AND latitude IS NOT NULL AND NOT ({PROJECTED_SQL})"
R.add("J14_raw_positions", "vehicle_prefix:s, operational_class:s, latitude:f", lambda v: fleet.raw_positions(v.states, AT), RAW_SQL, "states")
R.add(
    "K04_fleet_map", "vehicle_prefix:s, position_source:s, operational_class:s, monitored:i",
    lambda v: fleet_map(v.states.drop("headsign", "direction_id"), v.trips, v.routes, v.stops, segments(v), AT),
    f"""WITH m AS (SELECT count(*) AS monitored FROM states WHERE source_age_s <= 60)
SELECT vehicle_prefix, 'projected' AS position_source, 'projected' AS operational_class, monitored FROM states s JOIN trips t USING (trip_id) JOIN routes r ON r.route_id = t.route_id, m WHERE source_age_s <= 60 AND {PROJECTED_SQL}
UNION ALL SELECT vehicle_prefix, 'raw', operational_class, monitored FROM ({RAW_SQL}) x, m""",
    "states trips routes",
)
R.add(
    "A11_class_counts", "projected:i, missing_planned_time:i, ambiguous:i, collecting:i, no_exact_match:i, other:i, monitored:i", lambda v: fleet.class_counts(v.states, AT),
    "WITH k AS (SELECT " + CLASS_SQL + " AS c FROM states WHERE source_age_s <= 60) SELECT " + ", ".join(f"count(*) FILTER (c = '{n}') AS {n}" for n in ("projected", "missing_planned_time", "ambiguous", "collecting", "no_exact_match", "other")) + ", count(*) AS monitored FROM k",
    "states",
)
R.add(
    "A12_source_counts", "live:i, historical:i, gtfs_planned:i",
    lambda v: fleet.source_counts(v.states.select(F.when(c("trip_id") % 3 == 0, "live").when(c("trip_id") % 3 == 1, "historical").otherwise("gtfs_planned").alias("source"))),
    "SELECT count(*) FILTER (trip_id % 3 = 0) AS live, count(*) FILTER (trip_id % 3 = 1) AS historical, count(*) FILTER (trip_id % 3 = 2) AS gtfs_planned FROM states", "states",
)
R.add(
    "A13_sum_count_maps", "source:s, total:i",
    lambda v: fleet.sum_count_maps(v.eta_counts.select(F.create_map(F.lit("live"), c("live"), F.lit("historical"), c("historical"), F.lit("gtfs_planned"), c("gtfs_planned")).alias("source_counts"))),
    "SELECT 'live' AS source, sum(live) AS total FROM eta_counts UNION ALL SELECT 'historical', sum(historical) FROM eta_counts UNION ALL SELECT 'gtfs_planned', sum(gtfs_planned) FROM eta_counts", "eta_counts",
)
R.add(
    "A14_percent_mix", "vehicle_prefix:s, total:i, pct_live:i, pct_historical:i, pct_gtfs_planned:i", lambda v: fleet.percent_mix(v.eta_counts),
    """WITH u AS (SELECT vehicle_prefix, 1 AS o, live AS x, live + historical + gtfs_planned AS total FROM eta_counts UNION ALL SELECT vehicle_prefix, 2, historical, live + historical + gtfs_planned FROM eta_counts UNION ALL SELECT vehicle_prefix, 3, gtfs_planned, live + historical + gtfs_planned FROM eta_counts),
r AS (SELECT *, CASE WHEN total > 0 THEN x / total * 100 ELSE 0 END AS raw FROM u),
k AS (SELECT *, floor(raw) AS f, row_number() OVER (PARTITION BY vehicle_prefix ORDER BY raw - floor(raw) DESC, o) AS place, CASE WHEN total > 0 THEN 100 - sum(floor(raw)) OVER (PARTITION BY vehicle_prefix) ELSE 0 END AS rest FROM r),
p AS (SELECT vehicle_prefix, o, total, f + CASE WHEN place <= rest THEN 1 ELSE 0 END AS pct FROM k)
SELECT vehicle_prefix, max(total) AS total, max(pct) FILTER (o = 1) AS pct_live, max(pct) FILTER (o = 2) AS pct_historical, max(pct) FILTER (o = 3) AS pct_gtfs_planned FROM p GROUP BY 1""",
    "eta_counts",
)
FLEET_OUT = "vehicle_prefix:s, shown_line:s, shown_destination:s, planned_at:t, arrival_delay_seconds:i, departure_delay_seconds:i, delay_status:s, stale:b, low_speed:b"
R.add("J21_fleet_rows", FLEET_OUT, fleet_view, f"WITH {FLEET_SQL} SELECT * FROM fleet", FLEET_VIEWS)
R.add(
    "W10_select_roster_trip", "vehicle_prefix:s, trip_number:i, in_progress:b, line:s", lambda v: fleet.select_roster_trip(v.roster, AT),
    f"WITH {ROSTER_SQL} SELECT vehicle_prefix, trip_number, in_progress, line FROM picked", "roster",
)
R.add(
    "A15_kpi_rollup", "on_time:i, warning:i, delayed:i, no_reference:i, vehicles:i, stale:i, low_speed:i, punctuality:f", lambda v: fleet.kpi_rollup(fleet_view(v)),
    f"""WITH {FLEET_SQL} SELECT count(*) FILTER (delay_status = 'on_time') AS on_time, count(*) FILTER (delay_status = 'warning') AS warning, count(*) FILTER (delay_status = 'delayed') AS delayed, count(*) FILTER (delay_status = 'no_reference') AS no_reference,
 count(*) AS vehicles, count(*) FILTER (stale) AS stale, count(*) FILTER (low_speed) AS low_speed, count(*) FILTER (delay_status = 'on_time') / count(*) FILTER (delay_status <> 'no_reference') AS punctuality FROM fleet""",
    FLEET_VIEWS,
)
R.add(
    "A16_top_lines_by_delay", "line:s, vehicles:i, total_delay_seconds:i", lambda v: fleet.top_lines_by_delay(fleet_view(v)),
    f"WITH {FLEET_SQL} SELECT shown_line AS line, count(*) AS vehicles, sum(arrival_delay_seconds) AS total_delay_seconds FROM fleet WHERE arrival_delay_seconds > 0 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5", FLEET_VIEWS,
)
R.add(
    "W14_sort_fleet", "vehicle_prefix:s, sort_key:s",
    lambda v: fleet.sort_fleet(fleet_view(v), "vehicle_prefix", "desc").select("vehicle_prefix", fleet.natural_key(c("vehicle_prefix")).alias("sort_key")),
    f"WITH {FLEET_SQL} SELECT vehicle_prefix, concat('v', lpad(CAST(length(ltrim(substr(vehicle_prefix, 2), '0')) AS VARCHAR), 6, '0'), ltrim(substr(vehicle_prefix, 2), '0')) AS sort_key FROM fleet", FLEET_VIEWS,
)
R.add(
    "W15_search_top", "vehicle_prefix:s", lambda v: fleet.search_top(fleet_view(v), " V12 "),
    f"WITH {FLEET_SQL} SELECT vehicle_prefix FROM fleet WHERE contains(lower(vehicle_prefix), 'v12') OR contains(lower(route_short_name), 'v12') OR contains(lower(headsign), 'v12') ORDER BY vehicle_prefix LIMIT 8", FLEET_VIEWS,
)
R.add(
    "A21_source_health", "source_system:s, latest_attempt_status:s, last_success_at:t, last_success_age_seconds:f, state:s", lambda v: fleet.source_health(v.runs, AT, 3600.0),
    f"""WITH l AS (SELECT source_system, arg_max(status, started_at) AS latest_attempt_status, max(finished_at) FILTER (status IN ('succeeded', 'partial')) AS last_success_at FROM runs GROUP BY 1)
SELECT *, (epoch_us({T}) - epoch_us(last_success_at)) / 1000000.0 AS last_success_age_seconds,
 CASE WHEN last_success_at IS NULL THEN 'starting' WHEN (epoch_us({T}) - epoch_us(last_success_at)) / 1000000.0 <= 3600 AND latest_attempt_status <> 'failed' THEN 'operational' ELSE 'degraded' END AS state FROM l""",
    "runs",
)
R.add(
    "E11_current_snapshots", "vehicle_prefix:s, generated_at:t, latest_generated_at:t", lambda v: eta.current_snapshots(v.snapshots, AT),
    f"SELECT vehicle_prefix, generated_at, (SELECT max(generated_at) FROM snapshots) AS latest_generated_at FROM snapshots WHERE generated_at >= {T} - INTERVAL 10 MINUTE", "snapshots",
)
R.add(
    "E12_due_windows", "latest_generated_at:t, window_start:t, due:b", lambda v: estimates.due_windows(v.snapshots, "2024-01-31 00:04:00"),
    "SELECT max(generated_at) AS latest_generated_at, TIMESTAMP '2024-01-31 00:00:00' AS window_start, max(generated_at) < TIMESTAMP '2024-01-31 00:00:00' AS due FROM snapshots WHERE coalesce(calculation_mode, 'enriched') = 'enriched'", "snapshots",
)
NEEDS_SQL = f"SELECT s.* FROM states s LEFT JOIN snapshots n USING (vehicle_prefix) WHERE source_age_s <= 60 AND {PROJECTED_SQL} AND (n.generated_at IS NULL OR n.trip_id <> s.trip_id OR n.generated_at < {T} - INTERVAL 10 MINUTE)"
R.add("J15_needs_planned_snapshot", "vehicle_prefix:s, trip_id:i", lambda v: eta.needs_planned_snapshot(v.states, v.snapshots, AT), f"SELECT x.vehicle_prefix, x.trip_id FROM ({NEEDS_SQL}) x", "states snapshots")
TRAV_SQL = f"""{ADJ_SQL}, veh AS (SELECT trip_id, shape_progress_m AS vp FROM states WHERE source_age_s <= 300),
ahead AS (SELECT DISTINCT a.origin_stop_id, a.destination_stop_id, o.name AS origin_stop_name, d.name AS destination_stop_name, a.departure_seconds, a.duration_seconds, t.shape_id, a.opos, a.dpos, a.dp - a.op AS distance_m
 FROM veh JOIN adj a USING (trip_id) JOIN trips t USING (trip_id) JOIN stops o ON o.stop_id = a.origin_stop_id JOIN stops d ON d.stop_id = a.destination_stop_id WHERE a.op >= vp AND a.dp > a.op AND a.dpos > a.opos)"""
R.add(
    "J20_remaining_traversals", "origin_stop_id:s, destination_stop_id:s, origin_stop_name:s, shape_id:s, departure_seconds:i, duration_seconds:i, distance_m:f",
    lambda v: estimates.remaining_traversals(v.states, v.stop_times, v.trips, v.stops, AT), f"WITH {TRAV_SQL} SELECT * FROM ahead", "states stop_times trips stops",
)
STATE_SQL = """valid AS (SELECT *, CASE status WHEN 'in_analysis' THEN 1 WHEN 'claimed' THEN 2 ELSE 3 END AS lvl, row_number() OVER (PARTITION BY execution_key ORDER BY occurred_at, event_id) AS n FROM decision_events WHERE (status = 'rejected' AND coalesce(trim(reason), '') <> '') OR (status <> 'rejected' AND reason IS NULL)),
fold AS (SELECT *, coalesce(max(lvl) OVER (PARTITION BY execution_key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM valid),
state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_key ORDER BY n DESC) AS back FROM fold WHERE lvl > before) x WHERE back = 1)"""
R.add(
    "X07_decision_state", "execution_key:s, status:s, updated_at:t, updated_by:s, rejection_reason:s, executed_at:t", lambda v: decisions.decision_state(v.decision_events),
    f"WITH {STATE_SQL} SELECT execution_key, status, occurred_at AS updated_at, actor AS updated_by, reason AS rejection_reason, CASE WHEN status = 'executed' THEN occurred_at END AS executed_at FROM state", "decision_events",
)
R.add(
    "X07_classify_events", "event_id:i, outcome:s", lambda v: decisions.classify_events(v.decision_events),
    f"""WITH {STATE_SQL}, cur AS (SELECT f.event_id, f.status, f.lvl, f.before, (SELECT p.status FROM fold p WHERE p.execution_key = f.execution_key AND p.n < f.n AND p.lvl > p.before ORDER BY p.n DESC LIMIT 1) AS now_ FROM fold f)
SELECT d.event_id, CASE WHEN c.event_id IS NULL THEN 'invalid' WHEN lvl > before THEN 'applied' WHEN c.status = now_ THEN 'repeat' ELSE 'conflict' END AS outcome FROM decision_events d LEFT JOIN cur c USING (event_id)""",
    "decision_events",
)


def groups(v):
    """Exchange groups, one per decision key, with departure and saving."""
    return v.events.groupBy(F.concat(F.lit("G"), c("user_id").cast("string")).alias("execution_key")).agg(
        F.min("ts").cast("timestamp").alias("first_departure_at"), F.sum(c("event_id") % 900).alias("saved_delay_seconds"), F.count("*").alias("steps"))


GROUP_SQL = "grp AS (SELECT concat('G', CAST(user_id AS VARCHAR)) AS execution_key, min(ts) + INTERVAL 14 DAY AS first_departure_at, sum(event_id % 900) AS saved_delay_seconds FROM events GROUP BY 1)"


def open_groups(v):
    return groups(v).withColumn("first_departure_at", c("first_departure_at") + F.expr("INTERVAL 14 DAYS"))


def open_decisions(v):
    """State of all decisions, where keys of even number end as claimed instead of final."""
    ends = (F.expr("CAST(substr(execution_key, 2) AS BIGINT) % 2 = 0")) & c("status").isin(*decisions.FINAL)
    events = v.decision_events.withColumns(
        {"status": F.when(ends, "claimed").otherwise(c("status")), "reason": F.when(~ends, c("reason"))})
    return decisions.decision_state(events)


ENDS_SQL = "CAST(substr(execution_key, 2) AS BIGINT) % 2 = 0 AND status IN ('executed', 'rejected')"
OPEN_SQL = STATE_SQL.replace(
    "FROM decision_events WHERE", f"FROM (SELECT * REPLACE (CASE WHEN {ENDS_SQL} THEN 'claimed' ELSE status END AS status, CASE WHEN NOT ({ENDS_SQL}) THEN reason END AS reason) FROM decision_events) q WHERE")
R.add(
    "W16_rank_groups", "execution_key:s, effective_status:s, status_rank:i, saved_delay_seconds:i", lambda v: decisions.rank_groups(open_groups(v), open_decisions(v), MIDDLE),
    f"""WITH {OPEN_SQL}, {GROUP_SQL}, e AS (SELECT g.*, CASE WHEN s.status IN ('executed', 'rejected') THEN s.status WHEN first_departure_at <= TIMESTAMP '{MIDDLE}' THEN 'expired' ELSE coalesce(s.status, 'new') END AS effective_status FROM grp g LEFT JOIN state s USING (execution_key))
SELECT *, list_position(['claimed', 'in_analysis', 'new', 'expired', 'rejected', 'executed'], effective_status) AS status_rank FROM e""",
    "decision_events",
)
R.add(
    "W18_recent_decisions", "execution_key:s, updated_at:t", lambda v: decisions.recent_decisions(decisions.decision_state(v.decision_events), "2024-01-03 00:00:00"),
    f"WITH {STATE_SQL} SELECT execution_key, occurred_at AS updated_at FROM state WHERE occurred_at >= TIMESTAMP '2024-01-02' ", "decision_events",
)
def _asked(v):
    """All decisions; every third names a group of an earlier prescription."""
    old = F.expr("CAST(substr(execution_key, 2) AS BIGINT) % 3 = 0")
    return decisions.decision_state(v.decision_events).withColumn("execution_key", F.when(old, F.concat("execution_key", F.lit("-old"))).otherwise(c("execution_key")))


R.add(
    "J22_validate_current_groups", "execution_key:s, status:s", lambda v: decisions.validate_current_groups(_asked(v), open_groups(v)),
    f"WITH {STATE_SQL}, {GROUP_SQL}, asked AS (SELECT CASE WHEN CAST(substr(execution_key, 2) AS BIGINT) % 3 = 0 THEN concat(execution_key, '-old') ELSE execution_key END AS execution_key, status FROM state) SELECT execution_key, status FROM asked WHERE execution_key IN (SELECT execution_key FROM grp)", "decision_events",
)


R.add(
    "A18_urgent_actions", "execution_key:s, vehicle_prefix:s, departure_at:t",
    lambda v: decisions.urgent_actions(v.commitments.withColumn("execution_key", F.concat(F.lit("G"), F.abs(F.floor(c("arrival_s") / 60)).cast("string"))), open_decisions(v)),
    f"""WITH {OPEN_SQL} SELECT execution_key, vehicle_prefix, departure_at FROM (SELECT *, concat('G', CAST(abs(CAST(floor(arrival_s / 60) AS BIGINT)) AS VARCHAR)) AS execution_key FROM commitments) x
 WHERE execution_key NOT IN (SELECT execution_key FROM state WHERE status IN ('executed', 'rejected')) ORDER BY departure_at, terminal_id, vehicle_prefix LIMIT 4""",
    "decision_events commitments",
)
R.add(
    "A15_prescription_kpis", "threatened_trips:i, pending_groups:i, recoverable_seconds:i",
    lambda v: fleet.prescription_kpis(v.commitments.withColumn("baseline_delay_seconds", F.greatest(F.lit(0), c("arrival_s") - c("departure_s"))), open_groups(v), open_decisions(v)),
    f"""WITH {OPEN_SQL}, {GROUP_SQL}, p AS (SELECT count(*) AS pending_groups, coalesce(sum(saved_delay_seconds), 0) AS recoverable_seconds FROM grp WHERE execution_key NOT IN (SELECT execution_key FROM state WHERE status IN ('executed', 'rejected')))
SELECT count(*) FILTER (arrival_s - departure_s > 600) AS threatened_trips, max(pending_groups) AS pending_groups, max(recoverable_seconds) AS recoverable_seconds FROM commitments, p""",
    "decision_events commitments",
)
