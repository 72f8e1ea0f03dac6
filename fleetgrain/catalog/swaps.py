"""Registered vehicle-swap queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.catalog.fleet import OPEN_SQL, open_decisions
from fleetgrain.catalog.scalars import _payload
from fleetgrain.catalog.views import AT
from fleetgrain.operators import decisions, fleet, swaps
from fleetgrain.session import materialize

R = Registry()
c = F.col
T = f"TIMESTAMP '{AT}'"


def _states(v):
    return v.states.select(
        "vehicle_prefix", "trip_id", F.concat(F.lpad((c("trip_id") % 24).cast("string"), 2, "0"), F.lit(":30")).alias("next_planned_time"),
        F.when(c("trip_id") % 9 > 0, F.concat(F.lit("T"), F.expr("substr(route_id, 2)"))).alias("next_trip_point"),
        F.lit("1").alias("next_schedule_position"), c("current_line").alias("next_line"), F.lit("0").alias("next_direction"), c("headsign").alias("next_trip_destination"))


def _snapshots(v):
    return v.snapshots.withColumn("payload", _payload(c("estimated_at"), F.lit(0.8), c("trip_id") % 5 > 0))


R.add(
    "J16_snapshot_commitments", "vehicle_prefix:s, current_trip_id:i, terminal_id:s, next_planned_time:s", lambda v: swaps.snapshot_commitments(_snapshots(v), _states(v)),
    "SELECT s.vehicle_prefix, s.trip_id AS current_trip_id, concat('T', substr(s.route_id, 2)) AS terminal_id, concat(lpad(CAST(s.trip_id % 24 AS VARCHAR), 2, '0'), ':30') AS next_planned_time FROM states s JOIN snapshots n ON n.vehicle_prefix = s.vehicle_prefix AND n.trip_id = s.trip_id WHERE s.trip_id % 9 > 0",
    "states snapshots",
)
R.add(
    "X01_commitments", "vehicle_prefix:s, terminal_id:s, arrival_at:t, departure_at:t, eta_reliability:f", lambda v: swaps.commitments(_snapshots(v), _states(v), AT),
    f"""WITH b AS (SELECT s.vehicle_prefix, concat('T', substr(s.route_id, 2)) AS terminal_id, n.estimated_at AS arrival_at, s.trip_id % 24 AS h FROM states s JOIN snapshots n ON n.vehicle_prefix = s.vehicle_prefix AND n.trip_id = s.trip_id
 WHERE s.trip_id % 9 > 0 AND n.generated_at >= {T} - INTERVAL 10 MINUTE AND s.trip_id % 5 > 0),
k AS (SELECT *, CAST(CAST({T} - INTERVAL 3 HOUR AS DATE) AS TIMESTAMP) + to_days(d) + to_hours(h) + INTERVAL 30 MINUTE AS w, d FROM b, (VALUES (-1), (0), (1)) AS o(d)),
r AS (SELECT *, row_number() OVER (PARTITION BY vehicle_prefix ORDER BY abs(epoch_us(w) - epoch_us({T} - INTERVAL 3 HOUR)), d) AS rn FROM k)
SELECT vehicle_prefix, terminal_id, arrival_at, w + INTERVAL 3 HOUR AS departure_at, 0.8 AS eta_reliability FROM r WHERE rn = 1""",
    "states snapshots",
)
R.add(
    "X01_prescription_status", "status:s, snapshot_generated_at:t, snapshot_age_seconds:f", lambda v: swaps.prescription_status(_snapshots(v), _states(v), AT),
    f"SELECT CASE WHEN max(n.generated_at) IS NULL THEN 'no_data' WHEN max(n.generated_at) < {T} - INTERVAL 10 MINUTE THEN 'stale' ELSE 'ready' END AS status, max(n.generated_at) AS snapshot_generated_at, epoch({T}) - epoch(max(n.generated_at)) AS snapshot_age_seconds FROM states s JOIN snapshots n ON n.vehicle_prefix = s.vehicle_prefix AND n.trip_id = s.trip_id WHERE s.trip_id % 9 > 0",
    "states snapshots",
)
R.add(
    "X02_protect", "vehicle_prefix:s, baseline_delay_seconds:i, protected:b", lambda v: swaps.protect(v.commitments, AT),
    "SELECT vehicle_prefix, greatest(0, arrival_s - departure_s) AS baseline_delay_seconds, departure_s BETWEEN 0 AND 600 AND arrival_s <= departure_s AS protected FROM commitments", "commitments",
)


def _neighbours(v):
    """Each commitment with itself and with the next vehicle of its terminal."""
    order = Window.partitionBy("terminal_id").orderBy("vehicle_prefix")
    mine = v.commitments.withColumn("n", F.lead(F.struct("vehicle_prefix", "arrival_at")).over(order))
    both = F.explode(F.array(F.struct("vehicle_prefix", "arrival_at"), c("n")))
    return mine.select("terminal_id", c("vehicle_prefix").alias("commitment_prefix"), "departure_at", both.alias("x")).filter("x IS NOT NULL").select(
        "terminal_id", "commitment_prefix", "departure_at", "x.vehicle_prefix", c("x.arrival_at").alias("vehicle_arrival_at"))


R.add(
    "X03_swap_costs", "commitment_prefix:s, vehicle_prefix:s, cost_delay:i, cost_delayed:i, cost_changed:i, cost_idle:i", lambda v: swaps.swap_costs(_neighbours(v)),
    """WITH n AS (SELECT *, lead(vehicle_prefix) OVER w AS nv, lead(arrival_s) OVER w AS na FROM commitments WINDOW w AS (PARTITION BY terminal_id ORDER BY vehicle_prefix)),
p AS (SELECT vehicle_prefix AS commitment_prefix, vehicle_prefix, arrival_s AS a, departure_s AS d FROM commitments UNION ALL SELECT vehicle_prefix, nv, na, departure_s FROM n WHERE nv IS NOT NULL)
SELECT commitment_prefix, vehicle_prefix, greatest(0, a - d) AS cost_delay, CASE WHEN a > d THEN 1 ELSE 0 END AS cost_delayed, CASE WHEN vehicle_prefix <> commitment_prefix THEN 1 ELSE 0 END AS cost_changed, least(86400, greatest(0, d - a)) AS cost_idle FROM p""",
    "commitments",
)
MATCH_SQL = """g AS (SELECT *, greatest(0, arrival_s - departure_s) AS base, departure_s BETWEEN 0 AND 600 AND arrival_s <= departure_s AS prot FROM commitments),
crit AS (SELECT terminal_id FROM g GROUP BY 1 HAVING max(base) > 600),
f AS (SELECT g.* FROM g JOIN crit USING (terminal_id) WHERE NOT prot),
m AS (SELECT a.terminal_id, sum(greatest(0, a.x - d.x)) AS best FROM (SELECT terminal_id, arrival_s AS x, row_number() OVER (PARTITION BY terminal_id ORDER BY arrival_s) AS n FROM f) a JOIN (SELECT terminal_id, departure_s AS x, row_number() OVER (PARTITION BY terminal_id ORDER BY departure_s) AS n FROM f) d ON a.terminal_id = d.terminal_id AND a.n = d.n GROUP BY 1)"""
R.add(
    "X04_assign_per_terminal", "terminal_id:s, vehicles:i, baseline_total:i, proposed_total:i, distinct_vehicles:i",
    lambda v: swaps.assignments(v.commitments, AT).groupBy("terminal_id").agg(
        F.count("*").alias("vehicles"), F.sum("baseline_delay_seconds").alias("baseline_total"), F.sum("proposed_delay_seconds").alias("proposed_total"), F.count_distinct("assigned_prefix").alias("distinct_vehicles")),
    f"WITH {MATCH_SQL} SELECT g.terminal_id, count(*) AS vehicles, sum(base) AS baseline_total, max(best) AS proposed_total, count(*) AS distinct_vehicles FROM g JOIN m USING (terminal_id) GROUP BY 1", "commitments",
)


def rotated(v):
    """A fixed plan: every vehicle of a terminal takes the trip before its own."""
    order = Window.partitionBy("terminal_id").orderBy("vehicle_prefix")
    base = swaps.protect(v.commitments, AT)
    following = F.lead(F.struct("vehicle_prefix", "arrival_at", "eta_reliability")).over(order)
    opening = F.first(F.struct("vehicle_prefix", "arrival_at", "eta_reliability")).over(order)
    planned = base.withColumn("n", F.coalesce(following, opening))
    return planned.select(
        *base.columns, c("n.vehicle_prefix").alias("assigned_prefix"), c("n.arrival_at").alias("assigned_arrival_at"), c("n.eta_reliability").alias("assigned_reliability"),
        (c("n.vehicle_prefix") != c("vehicle_prefix")).alias("changed"), swaps.delay_seconds(c("n.arrival_at"), c("departure_at")).alias("proposed_delay_seconds"))


ROT_SQL = """ro AS (SELECT *, coalesce(lead(vehicle_prefix) OVER w, first_value(vehicle_prefix) OVER w) AS av, coalesce(lead(arrival_s) OVER w, first_value(arrival_s) OVER w) AS aa, coalesce(lead(eta_reliability) OVER w, first_value(eta_reliability) OVER w) AS ar,
 row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY terminal_id) AS n FROM commitments WINDOW w AS (PARTITION BY terminal_id ORDER BY vehicle_prefix)),
rot AS (SELECT *, greatest(0, arrival_s - departure_s) AS base, greatest(0, aa - departure_s) AS prop FROM ro)"""
R.add(
    "X05_exchange_cycles", "terminal_id:s, vehicle_prefix:s, group_id:s, position:i, cycle_size:i", lambda v: swaps.exchange_cycles(rotated(v)),
    f"WITH {ROT_SQL} SELECT terminal_id, vehicle_prefix, concat(terminal_id, '-G01') AS group_id, position, n AS cycle_size FROM rot WHERE n > 1", "commitments",
)
R.add(
    "X05_solved_cycles", "terminal_id:s, group_id:s, vehicles:i, saved:i",
    lambda v: swaps.exchange_cycles(materialize(swaps.assign_per_terminal(v.commitments, AT))).groupBy("terminal_id", "group_id").agg(
        F.count("*").alias("vehicles"), F.sum(c("baseline_delay_seconds") - c("proposed_delay_seconds")).alias("saved")),
)
TOTALS_OUT = "terminal_id:s, baseline_total_delay_seconds:i, proposed_total_delay_seconds:i, saved_delay_seconds:i, baseline_delayed_trip_count:i, proposed_delayed_trip_count:i, baseline_max_delay_seconds:i, proposed_max_delay_seconds:i"
TOTALS_SQL = "SELECT terminal_id, sum(base) AS baseline_total_delay_seconds, sum(prop) AS proposed_total_delay_seconds, sum(base) - sum(prop) AS saved_delay_seconds, count(*) FILTER (base > 0) AS baseline_delayed_trip_count, count(*) FILTER (prop > 0) AS proposed_delayed_trip_count, max(base) AS baseline_max_delay_seconds, max(prop) AS proposed_max_delay_seconds, min(ar) AS minimum_eta_reliability, count(*) AS steps FROM rot GROUP BY 1"
R.add(
    "A23_plan_totals", f"{TOTALS_OUT}, minimum_eta_reliability:f", lambda v: swaps.plan_totals(rotated(v), ["terminal_id"]), f"WITH {ROT_SQL} {TOTALS_SQL}", "commitments",
)
R.add(
    "X06_prescription", f"{TOTALS_OUT}, groups:i, steps:i, first_step:s",
    lambda v: (lambda plan: swaps.prescription(plan, swaps.exchange_cycles(plan)).select(
        "*", F.coalesce(F.size("exchange_groups"), F.lit(0)).alias("groups"), F.size("assignments").alias("steps"), c("assignments")[0]["commitment_vehicle_prefix"].alias("first_step")))(rotated(v)),
    f"WITH {ROT_SQL}, t AS ({TOTALS_SQL}) SELECT t.*, CASE WHEN steps > 1 THEN 1 ELSE 0 END AS groups, (SELECT min(vehicle_prefix) FROM rot r WHERE r.terminal_id = t.terminal_id) AS first_step FROM t", "commitments",
)
R.add(
    "A17_top_terminals", "terminal_id:s, baseline_total_delay_seconds:i", lambda v: fleet.top_terminals(swaps.plan_totals(rotated(v), ["terminal_id"])),
    f"WITH {ROT_SQL} SELECT terminal_id, sum(base) AS baseline_total_delay_seconds FROM rot GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "commitments",
)


def _grouped(v):
    return rotated(v).filter("changed").select("terminal_id", "vehicle_prefix", F.concat("terminal_id", F.lit("-G01")).alias("group_id"), F.concat(F.lit("G"), F.expr("substr(terminal_id, 2)")).alias("execution_key"))


R.add(
    "W17_assignment_rows", "terminal_id:s, vehicle_prefix:s, group_id:s, decision_status:s, is_final:b", lambda v: decisions.assignment_rows(rotated(v), _grouped(v), open_decisions(v)),
    f"""WITH {OPEN_SQL}, {ROT_SQL} SELECT r.terminal_id, r.vehicle_prefix, concat(r.terminal_id, '-G01') AS group_id, s.status AS decision_status, coalesce(s.status IN ('executed', 'rejected'), false) AS is_final
 FROM rot r LEFT JOIN state s ON s.execution_key = concat('G', substr(r.terminal_id, 2)) WHERE r.n > 1""",
    "decision_events commitments",
)
