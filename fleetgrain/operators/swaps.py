"""Vehicle swaps per terminal: who should serve which departure.

Total delay is the sum of max(0, arrival - departure). Along the time axis
the running balance of arrivals minus departures fixes, at every instant, how
many pairs of an optimal plan span it and in which direction. Where the
balance is zero nothing spans it, so a terminal falls into independent
blocks. A block is the unit of work; a busy terminal becomes many of them,
and blocks in which every vehicle can simply keep its trip never leave the
JVM.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.functions.identity import execution_key
from fleetgrain.functions.status import DELAYED_SECONDS, SNAPSHOT_SECONDS, delay_seconds
from fleetgrain.functions.times import at_lit, elapsed_seconds, fresh, nearest_departure
from fleetgrain.operators.ordered import running_sum
from fleetgrain.session import materialize

PROTECTED_SECONDS = 600
IDLE_LIMIT_SECONDS = 86_400

TRIP_END = (
    "struct<complete:boolean,estimated_at:string,reliability:double,source_counts:map<string,int>>"
)
PAYLOAD = f"struct<future_time:struct<service:struct<trip_end:{TRIP_END}>>>"


def eta_payload_fields(payload: Column) -> Column:
    """Arrival, reliability and source counts of the future service trip end.

    Null when the estimate is incomplete or its time has no zone or no sense.
    """
    end = F.from_json(payload, PAYLOAD)["future_time"]["service"]["trip_end"]
    text = end["estimated_at"]
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$")
    arrival = F.when(zoned, text.try_cast("timestamp"))
    usable = F.coalesce(end["complete"], F.lit(False)) & arrival.isNotNull()
    return F.when(
        usable,
        F.struct(
            arrival.alias("arrival_at"),
            F.coalesce(end["reliability"], F.lit(0.0)).alias("eta_reliability"),
            F.coalesce(end["source_counts"], F.create_map().cast("map<string,int>")).alias("eta_source_counts"),
        ),
    )


def snapshot_commitments(snapshots: DataFrame, states: DataFrame) -> DataFrame:
    """Snapshots of the trip a vehicle is on, with its next departure and terminal."""
    upcoming = states.filter("next_planned_time IS NOT NULL AND next_trip_point IS NOT NULL").select(
        "vehicle_prefix", "trip_id", "next_planned_time", F.col("next_trip_point").alias("terminal_id"),
        "next_schedule_position", "next_line", "next_direction",
        F.col("next_trip_destination").alias("next_destination"),
    )
    made = snapshots.select(
        "vehicle_prefix", "trip_id", F.col("route_id").alias("current_route_id"), "generated_at", "payload"
    )
    return made.join(upcoming, ["vehicle_prefix", "trip_id"]).withColumnRenamed("trip_id", "current_trip_id")


def commitments(snapshots: DataFrame, states: DataFrame, at: Column | str) -> DataFrame:
    """Vehicles with a fresh complete ETA and a departure they are due for."""
    t = at_lit(at)
    rows = snapshot_commitments(snapshots, states).filter(fresh(F.col("generated_at"), t, SNAPSHOT_SECONDS))
    return (
        rows.withColumn("eta", eta_payload_fields(F.col("payload")))
        .withColumn("departure_at", nearest_departure(F.col("next_planned_time"), t))
        .filter("eta IS NOT NULL AND departure_at IS NOT NULL")
        .select(
            "vehicle_prefix", "terminal_id", "eta.arrival_at", "departure_at", "current_trip_id",
            "current_route_id", "next_line", "next_direction", "next_destination",
            "next_schedule_position", "eta.eta_reliability", "eta.eta_source_counts", "generated_at",
        )
    )


def prescription_status(snapshots: DataFrame, states: DataFrame, at: Column | str) -> DataFrame:
    """no_data, stale or ready, with the newest snapshot and its age."""
    t = at_lit(at)
    newest = snapshot_commitments(snapshots, states).agg(F.max("generated_at").alias("snapshot_generated_at"))
    made = F.col("snapshot_generated_at")
    age = F.greatest(F.lit(0.0), elapsed_seconds(t, made))
    return newest.select(
        F.when(made.isNull(), "no_data").when(~fresh(made, t, SNAPSHOT_SECONDS), "stale").otherwise("ready").alias("status"),
        t.alias("evaluated_at"), made, F.when(made.isNotNull(), age).alias("snapshot_age_seconds"),
    )


def baseline_delay() -> Column:
    return delay_seconds(F.col("arrival_at"), F.col("departure_at"))


def protect(rows: DataFrame, at: Column | str) -> DataFrame:
    """Adds baseline delay and whether the vehicle keeps its imminent on-time trip."""
    until = elapsed_seconds(F.col("departure_at"), at_lit(at))
    return rows.withColumn("baseline_delay_seconds", baseline_delay()).withColumn(
        "protected", until.between(0, PROTECTED_SECONDS) & (F.col("baseline_delay_seconds") == 0)
    )


def swap_costs(pairs: DataFrame) -> DataFrame:
    """The four cost parts of (vehicle, commitment) pairs, compared in this order.

    Apart they stay small integers; packed into one number they would need
    more than 64 bits for a large terminal.
    """
    late = delay_seconds(F.col("vehicle_arrival_at"), F.col("departure_at"))
    wait = F.greatest(F.lit(0), F.bround(elapsed_seconds(F.col("departure_at"), F.col("vehicle_arrival_at"))))
    return (
        pairs.withColumn("cost_delay", late)
        .withColumn("cost_delayed", (F.col("cost_delay") > 0).cast("int"))
        .withColumn("cost_changed", (F.col("vehicle_prefix") != F.col("commitment_prefix")).cast("int"))
        .withColumn("cost_idle", F.least(wait, F.lit(IDLE_LIMIT_SECONDS)).cast("long"))
    )


def terminal_blocks(rows: DataFrame) -> DataFrame:
    """Time points of each terminal with balance and block number.

    Events are counted per (terminal, second) before any ordering; running
    sums go through hour chunks, so one terminal may fill many tasks.
    """
    key = "terminal_id"
    arrivals = rows.select(key, F.col("arrival_s").alias("t"), F.lit(1).alias("p"), F.lit(0).alias("q"))
    departures = rows.select(key, F.col("departure_s").alias("t"), F.lit(0).alias("p"), F.lit(1).alias("q"))
    points = arrivals.unionByName(departures).groupBy(key, "t").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q")
    ).withColumn("_chunk", F.floor(F.col("t") / 3600))
    balanced = materialize(running_sum(points, [key], "_chunk", ["t"], F.col("p") - F.col("q"), "balance"))
    closes = (F.col("balance") == 0).cast("int")
    numbered = running_sum(balanced, [key], "_chunk", ["t"], closes, "closed")
    return numbered.select(key, "t", "balance", (F.col("closed") - closes).alias("block"))


def _keep_most(start: np.ndarray, end: np.ndarray, capacity: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Largest set of intervals under per-edge and per-start capacities.

    Sweeps the edges; wherever too many intervals are open, the one reaching
    furthest is given up.
    """
    keep = np.ones(len(start), dtype=bool)
    ending = np.zeros(len(capacity) + 1, dtype=np.int64)
    by_start = np.lexsort((end, start))
    heap: list[tuple[int, int]] = []
    open_count, i = 0, 0
    for edge in range(len(capacity)):
        open_count -= ending[edge]
        admitted = 0
        while i < len(by_start) and start[by_start[i]] == edge:
            item = by_start[i]
            i += 1
            if admitted >= opening[edge]:
                keep[item] = False
                continue
            admitted += 1
            open_count += 1
            ending[end[item]] += 1
            heapq.heappush(heap, (-int(end[item]), int(item)))
        while open_count > capacity[edge]:
            reach, item = heapq.heappop(heap)
            keep[item] = False
            ending[-reach] -= 1
            open_count -= 1
        if not open_count:
            heap.clear()
    return keep


def solve_block(arrivals: dict[str, int], departures: dict[str, int]) -> list[tuple[str, str]]:
    """(commitment vehicle, assigned vehicle) pairs of one block.

    Least total delay first, then fewest late trips, then fewest changes. Any
    pairing that respects the balance has the same delay and idle time; what
    remains is to meet as many same-second departures as possible while late
    and to leave as many vehicles as possible on their own trip.
    """
    times = np.unique(np.fromiter((*arrivals.values(), *departures.values()), dtype=np.int64))
    index = {int(t): k for k, t in enumerate(times)}
    n = len(times)
    p, q = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for t in arrivals.values():
        p[index[t]] += 1
    for t in departures.values():
        q[index[t]] += 1
    balance = np.cumsum(p - q)
    before = np.concatenate(([0], balance[:-1]))
    own = sorted(v for v in arrivals if v in departures)
    kept = {v for v in own if arrivals[v] == departures[v]}
    unlimited = np.full(n, len(arrivals) + 1, dtype=np.int64)

    # while late on both sides of an instant, its own departures come first
    tied = (before < 0) & (balance < 0) & (p > 0) & (q > 0)
    opening = np.where(tied, np.maximum(q - p, 0), unlimited)
    closing = np.where(tied, np.maximum(p - q, 0), unlimited)

    late = [v for v in own if arrivals[v] > departures[v]]
    by_end: dict[int, list[str]] = {}
    for v in late:
        by_end.setdefault(index[arrivals[v]], []).append(v)
    late = [
        v
        for k, vehicles in by_end.items()
        for v in sorted(vehicles, key=lambda x: (-departures[x], x))[: int(closing[k])]
    ]
    early = [v for v in own if arrivals[v] < departures[v]]
    for vehicles, first, last, sign, limits in (
        (late, departures, arrivals, -1, opening),
        (early, arrivals, departures, 1, unlimited),
    ):
        if vehicles:
            start = np.array([index[first[v]] for v in vehicles])
            end = np.array([index[last[v]] for v in vehicles])
            keep = _keep_most(start, end, np.maximum(sign * balance, 0), limits)
            kept |= {v for v, k in zip(vehicles, keep) if k}

    pairs = [(v, v) for v in kept]
    coming: list[list[str]] = [[] for _ in range(n)]
    leaving: list[list[str]] = [[] for _ in range(n)]
    for v, t in sorted(arrivals.items()):
        if v not in kept:
            coming[index[t]].append(v)
    for v, t in sorted(departures.items()):
        if v not in kept:
            leaving[index[t]].append(v)
    idle: list[str] = []
    waiting: list[str] = []
    for here, due in zip(coming, leaving):
        if idle:
            idle += here
            here = []
            while due and idle:
                pairs.append((due.pop(0), idle.pop(0)))
        while due and here:
            pairs.append((due.pop(0), here.pop(0)))
        while waiting and here:
            pairs.append((waiting.pop(0), here.pop(0)))
        idle += here
        waiting += due
    return pairs


def _solve_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Solve block after block of a partition sorted by terminal and block.

    Only the block at hand is held; its rows may span Arrow batches.
    """
    current: tuple[str, int] | None = None
    ends: dict[str, dict[str, int]] = {"arrival": {}, "departure": {}}

    def solved() -> list[tuple[str, str, str]]:
        if current is None:
            return []
        return [(current[0], *pair) for pair in solve_block(ends["arrival"], ends["departure"])]

    for frame in frames:
        out: list[tuple[str, str, str]] = []
        rows = zip(frame["terminal_id"], frame["block"], frame["kind"], frame["t"], frame["vehicle_prefix"])
        for terminal, block, kind, t, vehicle in rows:
            if current != (terminal, block):
                out += solved()
                current = (terminal, block)
                ends = {"arrival": {}, "departure": {}}
            ends[kind][vehicle] = int(t)
        yield pd.DataFrame(out, columns=_SOLVED)
    yield pd.DataFrame(solved(), columns=_SOLVED)


_SOLVED = ["terminal_id", "vehicle_prefix", "assigned_prefix"]


def assignments(rows: DataFrame, at: Column | str) -> DataFrame:
    """Optimal vehicle per commitment in terminals with a trip over ten minutes late."""
    guarded = protect(rows, at)
    critical = guarded.groupBy("terminal_id").agg(F.max("baseline_delay_seconds").alias("worst")).filter(
        F.col("worst") > DELAYED_SECONDS
    )
    seconds = lambda c: F.bround(F.unix_micros(c) / 1_000_000.0).cast("long")
    scoped = guarded.join(critical, "terminal_id", "left_semi").withColumn(
        "arrival_s", seconds("arrival_at")
    ).withColumn("departure_s", seconds("departure_at"))
    # steps that several others read are stored, so that no task sorts for all of them at once
    free = materialize(scoped.filter(~F.col("protected")).select("terminal_id", "vehicle_prefix", "arrival_s", "departure_s"))
    points = materialize(terminal_blocks(free).select("terminal_id", "t", "block"))
    placed = (
        free.join(points.select("terminal_id", F.col("t").alias("arrival_s"), F.col("block").alias("arrival_block")), ["terminal_id", "arrival_s"])
        .join(points.select("terminal_id", F.col("t").alias("departure_s"), F.col("block").alias("departure_block")), ["terminal_id", "departure_s"])
    )
    stays = (F.col("arrival_s") <= F.col("departure_s")) & (F.col("arrival_block") == F.col("departure_block"))
    ends = materialize(placed.select(
        "terminal_id", "vehicle_prefix", stays.alias("stays"),
        F.explode(
            F.array(
                F.struct(F.lit("arrival").alias("kind"), F.col("arrival_s").alias("t"), F.col("arrival_block").alias("block")),
                F.struct(F.lit("departure").alias("kind"), F.col("departure_s").alias("t"), F.col("departure_block").alias("block")),
            )
        ).alias("e"),
    ).select("terminal_id", "vehicle_prefix", "stays", "e.*"))
    # a block whose vehicles are all on time inside it needs no change
    quiet = ends.groupBy("terminal_id", "block").agg(F.min("stays").alias("quiet"))
    joined = ends.join(quiet, ["terminal_id", "block"])
    unchanged = joined.filter("quiet AND kind = 'departure'").select(
        "terminal_id", "vehicle_prefix", F.col("vehicle_prefix").alias("assigned_prefix")
    )
    solved = (
        joined.filter("NOT quiet")
        .select("terminal_id", "block", "kind", "t", "vehicle_prefix")
        .repartition("terminal_id", "block")
        .sortWithinPartitions("terminal_id", "block")
        .mapInPandas(_solve_sorted, "terminal_id string, vehicle_prefix string, assigned_prefix string")
    )
    kept = scoped.filter("protected").select(
        "terminal_id", "vehicle_prefix", F.col("vehicle_prefix").alias("assigned_prefix")
    )
    chosen = materialize(unchanged.unionByName(solved).unionByName(kept))
    vehicles = guarded.select(
        "terminal_id", F.col("vehicle_prefix").alias("assigned_prefix"),
        F.col("arrival_at").alias("assigned_arrival_at"),
        F.col("eta_reliability").alias("assigned_reliability"),
        *([F.col("eta_source_counts").alias("assigned_source_counts")] if "eta_source_counts" in rows.columns else []),
    )
    return (
        scoped.drop("arrival_s", "departure_s")
        .join(chosen, ["terminal_id", "vehicle_prefix"])
        .join(vehicles, ["terminal_id", "assigned_prefix"])
        .withColumn("changed", F.col("vehicle_prefix") != F.col("assigned_prefix"))
        .withColumn(
            "proposed_delay_seconds", delay_seconds(F.col("assigned_arrival_at"), F.col("departure_at"))
        )
        .withColumn(
            "assigned_margin_seconds",
            F.bround(elapsed_seconds(F.col("departure_at"), F.col("assigned_arrival_at"))).cast("long"),
        )
    )


def _totals() -> list[Column]:
    base, new = F.col("baseline_delay_seconds"), F.col("proposed_delay_seconds")
    return [
        F.sum(base).alias("baseline_total_delay_seconds"),
        F.sum(new).alias("proposed_total_delay_seconds"),
        F.sum(base - new).alias("saved_delay_seconds"),
        F.count_if(base > 0).alias("baseline_delayed_trip_count"),
        F.count_if(new > 0).alias("proposed_delayed_trip_count"),
        F.max(base).alias("baseline_max_delay_seconds"),
        F.max(new).alias("proposed_max_delay_seconds"),
    ]


def plan_totals(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Delay totals per terminal or per exchange group."""
    return assigned.groupBy(*keys).agg(
        *_totals(), F.min("assigned_reliability").alias("minimum_eta_reliability"),
        F.count("*").alias("vehicle_count"),
    )


def worthwhile(assigned: DataFrame) -> DataFrame:
    """Assignments of terminals where a critical trip improves and delay is saved."""
    target = (
        (F.col("baseline_delay_seconds") > DELAYED_SECONDS)
        & (F.col("proposed_delay_seconds") < F.col("baseline_delay_seconds"))
        & F.col("changed")
    )
    good = assigned.groupBy("terminal_id").agg(
        F.sum(F.col("baseline_delay_seconds") - F.col("proposed_delay_seconds")).alias("saved"),
        F.max(target).alias("target"),
    ).filter("saved > 0 AND target")
    return assigned.join(good, "terminal_id", "left_semi")


def assign_per_terminal(rows: DataFrame, at: Column | str) -> DataFrame:
    return worthwhile(assignments(rows, at))


def exchange_cycles(assigned: DataFrame) -> DataFrame:
    """Changed assignments with group id, position and vehicle count of their cycle.

    Cycle labels come from pointer doubling: each round looks twice as far
    along the cycle, so a cycle of n vehicles needs log2(n) joins and no
    terminal is gathered anywhere. Rounds are checkpointed to cut lineage.
    """
    links = assigned.filter("changed").select(
        "terminal_id", "vehicle_prefix", F.col("assigned_prefix").alias("next"),
        F.least("vehicle_prefix", "assigned_prefix").alias("label"),
        F.when(F.col("vehicle_prefix") < F.col("assigned_prefix"), 0).otherwise(1).cast("long").alias("offset"),
    )
    links = materialize(links)
    reach = 1
    while True:
        ahead = links.select(
            "terminal_id", F.col("vehicle_prefix").alias("next"), F.col("next").alias("_next"),
            F.col("label").alias("_label"), (F.col("offset") + reach).alias("_offset"),
        )
        joined = links.join(ahead, ["terminal_id", "next"])
        further = F.col("_label") < F.col("label")
        stepped = materialize(joined.select(
            "terminal_id", "vehicle_prefix", F.col("_next").alias("next"),
            F.when(further, F.col("_label")).otherwise(F.col("label")).alias("label"),
            F.when(further, F.col("_offset")).otherwise(F.col("offset")).alias("offset"),
            further.alias("moved"),
        ))
        reach *= 2
        links = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            break
    cycles = links.groupBy("terminal_id", "label").agg(F.count("*").alias("cycle_size"))
    order = Window.partitionBy("terminal_id").orderBy("label")
    named = cycles.withColumn(
        "group_id",
        F.format_string("%s-G%02d", F.col("terminal_id"), F.row_number().over(order)),
    )
    placed = links.join(named, ["terminal_id", "label"]).select(
        "terminal_id", "vehicle_prefix", "group_id", "cycle_size",
        F.pmod(F.col("cycle_size") - F.col("offset"), F.col("cycle_size")).alias("position"),
    )
    return assigned.join(placed, ["terminal_id", "vehicle_prefix"])


def group_keys(grouped: DataFrame) -> DataFrame:
    """Execution key per exchange group, over its steps in cycle order."""
    step = F.struct(
        "position", F.col("vehicle_prefix").alias("commitment"),
        F.col("assigned_prefix").alias("assigned"), "departure_at",
    )
    return grouped.groupBy("terminal_id", "group_id").agg(
        F.sort_array(F.collect_list(step)).alias("steps")
    ).select("terminal_id", "group_id", execution_key(F.col("terminal_id"), F.col("steps")).alias("execution_key"))


_STEP = (
    "departure_at", "arrival_at", "assigned_arrival_at", "assigned_margin_seconds",
    "next_line", "next_direction", "next_destination", "next_schedule_position",
    "baseline_delay_seconds", "proposed_delay_seconds", "assigned_reliability", "assigned_source_counts",
    "protected", "changed",
)


def _in_order(items: Column, field: str) -> Column:
    """Structs with map fields have no order of their own; sort by one field."""
    return F.array_sort(
        items,
        lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0),
    )


def prescription(assigned: DataFrame, grouped: DataFrame) -> DataFrame:
    """One nested plan per terminal: totals, exchange groups with steps, assignments."""
    reduction = (F.col("baseline_delay_seconds") - F.col("proposed_delay_seconds")).alias("delay_reduction_seconds")

    def step(df: DataFrame, *lead: str) -> Column:
        present = [c for c in _STEP if c in df.columns]
        return F.struct(
            *lead, F.col("vehicle_prefix").alias("commitment_vehicle_prefix"),
            F.col("assigned_prefix").alias("assigned_vehicle_prefix"), *present, reduction,
        )

    totals = plan_totals(grouped, ["terminal_id", "group_id"])
    steps = grouped.groupBy("terminal_id", "group_id").agg(
        _in_order(F.collect_list(step(grouped, "position")), "position").alias("steps")
    )
    groups = totals.join(steps, ["terminal_id", "group_id"]).join(
        group_keys(grouped), ["terminal_id", "group_id"]
    )
    per_terminal = groups.groupBy("terminal_id").agg(
        _in_order(
            F.collect_list(
                F.struct(
                    "group_id", "execution_key", "vehicle_count", "baseline_total_delay_seconds",
                    "proposed_total_delay_seconds", "saved_delay_seconds", "baseline_max_delay_seconds",
                    "proposed_max_delay_seconds", "minimum_eta_reliability", "steps",
                )
            ),
            "group_id",
        ).alias("exchange_groups")
    )
    listed = assigned.groupBy("terminal_id").agg(
        _in_order(F.collect_list(step(assigned)), "commitment_vehicle_prefix").alias("assignments")
    )
    return (
        plan_totals(assigned, ["terminal_id"])
        .drop("minimum_eta_reliability", "vehicle_count")
        .join(per_terminal, "terminal_id", "left")
        .join(listed, "terminal_id")
    )


def prescription_summary(plans: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts over the whole prescription."""
    vehicles = rows.agg(
        F.count("*").alias("eligible_vehicle_count"), F.count_distinct("terminal_id").alias("terminal_count")
    )
    totals = plans.agg(
        F.count("*").alias("plan_count"),
        F.coalesce(F.sum("saved_delay_seconds"), F.lit(0)).alias("total_saved_delay_seconds"),
    )
    packed = totals.select(F.struct("plan_count", "total_saved_delay_seconds"))
    return vehicles.withColumn("t", packed.scalar()).select(
        "eligible_vehicle_count", "terminal_count", "t.plan_count", "t.total_saved_delay_seconds"
    )
