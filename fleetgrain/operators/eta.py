"""Vehicle arrival estimates composed from segment estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.functions.binding import let
from fleetgrain.functions.status import (
    POSITION_SECONDS,
    SIGNAL_SECONDS,
    SNAPSHOT_SECONDS,
    SOURCES,
    eta_block_reason,
    fully_projected,
)
from fleetgrain.functions.times import (
    WINDOW_MICROS,
    at_lit,
    fresh,
    planned_trip_end,
)
from fleetgrain.operators.estimates import catalog_resolve
from fleetgrain.operators.metrics import LIVE_SECONDS
from fleetgrain.operators.samples import metric_identities
from fleetgrain.operators.timetable import TRIP, next_stop_pairs
from fleetgrain.session import materialize, small_side

STATE = ["vehicle_prefix"]


def eligible_for_eta(states: DataFrame, at: Column | str) -> DataFrame:
    """Adds `eta_reason`, null for vehicles that can get an ETA."""
    return states.withColumn("eta_reason", eta_block_reason(at_lit(at)))


def remaining_segments(states: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Segments from the current origin to the terminal, for vehicles that allow it.

    A vehicle is left out when the pair around it is not the current segment,
    when that pair has no usable progress, or when two timed stops ahead share
    an id. One window over the timetable pairs stops; a second over the
    vehicle's rows judges it.
    """
    needed = [
        "vehicle_prefix", *TRIP, "route_id", "direction_id", "shape_progress_m",
        "current_origin_stop_sequence", "current_destination_stop_sequence",
    ]
    pairs = next_stop_pairs(stop_times)
    ahead = states.select(*needed).join(pairs, TRIP).filter(
        "origin_stop_sequence >= current_origin_stop_sequence"
    )
    first = F.col("origin_stop_sequence") == F.col("current_origin_stop_sequence")
    starts_well = first & (F.col("destination_stop_sequence") == F.col("current_destination_stop_sequence")) & (
        F.col("destination_shape_progress_m") > F.col("origin_shape_progress_m")
    )
    timed = F.col("destination_arrival_seconds") > F.col("origin_departure_seconds")
    same_stop = F.col("origin_stop_id") == F.col("destination_stop_id")
    vehicle = Window.partitionBy("vehicle_prefix")
    judged = ahead.select(
        "*",
        F.max(F.coalesce(starts_well, F.lit(False))).over(vehicle).alias("_starts"),
        F.max(F.coalesce(same_stop & timed, F.lit(False))).over(vehicle).alias("_broken"),
        F.max_by("destination_stop_id", "destination_stop_sequence").over(vehicle).alias("terminal_stop_id"),
        F.max_by("destination_arrival_seconds", "destination_stop_sequence").over(vehicle).alias(
            "terminal_arrival_seconds"
        ),
    )
    along = (F.col("destination_shape_progress_m") - F.col("shape_progress_m")) / (
        F.col("destination_shape_progress_m") - F.col("origin_shape_progress_m")
    )
    kept = judged.filter(F.col("_starts") & ~F.col("_broken") & ~same_stop)
    return kept.select(
        *needed, "origin_stop_id", "destination_stop_id", "origin_stop_sequence", "destination_stop_sequence",
        F.when(first, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))).otherwise(F.lit(1.0)).alias(
            "remaining_fraction"
        ),
        F.when(timed, (F.col("destination_arrival_seconds") - F.col("origin_departure_seconds")).cast("double")).alias(
            "planned_duration_seconds"
        ),
        "terminal_stop_id", "terminal_arrival_seconds",
    )


def located_planned_segments(states: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned segments still ahead, located by sequences, else progress, else the start.

    Vehicles at or past the end come back as one row with `arrived` true;
    vehicles that cannot be located are left out.
    """
    rows = states.join(planned, TRIP)
    vehicle = Window.partitionBy("vehicle_prefix")
    sequence, progress = F.col("origin_stop_sequence"), F.col("shape_progress_m")
    by_sequence = F.when(
        (sequence == F.col("current_origin_stop_sequence"))
        & (F.col("destination_stop_sequence") == F.col("current_destination_stop_sequence")),
        sequence,
    )
    by_progress = F.when(
        (F.col("origin_progress_m") <= progress) & (progress < F.col("destination_progress_m")), sequence
    )
    first = F.min_by("origin_progress_m", "origin_stop_sequence").over(vehicle)
    last_end = F.max_by("destination_progress_m", "origin_stop_sequence").over(vehicle)
    located = F.coalesce(
        F.min(by_sequence).over(vehicle),
        F.min(by_progress).over(vehicle),
        F.when(progress < first, F.min(sequence).over(vehicle)),
    )
    judged = rows.withColumn("_from", located).withColumn("_end", last_end).withColumn(
        "_first", F.min(sequence).over(vehicle)
    )
    arrived = F.col("_from").isNull() & (progress >= F.col("_end"))
    along = (F.col("destination_progress_m") - progress) / (
        F.col("destination_progress_m") - F.col("origin_progress_m")
    )
    return (
        judged.withColumn("arrived", F.coalesce(arrived, F.lit(False)))
        .filter((sequence >= F.col("_from")) | (F.col("arrived") & (sequence == F.col("_first"))))
        .withColumn(
            "remaining_fraction",
            F.when(F.col("arrived"), F.lit(0.0))
            .when(sequence == F.col("_from"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
            .otherwise(F.lit(1.0)),
        )
        .drop("_from", "_end", "_first")
    )


def _scoped(segments: DataFrame, dealt: bool = True) -> DataFrame:
    """Each remaining segment once per scope; route and direction come from the state.

    Rows are dealt by vehicle before they get their keys, if what follows is by vehicle.
    """
    rows = segments.repartition(*STATE) if dealt else segments
    return metric_identities(
        rows.withColumn("trip_route_id", F.col("route_id")).withColumn("trip_direction_id", F.col("direction_id"))
    )


def resolve_remaining(segments: DataFrame, catalog: DataFrame, at: Column | str) -> DataFrame:
    """Remaining segments resolved at `at` for both scopes."""
    def timed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("estimate_at", at_lit(at))

    return catalog_resolve(timed(_scoped(segments)), catalog, timed(_scoped(segments, dealt=False)))


def eta_current_time(resolved: DataFrame) -> DataFrame:
    """Totals per vehicle and scope with every segment taken at the query time.

    Summing stops at the first unavailable segment; an incomplete trip has no
    total and names the missing pair.
    """
    key = ["vehicle_prefix", "scope"]
    order = Window.partitionBy(*key).orderBy("origin_stop_sequence")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    available = (F.col("estimate.source") != "unavailable") & F.col("estimate.value_seconds").isNotNull()
    df = resolved.withColumn("_ok", available).withColumn("_run", F.min("_ok").over(upto))
    seconds = F.when(F.col("_run"), F.col("estimate.value_seconds") * F.col("remaining_fraction"))
    source = F.when(F.col("_run"), F.col("estimate.source"))
    df = df.withColumn("_s", seconds)
    first = F.struct("_s", "estimate.reliability", "_ok", "origin_stop_id", "destination_stop_id", source.alias("source"))
    missing = F.when(~F.col("_ok"), F.col("origin_stop_sequence"))
    out = df.groupBy(*key).agg(
        F.sum("_s").alias("_total"),
        F.sum(F.col("_s") * F.col("estimate.reliability")).alias("_weighted"),
        F.count_if("_run").alias("segments_covered"),
        F.count("*").alias("segments_total"),
        *[F.count_if(F.coalesce(source == name, F.lit(False))).alias(f"count_{name}") for name in SOURCES],
        F.min_by(first, "origin_stop_sequence").alias("first"),
        F.min_by(F.struct("origin_stop_id", "destination_stop_id"), missing).alias("missing"),
    )
    complete = F.col("segments_covered") == F.col("segments_total")
    return out.select(
        *key,
        F.when(complete, F.col("_total")).alias("value_seconds"),
        F.when(F.col("_total") > 0, F.col("_weighted") / F.col("_total")).otherwise(F.lit(0.0)).alias("reliability"),
        "segments_covered", "segments_total", *[f"count_{n}" for n in SOURCES],
        complete.alias("complete"),
        F.when(~complete, F.col("missing.origin_stop_id")).alias("missing_origin_stop_id"),
        F.when(~complete, F.col("missing.destination_stop_id")).alias("missing_destination_stop_id"),
        F.when(F.col("first._ok"), F.col("first._s")).alias("next_stop_seconds"),
        F.when(F.col("first._ok"), F.col("first.reliability")).otherwise(F.lit(0.0)).alias("next_stop_reliability"),
        F.when(F.col("first._ok"), F.col("first.source")).alias("next_stop_source"),
        F.col("first.origin_stop_id").alias("next_origin_stop_id"),
        F.col("first.destination_stop_id").alias("next_stop_id"),
    )


CHOICE = "struct<v:double,r:double,s:string>"


def _choice(value: Column, reliability: Column, source: Column) -> Column:
    return F.struct(
        value.cast("double").alias("v"), reliability.cast("double").alias("r"), source.alias("s")
    )


def reachable_candidates(segments: DataFrame, catalog: DataFrame, at: Column | str) -> DataFrame:
    """Per segment and scope: live candidate and the best other one per slot.

    The slots a segment can be reached in follow from the data: the travel
    time before it is at most the sum of the largest candidates of the
    segments ahead of it. Only those slots are resolved, each (key, slot)
    once for the whole fleet, and a key's slots go to its segments as one map;
    no horizon is guessed and nothing is cut off.
    """
    scoped = _scoped(segments).withColumn("at", at_lit(at))
    largest = catalog.groupBy("metric_key").agg(F.max("value_seconds").alias("_largest"))
    live = catalog.filter("source = 'live'").groupBy("metric_key").agg(
        F.max_by(
            F.struct("value_seconds", "reliability", F.unix_micros("window_end").alias("end_micros")), "window_end"
        ).alias("live")
    )
    measured = small_side(materialize(largest.join(live, "metric_key", "left")), 192)
    df = scoped.join(measured, "metric_key", "left")
    worst = F.greatest(F.coalesce("_largest", F.lit(0.0)), F.coalesce("planned_duration_seconds", F.lit(0.0)))
    order = Window.partitionBy("vehicle_prefix", "scope").orderBy("origin_stop_sequence")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(
        "_ahead", F.coalesce(F.sum(worst * F.col("remaining_fraction")).over(before), F.lit(0.0))
    )
    now = F.floor(F.unix_micros("at") / WINDOW_MICROS)
    last = F.floor((F.unix_micros("at") + F.col("_ahead") * 1e6 + 1) / WINDOW_MICROS)
    # all segments start from the same moment, so the slots of a key are one run of them; read twice below
    reach = materialize(df.groupBy("metric_key").agg(F.min(now).alias("_now"), F.max(last).alias("_last")))
    asked = reach.select("metric_key", F.explode(F.sequence("_now", "_last")).alias("slot")).select(
        "*", F.timestamp_micros(F.col("slot") * WINDOW_MICROS).alias("estimate_at"),
        F.lit(None).cast("double").alias("planned_duration_seconds"),
    )
    resolved = catalog_resolve(asked, catalog.filter("source <> 'live'")).filter(
        "estimate.source <> 'unavailable'"
    )
    best = resolved.select(
        "metric_key", "slot",
        _choice(F.col("estimate.value_seconds"), F.col("estimate.reliability"), F.col("estimate.source")).alias("best"),
    )
    maps = materialize(best.groupBy("metric_key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("slots")))
    found = maps.agg(F.coalesce(F.sum(F.size("slots")), F.lit(0)), F.count("*")).first()
    width = 96 + 48 * -(-found[0] // max(found[1], 1))
    return df.drop("_largest", "_ahead").join(small_side(maps, width), "metric_key", "left")


def _by_sequence(a: Column, b: Column) -> Column:
    return a["origin_stop_sequence"] - b["origin_stop_sequence"]


def eta_future_time(candidates: DataFrame) -> DataFrame:
    """Totals per vehicle and scope with each segment taken when it is reached.

    A fold over the ordered segments of one trip: the cursor moves by each
    estimate, and live metrics age along the way.
    """
    key = ["vehicle_prefix", "scope"]
    slots = F.coalesce("slots", F.create_map().cast(f"map<bigint,{CHOICE}>"))
    packed = candidates.groupBy(*key).agg(
        F.first(F.unix_micros("at")).alias("at_micros"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    "origin_stop_sequence", F.col("remaining_fraction").alias("fraction"), "live",
                    slots.alias("slots"), F.col("planned_duration_seconds").alias("own"),
                    "origin_stop_id", "destination_stop_id",
                )
            ),
            _by_sequence,
        ).alias("segments"),
    )

    def estimate(segment: Column, cursor: Column) -> Column:
        live, own = segment["live"], segment["own"]
        young = live.isNotNull() & (cursor - live["end_micros"] <= LIVE_SECONDS * 1_000_000)
        best = F.try_element_at(segment["slots"], F.floor(cursor / WINDOW_MICROS))
        return (
            F.when(young, _choice(live["value_seconds"], live["reliability"], F.lit("live")))
            .when(best.isNotNull(), best)
            .when(own.isNotNull(), _choice(own, F.lit(1.0), F.lit("gtfs_planned")))
        )

    nothing = F.lit(None)
    start = F.struct(
        F.col("at_micros").alias("cursor"), F.lit(0.0).alias("total"), F.lit(0.0).alias("weighted"),
        F.lit(0).alias("covered"), *[F.lit(0).alias(n) for n in SOURCES],
        F.lit(False).alias("stopped"),
        nothing.cast("double").alias("next_seconds"), F.lit(0.0).alias("next_reliability"),
        nothing.cast("string").alias("next_source"),
        nothing.cast("string").alias("missing_origin"), nothing.cast("string").alias("missing_destination"),
    )

    def step(state: Column, segment: Column) -> Column:
        def advance(e: Column) -> Column:
            usable = ~state["stopped"] & e.isNotNull()
            fails = ~state["stopped"] & e.isNull()
            seconds = F.when(usable, e["v"] * segment["fraction"]).otherwise(F.lit(0.0))
            opening = usable & (state["covered"] == 0)
            return F.struct(
                (state["cursor"] + F.bround(seconds * 1e6).cast("long")).alias("cursor"),
                (state["total"] + seconds).alias("total"),
                (state["weighted"] + seconds * F.coalesce(e["r"], F.lit(0.0))).alias("weighted"),
                (state["covered"] + usable.cast("int")).alias("covered"),
                *[
                    (state[n] + F.coalesce(usable & (e["s"] == n), F.lit(False)).cast("int")).alias(n)
                    for n in SOURCES
                ],
                (state["stopped"] | fails).alias("stopped"),
                F.when(opening, seconds).otherwise(state["next_seconds"]).alias("next_seconds"),
                F.when(opening, e["r"]).otherwise(state["next_reliability"]).alias("next_reliability"),
                F.when(opening, e["s"]).otherwise(state["next_source"]).alias("next_source"),
                F.when(fails, segment["origin_stop_id"]).otherwise(state["missing_origin"]).alias("missing_origin"),
                F.when(fails, segment["destination_stop_id"])
                .otherwise(state["missing_destination"])
                .alias("missing_destination"),
            )

        return let(estimate(segment, state["cursor"]), advance)

    folded = packed.select(
        *key, F.aggregate("segments", start, step).alias("f"), F.size("segments").alias("n"),
        F.element_at("segments", 1)["origin_stop_id"].alias("next_origin_stop_id"),
        F.element_at("segments", 1)["destination_stop_id"].alias("next_stop_id"),
    )
    complete = ~F.col("f.stopped")
    return folded.select(
        *key,
        F.when(complete, F.col("f.total")).alias("value_seconds"),
        F.when(F.col("f.total") > 0, F.col("f.weighted") / F.col("f.total")).otherwise(F.lit(0.0)).alias("reliability"),
        F.col("f.covered").cast("long").alias("segments_covered"),
        F.col("n").cast("long").alias("segments_total"),
        *[F.col(f"f.{n}").cast("long").alias(f"count_{n}") for n in SOURCES],
        complete.alias("complete"),
        F.col("f.missing_origin").alias("missing_origin_stop_id"),
        F.col("f.missing_destination").alias("missing_destination_stop_id"),
        F.col("f.next_seconds").alias("next_stop_seconds"),
        F.col("f.next_reliability").alias("next_stop_reliability"),
        F.col("f.next_source").alias("next_stop_source"),
        "next_origin_stop_id", "next_stop_id",
    )


def eta_next_stop(projections: DataFrame) -> DataFrame:
    """The first segment's own target; complete even when the trip end is not."""
    return projections.select(
        "vehicle_prefix", "scope", F.col("next_stop_seconds").alias("value_seconds"),
        F.col("next_stop_reliability").alias("reliability"), F.col("next_stop_source").alias("source"),
        F.col("next_stop_seconds").isNotNull().alias("complete"), "next_stop_id",
    )


def _moment(at: Column, seconds: Column) -> Column:
    shifted = F.timestamp_micros(F.unix_micros(at) + F.bround(seconds * 1e6).cast("long"))
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _counts(*pairs: tuple[str, Column]) -> Column:
    """Map of positive counts by source."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.cast("long").alias("value")) for n, c in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def _target(at: Column, seconds: Column, reliability: Column, covered: Column, total: Column,
            counts: Column, complete: Column, origin: Column, destination: Column) -> Column:
    return F.struct(
        seconds.alias("value_seconds"), _moment(at, seconds).alias("estimated_at"),
        reliability.alias("reliability"), covered.cast("int").alias("segments_covered"),
        total.cast("int").alias("segments_total"), counts.alias("source_counts"),
        complete.alias("complete"), origin.alias("missing_origin_stop_id"),
        destination.alias("missing_destination_stop_id"),
    )


def projection_struct(at: Column, scenario: str) -> Column:
    """Nested next-stop and trip-end targets of one projection row."""
    has_next = F.col("next_stop_seconds").isNotNull()
    next_counts = _counts(*[(n, (F.col("next_stop_source") == n).cast("int")) for n in SOURCES])
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.col("scope"), F.lit(scenario).alias("scenario"),
        _target(
            at, F.col("next_stop_seconds"), F.col("next_stop_reliability"), has_next.cast("int"), F.lit(1),
            next_counts, has_next,
            F.when(has_next, nothing).otherwise(F.col("next_origin_stop_id")),
            F.when(has_next, nothing).otherwise(F.col("next_stop_id")),
        ).alias("next_stop"),
        _target(
            at, F.col("value_seconds"), F.col("reliability"), F.col("segments_covered"),
            F.col("segments_total"), _counts(*[(n, F.col(f"count_{n}")) for n in SOURCES]), F.col("complete"),
            F.col("missing_origin_stop_id"), F.col("missing_destination_stop_id"),
        ).alias("trip_end"),
    )


def vehicle_eta(
    states: DataFrame, stop_times: DataFrame, catalog: DataFrame, at: Column | str, segments: DataFrame | None = None
) -> DataFrame:
    """One nested ETA per vehicle: both scenarios for both scopes.

    Works for the whole fleet at once; a single vehicle is a filter on `states`.
    """
    t = at_lit(at)
    if segments is None:
        able = eligible_for_eta(states, at).filter("eta_reason IS NULL").drop("eta_reason")
        segments = remaining_segments(able, stop_times)
    now = eta_current_time(resolve_remaining(segments, catalog, at)).select(
        "vehicle_prefix", "scope", projection_struct(t, "current_time").alias("projection")
    ).withColumn("scenario", F.lit("current_time"))
    later = eta_future_time(reachable_candidates(segments, catalog, at)).select(
        "vehicle_prefix", "scope", projection_struct(t, "future_time").alias("projection")
    ).withColumn("scenario", F.lit("future_time"))
    both = now.unionByName(later)

    def of(scenario: str, scope: str) -> Column:
        wanted = (F.col("scenario") == scenario) & (F.col("scope") == scope)
        return F.max_by("projection", F.when(wanted, 1)).alias(f"{scenario}_{scope}")

    nested = both.groupBy("vehicle_prefix").agg(
        *[of(sc, sp) for sc in ("current_time", "future_time") for sp in ("physical", "service")]
    )
    facts = segments.groupBy("vehicle_prefix").agg(
        F.first("trip_id").alias("trip_id"), F.first("route_id").alias("route_id"),
        F.first("direction_id").alias("direction_id"),
        F.min_by("destination_stop_id", "origin_stop_sequence").alias("next_stop_id"),
        F.first("terminal_stop_id").alias("terminal_stop_id"),
        F.first("terminal_arrival_seconds").alias("terminal_arrival_seconds"),
        F.count("*").alias("remaining_segment_count"),
    )
    return facts.join(nested, "vehicle_prefix").select(
        "vehicle_prefix", "trip_id", "route_id", "direction_id", "next_stop_id", "terminal_stop_id",
        planned_trip_end(F.col("terminal_arrival_seconds"), t).alias("planned_trip_end_at"),
        "remaining_segment_count",
        F.struct(
            F.col("current_time_physical").alias("physical"), F.col("current_time_service").alias("service")
        ).alias("current_time"),
        F.struct(
            F.col("future_time_physical").alias("physical"), F.col("future_time_service").alias("service")
        ).alias("future_time"),
    )


def as_snapshots(etas: DataFrame, states: DataFrame, at: Column | str, mode: str) -> DataFrame:
    """ETA rows as snapshot rows with the JSON payload."""
    payload = F.to_json(
        F.struct(
            F.date_format(at_lit(at), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("queried_at"),
            F.lit(mode).alias("calculation_mode"),
            *[F.col(c) for c in etas.columns],
        ),
        {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"},
    )
    seen = states.select("vehicle_prefix", "source_timestamp")
    return etas.join(seen, "vehicle_prefix").select(
        "vehicle_prefix", "source_timestamp", at_lit(at).alias("generated_at"), "trip_id", "route_id",
        "direction_id", F.lit(mode).alias("calculation_mode"), payload.alias("payload"),
    )


def fleet_eta_snapshot(states: DataFrame, stop_times: DataFrame, catalog: DataFrame, at: Column | str) -> DataFrame:
    """Enriched snapshots for every vehicle seen in the last five minutes."""
    etas = vehicle_eta(states, stop_times, catalog, at)
    return as_snapshots(etas, states, at, "enriched")


def snapshot_counts(states: DataFrame, snapshots: DataFrame, at: Column | str) -> DataFrame:
    """Eligible vehicles, snapshots made and vehicles without one."""
    able = states.filter(fresh(F.col("source_timestamp"), at_lit(at), POSITION_SECONDS)).filter(
        "current_origin_stop_sequence IS NOT NULL AND current_destination_stop_sequence IS NOT NULL"
        " AND trip_id IS NOT NULL AND shape_progress_m IS NOT NULL"
    )
    made = able.select("vehicle_prefix").join(
        snapshots.select("vehicle_prefix", F.lit(1).alias("made")), "vehicle_prefix", "left"
    )
    return made.agg(
        F.count("*").alias("eligible_vehicle_count"),
        F.count("made").alias("snapshot_count"),
        (F.count("*") - F.count("made")).alias("unavailable_vehicle_count"),
    )


def needs_planned_snapshot(states: DataFrame, snapshots: DataFrame, at: Column | str) -> DataFrame:
    """Projected vehicles of the last minute whose snapshot is missing, of another trip or old."""
    t = at_lit(at)
    current = states.filter(fresh(F.col("source_timestamp"), t, SIGNAL_SECONDS)).filter(fully_projected())
    had = snapshots.select(
        "vehicle_prefix", F.col("trip_id").alias("_trip"), F.col("generated_at").alias("_made")
    )
    return current.join(had, "vehicle_prefix", "left").filter(
        F.col("_made").isNull()
        | (F.col("_trip") != F.col("trip_id"))
        | ~fresh(F.col("_made"), t, SNAPSHOT_SECONDS)
    ).drop("_trip", "_made")


def planned_eta(states: DataFrame, planned: DataFrame, terminals: DataFrame, at: Column | str) -> DataFrame:
    """Planned-only ETA per vehicle; arrived vehicles get zero seconds.

    `terminals` holds the terminal stop and its arrival per trip.
    """
    needed = [
        "vehicle_prefix", *TRIP, "route_id", "direction_id", "shape_progress_m",
        "current_origin_stop_sequence", "current_destination_stop_sequence",
    ]
    rows = located_planned_segments(states.select(*needed), planned).join(terminals, TRIP)
    seconds = F.col("duration_seconds") * F.col("remaining_fraction")
    ahead = ~F.col("arrived")
    return rows.groupBy("vehicle_prefix").agg(
        F.first("trip_id").alias("trip_id"), F.first("route_id").alias("route_id"),
        F.first("direction_id").alias("direction_id"),
        F.max("arrived").alias("arrived"),
        F.sum(F.when(ahead, seconds).otherwise(F.lit(0.0))).alias("value_seconds"),
        F.count_if(ahead).alias("remaining_segment_count"),
        F.min_by(F.struct(seconds.alias("s"), "origin_stop_id", "destination_stop_id"), "origin_stop_sequence").alias("first"),
        F.first("terminal_stop_id").alias("terminal_stop_id"),
        F.first("terminal_arrival_seconds").alias("terminal_arrival_seconds"),
    ).select(
        "vehicle_prefix", "trip_id", "route_id", "direction_id", "arrived",
        "value_seconds", "remaining_segment_count",
        F.when(F.col("arrived"), F.lit(0.0)).otherwise(F.col("first.s")).alias("next_stop_seconds"),
        F.when(F.col("arrived"), F.col("terminal_stop_id")).otherwise(F.col("first.destination_stop_id")).alias("next_stop_id"),
        F.col("first.origin_stop_id").alias("next_origin_stop_id"),
        "terminal_stop_id",
        planned_trip_end(F.col("terminal_arrival_seconds"), at_lit(at)).alias("planned_trip_end_at"),
    )


def planned_eta_snapshot(
    states: DataFrame, snapshots: DataFrame, planned: DataFrame, terminals: DataFrame, at: Column | str
) -> DataFrame:
    """Planned baseline snapshots for vehicles left without an enriched one."""
    t = at_lit(at)
    waiting = needs_planned_snapshot(states, snapshots, at)
    etas = planned_eta(waiting, planned, terminals, at)
    # an arrived vehicle covers no segment but is complete with full reliability
    length = F.col("remaining_segment_count")
    row = (
        etas.withColumn("reliability", F.when(F.col("value_seconds") > 0, 1.0).when(F.col("arrived"), 1.0).otherwise(0.0))
        .withColumn("segments_covered", length)
        .withColumn("segments_total", length)
        .withColumn("complete", F.lit(True))
        .withColumn("next_stop_reliability", F.lit(1.0))
        .withColumn("next_stop_source", F.lit("gtfs_planned"))
        .withColumn("missing_origin_stop_id", F.lit(None).cast("string"))
        .withColumn("missing_destination_stop_id", F.lit(None).cast("string"))
        .withColumn("count_live", F.lit(0))
        .withColumn("count_historical", F.lit(0))
        .withColumn("count_gtfs_planned", length)
    )

    def side(scenario: str) -> Column:
        def scoped(scope: str) -> Column:
            return projection_struct(t, scenario).withField("scope", F.lit(scope)).alias(scope)

        return F.struct(scoped("physical"), scoped("service")).alias(scenario)

    nested = row.withColumn("scope", F.lit("")).select(
        "vehicle_prefix", "trip_id", "route_id", "direction_id", "next_stop_id", "terminal_stop_id",
        "planned_trip_end_at", "remaining_segment_count", side("current_time"), side("future_time"),
    )
    return as_snapshots(nested, states, at, "planned_baseline")


def trip_terminals(stop_times: DataFrame) -> DataFrame:
    return stop_times.groupBy(*TRIP).agg(
        F.max_by("stop_id", "stop_sequence").alias("terminal_stop_id"),
        F.max_by("arrival_seconds", "stop_sequence").alias("terminal_arrival_seconds"),
    )


def current_snapshots(snapshots: DataFrame, at: Column | str) -> DataFrame:
    """Snapshots at most ten minutes old by vehicle, with the newest generation time."""
    newest = snapshots.agg(F.max("generated_at"))
    return (
        snapshots.filter(fresh(F.col("generated_at"), at_lit(at), SNAPSHOT_SECONDS))
        .withColumn("latest_generated_at", newest.scalar())
        .orderBy("vehicle_prefix")
    )
