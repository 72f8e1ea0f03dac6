"""Fleet views: map positions, roster context, fleet rows and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrain.functions.status import (
    CLASSES,
    DELAY_CLASSES,
    DELAYED_SECONDS,
    SIGNAL_SECONDS,
    SOURCES,
    delay_class,
    fully_projected,
    operational_class,
    rounded_gap,
    vehicle_alerts,
)
from fleetgrain.functions.text import canonical_text
from fleetgrain.functions.times import at_lit, fresh
from fleetgrain.operators.shapes import segment_at_progress

ROSTER_BEFORE_SECONDS = 600
ROSTER_AFTER_SECONDS = 1800


def recent_signals(states: DataFrame, at: Column | str) -> DataFrame:
    return states.filter(fresh(F.col("source_timestamp"), at_lit(at), SIGNAL_SECONDS))


def projected_positions(
    states: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame, segments: DataFrame, at: Column | str
) -> DataFrame:
    """Fully projected vehicles of the last minute with trip, route, stops and bearing."""
    current = recent_signals(states, at).filter("map_match_status = 'resolved'").filter(fully_projected())
    names = stops.select("feed_id", "stop_id", F.col("name"))
    joined = (
        current.join(trips.select("feed_id", "trip_id", "headsign", F.col("direction_id").alias("trip_direction_id")), ["feed_id", "trip_id"])
        .join(
            routes.select("feed_id", "route_id", F.col("short_name").alias("route_short_name"), F.col("long_name").alias("route_long_name")),
            ["feed_id", "route_id"],
        )
        .join(
            names.select("feed_id", F.col("stop_id").alias("current_origin_stop_id"), F.col("name").alias("current_origin_stop_name")),
            ["feed_id", "current_origin_stop_id"], "left",
        )
        .join(
            names.select("feed_id", F.col("stop_id").alias("current_destination_stop_id"), F.col("name").alias("current_destination_stop_name")),
            ["feed_id", "current_destination_stop_id"], "left",
        )
    )
    return segment_at_progress(joined, segments, ["vehicle_prefix"])


def raw_positions(states: DataFrame, at: Column | str) -> DataFrame:
    """Vehicles of the last minute with coordinates that are not fully projected."""
    return (
        recent_signals(states, at)
        .filter("latitude IS NOT NULL AND longitude IS NOT NULL")
        .filter(~fully_projected())
        .withColumn("operational_class", operational_class())
    )


def class_counts(states: DataFrame, at: Column | str) -> DataFrame:
    """One row: vehicles per operational class, zero-filled, and the total."""
    named = recent_signals(states, at).select(operational_class().alias("c"))
    return named.agg(
        *[F.count_if(F.col("c") == name).alias(name) for name in CLASSES],
        F.count("*").alias("monitored"),
    )


def source_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col("source") == s).alias(s) for s in SOURCES])


def sum_count_maps(df: DataFrame, counts: str = "source_counts") -> DataFrame:
    """Sum of map values per key over all rows."""
    return df.select(F.explode(counts).alias("source", "n")).groupBy("source").agg(F.sum("n").alias("total"))


def percent_mix(df: DataFrame) -> DataFrame:
    """Whole percentages of the three sources that add up to 100.

    Largest remainders get the missing points; ties go in source order.
    """
    values = {s: F.greatest(F.lit(0), F.coalesce(F.col(s), F.lit(0))) for s in SOURCES}
    df = df.withColumn("total", sum(values.values(), F.lit(0)))
    for s in SOURCES:
        raw = F.when(F.col("total") > 0, values[s] / F.col("total") * 100).otherwise(F.lit(0.0))
        df = df.withColumn(f"_raw_{s}", raw)
    floors = {s: F.floor(F.col(f"_raw_{s}")) for s in SOURCES}
    rest = {s: F.col(f"_raw_{s}") - floors[s] for s in SOURCES}
    df = df.withColumn(
        "_left", F.when(F.col("total") > 0, 100 - sum(floors.values(), F.lit(0))).otherwise(F.lit(0))
    )

    def place(s: str) -> Column:
        index = SOURCES.index(s)
        ahead = F.lit(0)
        for other_index, other in enumerate(SOURCES):
            if other != s:
                wins = rest[other] > rest[s] if other_index > index else rest[other] >= rest[s]
                ahead = ahead + wins.cast("int")
        return floors[s] + (ahead < F.col("_left")).cast("int")

    for s in SOURCES:
        df = df.withColumn(f"pct_{s}", place(s))
    return df.drop("_left", *[f"_raw_{s}" for s in SOURCES])


def select_roster_trip(roster: DataFrame, at: Column | str) -> DataFrame:
    """One trip per vehicle: in progress, else near its planned time; latest start wins."""
    t = at_lit(at)
    in_progress = F.col("actual_start_at").isNotNull() & F.col("actual_end_at").isNull()
    near = F.coalesce(
        (F.col("planned_start_at") - F.expr(f"INTERVAL {ROSTER_BEFORE_SECONDS} SECONDS") <= t)
        & (t <= F.col("planned_end_at") + F.expr(f"INTERVAL {ROSTER_AFTER_SECONDS} SECONDS")),
        F.lit(False),
    )
    rest = [c for c in roster.columns if c != "vehicle_prefix"]
    candidates = roster.filter(in_progress | near)
    begins = F.coalesce("actual_start_at", "planned_start_at")
    best = candidates.groupBy("vehicle_prefix").agg(
        F.max_by(F.struct(*rest, in_progress.alias("in_progress")), F.struct(in_progress, begins)).alias("r")
    )
    return best.select("vehicle_prefix", "r.*")


def fleet_rows(positions: DataFrame, etas: DataFrame, roster: DataFrame, at: Column | str) -> DataFrame:
    """Positions with ETA (same trip only), roster context, delays, status and alerts.

    `etas` carries trip_id, estimated_at and planned_trip_end_at per vehicle;
    `roster` one selected trip per vehicle.
    """
    e = etas.select(
        "vehicle_prefix", "trip_id", "estimated_at", "planned_trip_end_at",
        *[c for c in ("source_counts", "eta_reliability") if c in etas.columns],
    )
    r = roster.select(
        "vehicle_prefix", F.col("line").alias("roster_line"), F.col("destination_name").alias("roster_destination"),
        "planned_start_at", "actual_start_at", F.col("planned_end_at").alias("roster_end_at"),
    )
    joined = positions.join(e, ["vehicle_prefix", "trip_id"], "left").join(r, "vehicle_prefix", "left")
    planned = F.coalesce("roster_end_at", "planned_trip_end_at")
    arrival = rounded_gap(F.col("estimated_at"), planned)
    alerts = vehicle_alerts(F.col("source_timestamp"), F.col("speed_kmh"), F.col("low_speed_since"), at_lit(at))
    return (
        joined.withColumn("shown_line", F.coalesce("roster_line", "route_short_name", "current_line"))
        .withColumn("shown_destination", F.coalesce("roster_destination", "current_destination_stop_name", "headsign"))
        .withColumn("planned_at", planned)
        .withColumn("arrival_delay_seconds", arrival)
        .withColumn("departure_delay_seconds", rounded_gap(F.col("actual_start_at"), F.col("planned_start_at")))
        .withColumn("delay_status", delay_class(arrival))
        .withColumn("alerts", alerts)
        .withColumn("stale", F.col("alerts.stale"))
        .withColumn("low_speed", F.col("alerts.low_speed"))
        .drop("alerts")
    )


def facet_filter(
    fleet: DataFrame, line: str | None = None, terminal: str | None = None, status: str | None = None
) -> DataFrame:
    """Equality filters; a vehicle without a status counts as no_reference."""
    for column, wanted in (("shown_line", line), ("roster_destination", terminal)):
        if wanted:
            fleet = fleet.filter(F.col(column) == wanted)
    if status:
        fleet = fleet.filter(F.coalesce("delay_status", F.lit("no_reference")) == status)
    return fleet


def facet_values(fleet: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values, sorted."""
    values = fleet.select(F.col(column).alias("value")).filter("value <> ''")
    return values.distinct().orderBy("value")


def kpi_rollup(fleet: DataFrame) -> DataFrame:
    """One row of status counts, punctuality and alert counts."""
    status = F.coalesce("delay_status", F.lit("no_reference"))
    counted = fleet.agg(
        *[F.count_if(status == s).alias(s) for s in DELAY_CLASSES],
        F.count("*").alias("vehicles"),
        F.count_if("stale").alias("stale"),
        F.count_if("low_speed").alias("low_speed"),
    )
    referenced = F.col("vehicles") - F.col("no_reference")
    return counted.withColumn(
        "punctuality", F.when(referenced > 0, F.col("on_time") / referenced).otherwise(F.lit(0.0))
    )


def prescription_kpis(assigned: DataFrame, groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Threatened trips, pending groups and the delay they could still save."""
    threatened = assigned.agg(
        F.count_if(F.col("baseline_delay_seconds") > DELAYED_SECONDS).alias("threatened_trips")
    )
    final = decisions.filter(F.col("status").isin("executed", "rejected")).select("execution_key")
    pending = groups.join(final, "execution_key", "left_anti").agg(
        F.struct(
            F.count("*").alias("pending_groups"),
            F.coalesce(F.sum("saved_delay_seconds"), F.lit(0)).alias("recoverable_seconds"),
        )
    )
    return threatened.withColumn("p", pending.scalar()).select("threatened_trips", "p.*")


def top_lines_by_delay(fleet: DataFrame, n: int = 5) -> DataFrame:
    line = F.coalesce("shown_line", F.lit("Sem linha"))
    late = fleet.filter("arrival_delay_seconds > 0")
    return (
        late.groupBy(line.alias("line"))
        .agg(F.count("*").alias("vehicles"), F.sum("arrival_delay_seconds").alias("total_delay_seconds"))
        .orderBy(F.desc("total_delay_seconds"), "line")
        .limit(n)
    )


def top_terminals(plans: DataFrame, n: int = 5) -> DataFrame:
    return plans.orderBy(F.desc("baseline_total_delay_seconds"), "terminal_id").limit(n)


def natural_key(c: Column) -> Column:
    """Text key in which digit runs compare as numbers, ignoring case and accents.

    The number of a run's digits without leading zeros goes before them, so runs of any
    length keep their order.
    """
    runs = F.regexp_extract_all(c.cast("string"), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def one(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(run)

    return F.when(c.isNotNull(), canonical_text(F.array_join(F.transform(runs, one), "")))


def sort_fleet(df: DataFrame, key: str, direction: str = "asc") -> DataFrame:
    """Sort with null and empty last in both directions; text in natural order."""
    column = F.col(key)
    if df.schema[key].dataType.typeName() == "string":
        column = natural_key(F.when(column != "", column))
    order = column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()
    return df.orderBy(order)


def search_top(df: DataFrame, query: str, n: int = 8) -> DataFrame:
    """Vehicles with the text in prefix, route, line or headsign; the first `n` by prefix."""
    wanted = query.strip().lower()
    if not wanted:
        return df.filter(F.lit(False))
    hit = F.lit(False)
    for name in ("vehicle_prefix", "route_short_name", "current_line", "headsign"):
        hit = hit | F.coalesce(F.contains(F.lower(name), F.lit(wanted)), F.lit(False))
    return df.filter(hit).orderBy("vehicle_prefix").limit(n)


def source_health(runs: DataFrame, at: Column | str, stale_seconds: float, by: str = "source_system") -> DataFrame:
    """Latest attempt, last success and its age per source, with the resulting state."""
    good = F.when(F.col("status").isin("succeeded", "partial"), F.col("finished_at"))
    last = runs.groupBy(by).agg(
        F.max_by("status", F.struct("started_at", "run_id")).alias("latest_attempt_status"),
        F.max(good).alias("last_success_at"),
    )
    micros = F.unix_micros(at_lit(at)) - F.unix_micros("last_success_at")
    age = F.greatest(F.lit(0.0), micros / 1_000_000.0)
    known = F.col("last_success_at").isNotNull()
    return last.withColumn("last_success_age_seconds", F.when(known, age)).withColumn(
        "state",
        F.when(~known, "starting")
        .when((F.col("last_success_age_seconds") <= stale_seconds) & (F.col("latest_attempt_status") != "failed"), "operational")
        .otherwise("degraded"),
    )
