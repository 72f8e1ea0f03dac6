"""Travel-time estimates: live, then historical, then planned, else unavailable."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrain.functions.geo import line_geojson, line_slice, simplify_line
from fleetgrain.functions.identity import metric_key
from fleetgrain.functions.times import at_lit, elapsed_seconds, fallback_slots, window_start
from fleetgrain.operators.metrics import LIVE_SECONDS, metrics_for_keys, reference_period
from fleetgrain.operators.samples import metric_identities
from fleetgrain.session import materialize, small_side
from fleetgrain.operators.timetable import (
    PAIR,
    TRIP,
    adjacent_stop_pairs,
    first_offset_mean,
    planned_in_windows,
    planned_slot_means,
    planned_traversals,
)

CATALOG = (
    "metric_key", "source", "day_type", "service_date", "slot_index",
    "value_seconds", "reliability", "sample_count", "window_end",
)
RESOLVED = (
    "value_seconds", "reliability", "sample_count", "source", "age_seconds", "historical_offset_minutes",
)


def resolve_estimate(at: Column, live: Column, historical: Column, planned: Column) -> Column:
    """Pick among candidate structs (value_seconds, reliability, sample_count, …).

    `live` also carries window_end, `historical` offset_minutes of the chosen slot.
    """
    age = F.greatest(F.lit(0.0), elapsed_seconds(at, live["window_end"]))

    def result(c: Column, source: str, age_s: Column, offset: Column) -> Column:
        return F.struct(
            c["value_seconds"].cast("double").alias("value_seconds"),
            c["reliability"].cast("double").alias("reliability"),
            c["sample_count"].cast("long").alias("sample_count"),
            F.lit(source).alias("source"),
            age_s.cast("double").alias("age_seconds"),
            offset.cast("int").alias("historical_offset_minutes"),
        )

    nothing = F.lit(None)
    unavailable = F.struct(
        nothing.cast("double").alias("value_seconds"), F.lit(0.0).alias("reliability"),
        F.lit(0).cast("long").alias("sample_count"), F.lit("unavailable").alias("source"),
        nothing.cast("double").alias("age_seconds"), nothing.cast("int").alias("historical_offset_minutes"),
    )
    usable_live = live.isNotNull() & live["window_end"].isNotNull() & (age <= LIVE_SECONDS)
    return (
        F.when(usable_live, result(live, "live", age, nothing))
        .when(historical.isNotNull(), result(historical, "historical", nothing, historical["offset_minutes"]))
        .when(planned.isNotNull(), result(planned, "gtfs_planned", nothing, nothing))
        .otherwise(unavailable)
    )


def estimate_catalog(
    requests: DataFrame, live: DataFrame, profiles: DataFrame, stop_times: DataFrame, trips: DataFrame,
    services: DataFrame, exceptions: DataFrame, at: str, day: date, dates: list[date],
) -> DataFrame:
    """All candidates for the distinct requested identities in one long table."""
    requests = materialize(requests.select(*PAIR, "route_id", "direction_id").distinct())
    keys = materialize(metric_identities(requests).select("metric_key").distinct())
    none = F.lit(None)

    def rows(df: DataFrame, source: str, **columns: Column) -> DataFrame:
        base = {
            "metric_key": F.col("metric_key"), "source": F.lit(source),
            "day_type": none.cast("string"), "service_date": none.cast("date"),
            "slot_index": none.cast("int"), "window_end": none.cast("timestamp"), **columns,
        }
        return df.select(*[base[c].alias(c) for c in CATALOG])

    measured = {
        "value_seconds": F.col("mean_seconds"), "reliability": F.col("reliability"),
        "sample_count": F.col("sample_count_accepted").cast("long"),
    }
    current = rows(metrics_for_keys(live, keys, at=at), "live", **measured, window_end=F.col("window_end"))
    history = rows(
        metrics_for_keys(profiles, keys, day=day), "historical", **measured,
        day_type=F.col("day_type"), slot_index=F.col("slot_index").cast("int"),
    )
    traversals = planned_traversals(requests, stop_times, trips, services, exceptions, dates)
    means = planned_slot_means(traversals, requests).withColumn(
        "metric_key",
        metric_key(
            F.col("scope"), F.col("origin_stop_id"), F.col("destination_stop_id"),
            F.col("route_id"), F.col("direction_id"),
        ),
    )
    planned = rows(
        means, "gtfs_planned", value_seconds=F.col("mean_seconds"), reliability=F.lit(1.0),
        sample_count=F.col("trip_count"), service_date=F.col("departure_date"),
        slot_index=F.col("slot_index"),
    )
    return current.unionByName(history).unionByName(planned)


def stored_catalog(catalog: DataFrame) -> DataFrame:
    """A catalog stored with the rows of a key together, so that a file holds its 64 characters as one run."""
    return materialize(catalog.sortWithinPartitions("metric_key"))


def _candidate(*extra: str) -> Column:
    return F.struct("value_seconds", "reliability", "sample_count", *extra)


def catalog_resolve(requests: DataFrame, catalog: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Resolve (metric_key, estimate_at) rows against a catalog.

    `moments` are the same keys and times from a plan that is cheaper than that of `requests`.

    Distinct keys and times are resolved once, stored and joined back, so a stop pair
    many vehicles still have ahead of them costs one lookup, and the requests stay where
    they are while the resolved keys are few.
    """
    asked = requests if moments is None else moments
    asked = small_side(materialize(asked.select("metric_key", "estimate_at").distinct()), 96)
    slots = asked.select(
        "metric_key", "estimate_at", F.explode(fallback_slots(F.col("estimate_at"))).alias("s")
    ).select("metric_key", "estimate_at", "s.*")
    found = ["metric_key", "estimate_at"]
    history = (
        slots.join(catalog.filter("source = 'historical'").drop("service_date", "source"), ["metric_key", "day_type", "slot_index"])
        .groupBy(*found)
        .agg(F.min_by(_candidate("offset_minutes"), "rank").alias("historical"))
    )
    timetable = catalog.filter("source = 'gtfs_planned'").drop("day_type", "source")
    planned = (
        slots.withColumnRenamed("local_date", "service_date")
        .join(timetable, ["metric_key", "service_date", "slot_index"])
        .groupBy(*found)
        .agg(F.min_by(_candidate(), "rank").alias("planned"))
    )
    live = catalog.filter("source = 'live'").groupBy("metric_key").agg(
        F.max_by(_candidate("window_end"), "window_end").alias("live")
    )
    resolved = asked.join(live, "metric_key", "left").join(history, found, "left").join(planned, found, "left")
    joined = requests.join(small_side(materialize(resolved), 256), found, "left")
    own = F.when(
        F.col("planned_duration_seconds").isNotNull(),
        F.struct(
            F.col("planned_duration_seconds").cast("double").alias("value_seconds"),
            F.lit(1.0).alias("reliability"), F.lit(1).cast("long").alias("sample_count"),
        ),
    )
    return joined.withColumn(
        "estimate",
        resolve_estimate(
            F.col("estimate_at"), F.col("live"), F.col("historical"), F.coalesce(F.col("planned"), own)
        ),
    ).drop("live", "historical", "planned")


def in_fallback_slots(spark: SparkSession, at: Column | str) -> Column:
    """Whether a profile row is of a day type and slot that an estimate at `at` may fall back to.

    The slots are read as values, so that the test reaches the rows below the aggregates.
    """
    slots = spark.range(1).select(F.explode(fallback_slots(at_lit(at))).alias("s")).select("s.day_type", "s.slot_index").collect()
    types = sorted({s["day_type"] for s in slots})
    return reduce(or_, [
        (F.col("day_type") == kind) & F.col("slot_index").isin(*sorted({s["slot_index"] for s in slots if s["day_type"] == kind}))
        for kind in types
    ])


def segment_estimates(
    requests: DataFrame, live: DataFrame, profiles: DataFrame, stop_times: DataFrame, trips: DataFrame,
    services: DataFrame, exceptions: DataFrame, at: str, day: date, dates: list[date],
) -> DataFrame:
    """Estimates for pairs: physical always, service when route and direction are given.

    The timetable is consulted only for pairs still without an estimate.
    """
    half = F.col("route_id").isNull() != F.col("direction_id").isNull()
    checked = requests.withColumn(
        "route_id",
        F.when(half, F.raise_error(F.lit("route and direction must be given together"))).otherwise(
            F.col("route_id")
        ),
    )
    asked = metric_identities(checked.select(*PAIR, "route_id", "direction_id").distinct()).withColumn(
        "estimate_at", at_lit(at)
    ).withColumn("planned_duration_seconds", F.lit(None).cast("double"))
    asked = materialize(asked.dropDuplicates(["metric_key"]))
    keys = asked.select("metric_key")
    none = F.lit(None)
    measured = [
        F.col("mean_seconds").alias("value_seconds"), F.col("reliability"),
        F.col("sample_count_accepted").cast("long").alias("sample_count"),
    ]
    current = metrics_for_keys(live, keys, at=at).select(
        "metric_key", F.lit("live").alias("source"), none.cast("string").alias("day_type"),
        none.cast("date").alias("service_date"), none.cast("int").alias("slot_index"), *measured, "window_end",
    )
    history = metrics_for_keys(profiles.filter(in_fallback_slots(requests.sparkSession, at)), keys, day=day).select(
        "metric_key", F.lit("historical").alias("source"), "day_type",
        none.cast("date").alias("service_date"), F.col("slot_index").cast("int").alias("slot_index"),
        *measured, none.cast("timestamp").alias("window_end"),
    )
    first = materialize(catalog_resolve(asked, materialize(current.unionByName(history))))
    missing = first.filter("estimate.source = 'unavailable'").select(
        "metric_key", "scope", *PAIR, "route_id", "direction_id"
    )
    runs = planned_in_windows(missing, stop_times, trips, services, exceptions, at, dates)
    physical = first_offset_mean(
        runs.join(missing.filter("scope = 'physical'").select("metric_key", *PAIR), PAIR), ["metric_key"]
    )
    route = [*PAIR, "route_id", "direction_id"]
    service = first_offset_mean(
        runs.join(missing.filter("scope = 'service'").select("metric_key", *route), route), ["metric_key"]
    )
    planned = physical.unionByName(service).select(
        "metric_key",
        F.struct(
            F.col("mean_seconds").alias("value_seconds"), F.lit(1.0).alias("reliability"),
            F.col("sample_count").alias("sample_count"),
        ).alias("p"),
    )
    nothing = F.lit(None)
    filled = first.join(planned, "metric_key", "left").withColumn(
        "estimate",
        F.when(
            (F.col("estimate.source") == "unavailable") & F.col("p").isNotNull(),
            resolve_estimate(
                F.col("estimate_at"),
                nothing.cast("struct<value_seconds:double,reliability:double,sample_count:bigint,window_end:timestamp>"),
                nothing.cast("struct<value_seconds:double,reliability:double,sample_count:bigint,offset_minutes:int>"),
                F.col("p"),
            ),
        ).otherwise(F.col("estimate")),
    )
    return filled.select(
        "metric_key", "scope", *PAIR, "route_id", "direction_id", *[f"estimate.{c}" for c in RESOLVED]
    )


def remaining_traversals(
    states: DataFrame, stop_times: DataFrame, trips: DataFrame, stops: DataFrame, at: Column | str,
    max_age_seconds: int = 300,
) -> DataFrame:
    """Distinct stop-to-stop traversals ahead of recently seen vehicles.

    Per trip only the least progress matters, so vehicles are reduced to one
    row per trip before meeting the timetable.
    """
    recent = states.filter(
        (F.col("source_timestamp") >= at_lit(at) - F.expr(f"INTERVAL {max_age_seconds} SECONDS"))
        & F.col("trip_id").isNotNull()
        & F.col("shape_progress_m").isNotNull()
    ).groupBy("feed_id", "trip_id").agg(F.min("shape_progress_m").alias("vehicle_progress_m"))
    ahead = adjacent_stop_pairs(stop_times).join(recent, TRIP).filter(
        "origin_shape_progress_m >= vehicle_progress_m"
        " AND destination_shape_progress_m > origin_shape_progress_m"
        " AND destination_shape_position > origin_shape_position"
    )
    names = stops.select("feed_id", "stop_id", "name")
    shaped = (
        ahead.join(trips.select(*TRIP, "shape_id"), TRIP)
        .join(names.select("feed_id", F.col("stop_id").alias("origin_stop_id"), F.col("name").alias("origin_stop_name")), ["feed_id", "origin_stop_id"])
        .join(names.select("feed_id", F.col("stop_id").alias("destination_stop_id"), F.col("name").alias("destination_stop_name")), ["feed_id", "destination_stop_id"])
    )
    return shaped.select(
        *PAIR, "origin_stop_name", "destination_stop_name",
        F.col("origin_departure_seconds").alias("departure_seconds"),
        F.col("duration_seconds"), "feed_id", "shape_id",
        "origin_shape_position", "destination_shape_position",
        (F.col("destination_shape_progress_m") - F.col("origin_shape_progress_m")).alias("distance_m"),
    ).distinct()


def segment_speed_map(
    traversals: DataFrame, live: DataFrame, profiles: DataFrame, at: str, day: date,
    current_day_type: str, current_slot: int,
) -> DataFrame:
    """Speed per stop pair: live within the hour, else profile, else planned mean.

    The day type stays that of `at`, slots wrap around the day, and the
    future slot wins ties. The representative is the longest traversal.
    """
    per_pair = traversals.groupBy(*PAIR).agg(
        F.max_by(
            F.struct(
                "origin_stop_name", "destination_stop_name", "feed_id", "shape_id",
                "origin_shape_position", "destination_shape_position", "distance_m",
            ),
            F.struct("duration_seconds", "feed_id", "shape_id", "distance_m", "departure_seconds"),
        ).alias("r"),
        F.avg("duration_seconds").alias("planned_seconds"),
        F.count("*").alias("planned_count"),
    )
    usable = "scope = 'physical' AND mean_seconds IS NOT NULL AND sample_count_accepted > 0"
    t = at_lit(at)
    current = live.filter(usable).filter(
        (F.col("window_start") <= t) & (F.col("window_end") >= t - F.expr("INTERVAL 1 HOUR"))
    ).groupBy(*PAIR).agg(
        F.max_by(
            F.struct("mean_seconds", "reliability", "sample_count_accepted", "window_start", "window_end"),
            "window_end",
        ).alias("l")
    )
    start, end = reference_period(day)
    gap = F.col("slot_index") - F.lit(current_slot)
    distance = F.least(F.abs(gap), 288 - F.abs(gap))
    offset = F.when(gap > 144, gap - 288).when(gap < -144, gap + 288).otherwise(gap) * 5
    history = (
        profiles.filter(usable)
        .filter(
            (F.col("day_type") == current_day_type)
            & (F.col("reference_start_date") == F.lit(str(start)).cast("date"))
            & (F.col("reference_end_date") == F.lit(str(end)).cast("date"))
            & (distance <= 6)
        )
        .groupBy(*PAIR)
        .agg(
            F.min_by(
                F.struct("mean_seconds", "reliability", "sample_count_accepted", offset.cast("int").alias("offset")),
                F.struct(distance, (F.col("slot_index") < current_slot).cast("int")),
            ).alias("h")
        )
    )
    joined = per_pair.join(current, PAIR, "left").join(history, PAIR, "left")
    seconds = F.coalesce("l.mean_seconds", "h.mean_seconds", "planned_seconds")
    has_live = F.col("l.mean_seconds").isNotNull()
    has_history = F.col("h.mean_seconds").isNotNull()
    return joined.filter(seconds > 0).select(
        *PAIR, "r.origin_stop_name", "r.destination_stop_name", "r.feed_id", "r.shape_id",
        "r.origin_shape_position", "r.destination_shape_position", "r.distance_m",
        seconds.alias("duration_seconds"),
        (F.col("r.distance_m") / seconds * 3.6).alias("speed_kmh"),
        F.when(has_live, "live").when(has_history, "historical").otherwise("gtfs_planned").alias("source"),
        F.coalesce("l.reliability", "h.reliability", F.lit(1.0)).alias("reliability"),
        F.coalesce("l.sample_count_accepted", "h.sample_count_accepted", "planned_count").alias("sample_count"),
        F.col("l.window_start").alias("window_start"),
        F.col("l.window_end").alias("window_end"),
        F.when(~has_live, F.col("h.offset")).alias("historical_offset_minutes"),
    )


def speed_map_geometry(speed_map: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds the simplified sub-line between the two stops as GeoJSON."""
    shaped = speed_map.join(lines.select("feed_id", "shape_id", "points"), ["feed_id", "shape_id"])
    part = line_slice(F.col("points"), F.col("origin_shape_position"), F.col("destination_shape_position"))
    sliced = shaped.withColumn("points", simplify_line(part))
    return sliced.withColumn("geometry", line_geojson(F.col("points"))).drop("points")


def due_windows(snapshots: DataFrame, at: Column | str) -> DataFrame:
    """Whether the enriched refresh of the current five-minute window is still due."""
    newest = snapshots.filter(
        F.coalesce(F.col("calculation_mode"), F.lit("enriched")) == "enriched"
    ).agg(F.max("generated_at").alias("latest_generated_at"))
    start = window_start(at_lit(at))
    return newest.select(
        "latest_generated_at", start.alias("window_start"),
        F.coalesce(F.col("latest_generated_at") < start, F.lit(True)).alias("due"),
    )

