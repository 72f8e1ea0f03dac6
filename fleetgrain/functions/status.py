"""Classification rules and small metric formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgrain.functions.text import is_blank
from fleetgrain.functions.times import elapsed_seconds

# Thresholds of the operation.
VALID_DISTANCE_M = 30.0
REDUCED_DISTANCE_M = 50.0
ALERT_SECONDS = 300
DELAYED_SECONDS = 600
SIGNAL_SECONDS = 60
POSITION_SECONDS = 300
SNAPSHOT_SECONDS = 600
DECISION_SECONDS = 86_400
USABLE = ("valid", "reduced")
CLASSES = ("projected", "missing_planned_time", "ambiguous", "collecting", "no_exact_match", "other")
SOURCES = ("live", "historical", "gtfs_planned")
DELAY_CLASSES = ("on_time", "warning", "delayed", "no_reference")
PROJECTION_FIELDS = (
    "projected_at", "trip_id", "route_id", "shape_id",
    "shape_position", "shape_progress_m", "distance_to_shape_m",
)


def both_present(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def valid_position(lat: Column, lon: Column) -> Column:
    """Struct of (latitude, longitude, valid); out of range nulls both."""
    ok = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    return F.struct(
        F.when(ok, lat).alias("latitude"), F.when(ok, lon).alias("longitude"), ok.alias("valid")
    )


def nonnegative_speed(c: Column) -> Column:
    return F.when(c >= 0, c)


def projection_quality(distance: Column) -> Column:
    return (
        F.when(distance <= VALID_DISTANCE_M, "valid")
        .when(distance <= REDUCED_DISTANCE_M, "reduced")
        .when(distance.isNotNull(), "fallback_required")
    )


def reliability(weight: Column, accepted: Column, total: Column) -> Column:
    return F.least(F.lit(1.0), weight / 5.0) * accepted / total


def metric_status(weight: Column, accepted: Column, total: Column) -> Column:
    score = reliability(weight, accepted, total)
    return (
        F.when((total >= 3) & ((total - accepted) / total >= 0.5), "anomalous")
        .when(accepted == 0, "insufficient")
        .when(score < 0.4, "low")
        .when(score < 0.8, "medium")
        .otherwise("high")
    )


def delay_seconds(arrival: Column, departure: Column) -> Column:
    """Whole seconds late, rounded half to even, never negative."""
    return F.greatest(F.lit(0), F.bround(elapsed_seconds(arrival, departure))).cast("long")


def rounded_gap(later: Column, earlier: Column) -> Column:
    """Signed whole seconds, halves rounded up."""
    return F.floor(elapsed_seconds(later, earlier) + 0.5)


def delay_class(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull(), "no_reference")
        .when(seconds > DELAYED_SECONDS, "delayed")
        .when(seconds > 0, "warning")
        .otherwise("on_time")
    )


def delay_status(estimated: Column, roster_end: Column, timetable_end: Column) -> Column:
    return delay_class(rounded_gap(estimated, F.coalesce(roster_end, timetable_end)))


def vehicle_alerts(source_ts: Column, speed: Column, low_since: Column, at: Column) -> Column:
    """Struct of (stale, low_speed); both thresholds are strict."""
    age = F.greatest(F.lit(0), rounded_gap(at, source_ts))
    slow = F.greatest(F.lit(0), rounded_gap(at, low_since))
    # greatest() skips nulls, so absence is tested on the inputs
    return F.struct(
        F.coalesce(source_ts.isNotNull() & (age > ALERT_SECONDS), F.lit(False)).alias("stale"),
        F.coalesce(
            (speed < 1) & low_since.isNotNull() & (slow > ALERT_SECONDS), F.lit(False)
        ).alias("low_speed"),
    )


def fully_projected() -> Column:
    """The null-safe completeness test of a projected position."""
    complete = both_present(*[F.col(c) for c in PROJECTION_FIELDS])
    return F.coalesce(
        (F.col("map_match_status") == "resolved")
        & F.col("projection_quality").isin(*USABLE)
        & complete,
        F.lit(False),
    )


def operational_class() -> Column:
    status, reason = F.col("map_match_status"), F.col("correlation_reason")
    return (
        F.when(fully_projected(), "projected")
        .when(is_blank(F.col("current_planned_time")), "missing_planned_time")
        .when(status == "ambiguous", "ambiguous")
        .when(reason.isin("no_exact_match", "ambiguous_exact_match"), "no_exact_match")
        .when(status == "collecting", "collecting")
        .otherwise("other")
    )


def average_speed(distance_m: Column, seconds: Column) -> Column:
    return F.when(seconds != 0, distance_m / seconds * 3.6)


def effective_decision(decision: Column, first_departure: Column, at: Column) -> Column:
    return (
        F.when(decision.isin("executed", "rejected"), decision)
        .when(first_departure <= at, "expired")
        .otherwise(F.coalesce(decision, F.lit("new")))
    )


def speed_band(kmh: Column, source: Column) -> Column:
    return (
        F.when(source == "gtfs_planned", "planned")
        .when(kmh <= 10, "up_to_10")
        .when(kmh <= 20, "up_to_20")
        .when(kmh <= 30, "up_to_30")
        .when(kmh > 30, "over_30")
    )


def eta_block_reason(at: Column) -> Column:
    """Why a vehicle cannot get an ETA; null when it can."""
    needed = (
        "source_timestamp", "feed_id", "trip_id", "route_id", "direction_id",
        "shape_progress_m", "current_origin_stop_sequence", "current_destination_stop_sequence",
    )
    complete = both_present(*[F.col(c) for c in needed])
    age = elapsed_seconds(at, F.col("source_timestamp"))
    return F.when(~complete, "unresolved").when(age > POSITION_SECONDS, "stale")


