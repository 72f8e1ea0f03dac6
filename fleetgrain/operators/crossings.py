"""Stop boundaries crossed between samples and the segments they complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.functions.status import USABLE, average_speed
from fleetgrain.functions.times import elapsed_seconds
from fleetgrain.operators.ordered import hour_chunk, max_before
from fleetgrain.operators.timetable import TRIP, next_stop_pairs

RUN = ["vehicle_prefix", "session_id"]
BOUNDARY = ("stop_id", "stop_sequence", "previous_stop_sequence", "progress_m", "quality")


def locate_current_segment(vehicles: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stop pair around a resolved vehicle's position; the latest origin wins."""
    pairs = next_stop_pairs(stop_times).filter(
        F.col("origin_quality").isin(*USABLE) & F.col("destination_quality").isin(*USABLE)
    )
    resolved = vehicles.filter("map_match_status = 'resolved'").select(
        "vehicle_prefix", *TRIP, "shape_position"
    )
    located = resolved.join(pairs, TRIP).filter(
        (F.col("origin_shape_position") <= F.col("shape_position"))
        & (F.col("destination_shape_position") > F.col("shape_position"))
    )
    chosen = located.groupBy("vehicle_prefix").agg(
        F.max_by(
            F.struct(
                "origin_stop_id", "destination_stop_id",
                "origin_stop_sequence", "destination_stop_sequence",
            ),
            F.struct("origin_shape_position", "origin_stop_sequence"),
        ).alias("s")
    )
    return chosen.select(
        "vehicle_prefix",
        *[F.col(f"s.{c}").alias(f"current_{c}") for c in (
            "origin_stop_id", "destination_stop_id", "origin_stop_sequence", "destination_stop_sequence")],
    )


def crossed_boundaries(moves: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Boundaries in (previous, current] of a move on the same trip.

    Moves need forward time and forward progress. Rename the boundary columns
    to `progress_m` and `quality` before.
    """
    forward = moves.filter(
        "current_timestamp > previous_timestamp AND current_progress_m > previous_progress_m"
    )
    b = boundaries.select(*TRIP, *BOUNDARY)
    return forward.join(b, TRIP).filter(
        "progress_m > previous_progress_m AND progress_m <= current_progress_m"
    )


def interpolate_crossings(moves: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Crossing times, linear in progress between the two samples."""
    crossed = crossed_boundaries(moves, boundaries)
    start, end = F.unix_micros("previous_timestamp"), F.unix_micros("current_timestamp")
    share = (F.col("progress_m") - F.col("previous_progress_m")) / (
        F.col("current_progress_m") - F.col("previous_progress_m")
    )
    at = F.timestamp_micros((start + F.bround((end - start) * share)).cast("long"))
    return crossed.withColumn("crossed_at", at).withColumn(
        "observation_end", F.col("current_timestamp")
    )


def _origin_key() -> Column:
    """Ordered so that the maximum is the earliest crossing of the highest stop."""
    return F.struct(
        F.col("stop_sequence").alias("stop_sequence"),
        (-F.unix_micros("crossed_at")).alias("earliest"),
        (-F.col("progress_m")).alias("lowest"),
        F.col("stop_id").alias("stop_id"),
        F.col("quality").alias("quality"),
        F.col("crossed_at").alias("crossed_at"),
        F.col("progress_m").alias("progress_m"),
        F.col("observation_end").alias("observation_end"),
    )


def completed_segments(crossings: DataFrame) -> DataFrame:
    """Travel times between adjacent usable boundaries of one vehicle session."""
    chunked = crossings.withColumn("_chunk", hour_chunk(F.col("crossed_at")))
    order = [F.col("crossed_at"), F.col("progress_m"), F.col("stop_sequence")]
    tracked = max_before(chunked, RUN, "_chunk", order, _origin_key(), "o").drop("_chunk")
    seconds = elapsed_seconds(F.col("crossed_at"), F.col("o.crossed_at"))
    reduced = (
        (F.col("o.observation_end") == F.col("observation_end"))
        | (F.col("o.quality") == "reduced")
        | (F.col("quality") == "reduced")
    )
    kept = [c for c in ("feed_id", "trip_id", "route_id", "direction_id") if c in crossings.columns]
    return (
        tracked.filter(
            (F.col("previous_stop_sequence") == F.col("o.stop_sequence"))
            & F.col("quality").isin(*USABLE)
            & F.col("o.quality").isin(*USABLE)
            & (seconds > 0)
        )
        .select(
            *RUN, *kept,
            F.col("o.stop_id").alias("origin_stop_id"),
            F.col("stop_id").alias("destination_stop_id"),
            F.col("o.stop_sequence").alias("origin_stop_sequence"),
            F.col("stop_sequence").alias("destination_stop_sequence"),
            F.col("o.crossed_at").alias("started_at"),
            F.col("crossed_at").alias("completed_at"),
            seconds.alias("duration_seconds"),
            (F.col("progress_m") - F.col("o.progress_m")).alias("distance_m"),
            F.when(reduced, "reduced").otherwise("high").alias("confidence"),
        )
        .withColumn("average_speed_kmh", average_speed(F.col("distance_m"), F.col("duration_seconds")))
    )


def trip_boundaries(stop_times: DataFrame) -> DataFrame:
    """Stop times shaped as boundaries, with the previous sequence of the trip."""
    order = Window.partitionBy(*TRIP).orderBy("stop_sequence")
    return stop_times.select(
        *TRIP, "stop_id", "stop_sequence",
        F.lag("stop_sequence").over(order).alias("previous_stop_sequence"),
        F.col("shape_progress_m").alias("progress_m"), "quality",
    )
