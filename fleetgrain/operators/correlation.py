"""Vehicle-to-trip correlation on exact keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrain.functions.text import normalize_line, service_time, text_or_null

KEY = ["line", "direction", "planned_time"]


def trip_candidates(active: DataFrame) -> DataFrame:
    """One row per match key: candidate count and the trip if it is alone.

    Aggregating first keeps the join one-to-one, so a popular key cannot
    multiply positions.
    """
    return active.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.min(F.struct("feed_id", "trip_id", "route_id", "shape_id")).alias("only"),
    )


def exact_trip_match(positions: DataFrame, active: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Left match on (line, direction, planned time), without time tolerance.

    `index` gives the candidates of `active` if a caller has stored and counted them.
    """
    keyed = positions.select(
        "*",
        normalize_line(F.col("current_line")).alias("_line"),
        text_or_null(F.col("current_direction")).alias("_direction"),
        service_time(F.col("current_planned_time")).alias("_time"),
    )
    index = trip_candidates(active) if index is None else index
    joined = keyed.join(
        index,
        (keyed["_line"] == index["line"])
        & (keyed["_direction"] == index["direction"])
        & (keyed["_time"] == index["planned_time"]),
        "left",
    )
    missing = F.col("_line").isNull() | F.col("_direction").isNull() | F.col("_time").isNull()
    matched = F.col("n") == 1
    trip = ("feed_id", "trip_id", "route_id", "shape_id")
    kept = [c for c in positions.columns if c not in trip and not c.startswith("correlation_")]
    return joined.select(
        *[keyed[c] for c in kept],
        *[F.when(matched, F.col(f"only.{c}")).alias(c) for c in trip],
        F.when(matched, "matched").otherwise("fallback_required").alias("correlation_status"),
        F.when(missing, "missing_input")
        .when(F.col("n").isNull(), "no_exact_match")
        .when(matched, "unique_exact_match")
        .otherwise("ambiguous_exact_match")
        .alias("correlation_reason"),
        F.when(matched, F.lit(1)).alias("correlation_level"),
        F.coalesce(F.when(~missing, F.col("n")), F.lit(0)).cast("int").alias(
            "correlation_candidate_count"
        ),
    )
