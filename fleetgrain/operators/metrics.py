"""Five-minute travel-time metrics: live, daily and seven-day profiles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.functions.status import metric_status, reliability
from fleetgrain.functions.times import (
    HISTORY_DAYS,
    WINDOW_MICROS,
    at_lit,
    date_lit,
    day_type,
    service_date,
    slot_index,
    window_start,
)
from fleetgrain.operators.samples import finite
from fleetgrain.session import small_side

IDENTITY = ("scope", "origin_stop_id", "destination_stop_id", "route_id", "direction_id", "source_feed_id")
LIVE_SECONDS = 3600


def window_statistics(samples: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Weighted moments, exact unweighted median and counts in one aggregation.

    Sums are partial before the shuffle, so a hot key costs little. The second
    moment is formed algebraically around the mean; durations are minutes to
    hours, for which double precision leaves far more digits than are kept.
    """
    duration, weight = F.col("duration_seconds"), F.col("weight")
    ok = F.coalesce(F.col("accepted"), F.lit(False)) & finite(duration) & finite(weight) & (weight > 0)
    x, w = F.when(ok, duration), F.when(ok, weight)
    sums = samples.groupBy(*keys).agg(
        F.count("*").alias("sample_count_total"),
        F.count(x).alias("sample_count_accepted"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("accepted_weight"),
        F.sum(x * w).alias("_wx"),
        F.sum(x * x * w).alias("_wxx"),
        F.median(x).alias("median_seconds"),
        F.min(x).alias("minimum_seconds"),
        F.max(x).alias("maximum_seconds"),
        F.max("completed_at").alias("last_completed_at"),
        *(extra or []),
    )
    mean = F.when(F.col("accepted_weight") > 0, F.col("_wx") / F.col("accepted_weight"))
    m2 = F.when(
        F.col("accepted_weight") > 0,
        F.greatest(F.lit(0.0), F.col("_wxx") - F.col("_wx") * F.col("mean_seconds")),
    ).otherwise(F.lit(0.0))
    counted = (F.col("accepted_weight"), F.col("sample_count_accepted"), F.col("sample_count_total"))
    return (
        sums.withColumn("sample_count_rejected", F.col("sample_count_total") - F.col("sample_count_accepted"))
        .withColumn("mean_seconds", mean)
        .withColumn("m2_seconds", m2)
        .withColumn(
            "standard_deviation_seconds",
            F.when(F.col("accepted_weight") > 0, F.sqrt(F.col("m2_seconds") / F.col("accepted_weight"))),
        )
        .withColumn("reliability", reliability(*counted))
        .withColumn("status", metric_status(*counted))
        .drop("_wx", "_wxx")
    )


def _identity(df: DataFrame, by: Sequence[str] = ()) -> list[Column]:
    """Descriptive columns of the newest row of the group, but for those it is grouped by."""
    present = [c for c in IDENTITY if c in df.columns and c not in by]
    return [F.max_by(c, "completed_at").alias(c) for c in present]


def live_metrics(observations: DataFrame, by: Sequence[str] = (), at: Column | str | None = None) -> DataFrame:
    """Statistics of the newest window per metric key, one row per key.

    With `at`, only of keys whose newest window can still be used then or later: a key's
    windows of the hour hold its newest one, or it has none that is young enough.

    Rows are ranked by window, so every task drops older windows before the shuffle and only
    rows of the newest reach the statistics. `by` names columns that the metric key
    determines: rows that are dealt by some of them are not shuffled again.
    """
    stamped = observations.withColumn("window_start", window_start(F.col("completed_at")))
    if at is not None:
        end = F.unix_micros("window_start") + WINDOW_MICROS
        stamped = stamped.where(end >= F.unix_micros(at_lit(at)) - LIVE_SECONDS * 1_000_000)
    newest = Window.partitionBy(*by, "metric_key").orderBy(F.desc("window_start"))
    rows = stamped.where("window_start IS NOT NULL").withColumn("_rank", F.rank().over(newest)).where("_rank = 1")
    stats = window_statistics(rows, [*by, "metric_key", "window_start"], _identity(observations, by))
    return stats.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 5 MINUTES"))


def daily_metrics(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Statistics per key, service date and slot, with mergeable moments; `by` as in `live_metrics`."""
    at = F.col("completed_at")
    slotted = observations.select(
        "*", service_date(at).alias("service_date"), slot_index(at).alias("slot_index"),
        day_type(at).alias("day_type"),
    )
    return window_statistics(
        slotted, [*by, "metric_key", "service_date", "slot_index", "day_type"], _identity(observations, by)
    )


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge (count, weight, mean, m2, min, max) parts; empty parts are ignored."""
    usable = (F.col("count") > 0) & (F.col("weight_sum") > 0) & F.col("mean").isNotNull()
    w, mean = F.col("weight_sum"), F.col("mean")
    merged = parts.filter(usable).groupBy(*keys).agg(
        F.sum("count").alias("count"),
        F.sum(w).alias("weight_sum"),
        F.sum(w * mean).alias("_wx"),
        F.sum(F.col("m2") + w * mean * mean).alias("_wxx"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
    )
    return (
        merged.withColumn("mean", F.col("_wx") / F.col("weight_sum"))
        .withColumn("m2", F.greatest(F.lit(0.0), F.col("_wxx") - F.col("_wx") * F.col("mean")))
        .withColumn("standard_deviation", F.sqrt(F.col("m2") / F.col("weight_sum")))
        .drop("_wx", "_wxx")
    )


def reference_period(day: date) -> tuple[date, date]:
    return day - timedelta(days=HISTORY_DAYS), day - timedelta(days=1)


def rolling_profile(daily: DataFrame, day: date, by: Sequence[str] = ()) -> DataFrame:
    """Seven dates before `day` merged per key, day type and slot; `by` as in `live_metrics`."""
    start, end = reference_period(day)
    window = daily.filter(F.col("service_date").between(date_lit(start), date_lit(end)))
    w, mean = F.col("accepted_weight"), F.col("mean_seconds")
    merged = window.groupBy(*by, "metric_key", "day_type", "slot_index").agg(
        F.sum("sample_count_total").alias("sample_count_total"),
        F.sum("sample_count_accepted").alias("sample_count_accepted"),
        F.sum("sample_count_rejected").alias("sample_count_rejected"),
        F.sum(w).alias("accepted_weight"),
        F.sum(w * mean).alias("_wx"),
        F.sum(F.when(mean.isNotNull(), F.col("m2_seconds") + w * mean * mean)).alias("_wxx"),
        F.min("minimum_seconds").alias("minimum_seconds"),
        F.max("maximum_seconds").alias("maximum_seconds"),
        F.max("last_completed_at").alias("last_completed_at"),
        *[F.max_by(c, "last_completed_at").alias(c) for c in IDENTITY if c in daily.columns and c not in by],
    )
    counted = (F.col("accepted_weight"), F.col("sample_count_accepted"), F.col("sample_count_total"))
    m2 = F.greatest(F.lit(0.0), F.col("_wxx") - F.col("_wx") * F.col("mean_seconds"))
    return (
        merged.withColumn("mean_seconds", F.when(w > 0, F.col("_wx") / w))
        .withColumn("m2_seconds", F.coalesce(F.when(w > 0, m2), F.lit(0.0)))
        .withColumn("standard_deviation_seconds", F.when(w > 0, F.sqrt(F.col("m2_seconds") / w)))
        .withColumn("reliability", reliability(*counted))
        .withColumn("reference_start_date", date_lit(start))
        .withColumn("reference_end_date", date_lit(end))
        .drop("_wx", "_wxx")
    )


def unmaterialized_windows(observations: DataFrame, daily: DataFrame, at: Column | str) -> DataFrame:
    """Unexpired observations whose daily window is missing: newest per key.

    One aggregate to (key, window) before the anti join keeps it small; every
    missing window can be read from the same rows (`all_unmaterialized`).
    """
    return all_unmaterialized(observations, daily, at).groupBy("metric_key").agg(
        F.max("completed_at").alias("completed_at")
    )


def all_unmaterialized(observations: DataFrame, daily: DataFrame, at: Column | str) -> DataFrame:
    ts = F.col("completed_at")
    live = observations.filter(ts > at_lit(at) - F.expr("INTERVAL 1 HOUR"))
    windows = live.groupBy(
        "metric_key", service_date(ts).alias("service_date"), slot_index(ts).alias("slot_index")
    ).agg(F.max(ts).alias("completed_at"))
    return windows.join(daily, ["metric_key", "service_date", "slot_index"], "left_anti")


def metrics_for_keys(
    metrics: DataFrame, keys: DataFrame, at: Column | str | None = None, day: date | None = None
) -> DataFrame:
    """Usable metrics of the requested keys, a stored table: live up to `at`, or the exact period of `day`."""
    usable = metrics.filter("sample_count_accepted > 0 AND mean_seconds IS NOT NULL")
    if at is not None:
        usable = usable.filter(F.col("window_start") <= at_lit(at))
    if day is not None:
        start, end = reference_period(day)
        usable = usable.filter(
            (F.col("reference_start_date") == date_lit(start))
            & (F.col("reference_end_date") == date_lit(end))
        )
    return usable.join(small_side(keys.select("metric_key"), 96), "metric_key", "left_semi")
