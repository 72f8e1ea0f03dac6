"""Assessment of measured travel times."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.functions.identity import metric_key
from fleetgrain.session import materialize

# Acceptance limits.
MAX_SPEED_KMH = 80.0
MIN_REFERENCES = 5
Z_LIMIT = 3.5
Z_SCALE = 0.6745
FLAT_TOLERANCE_SECONDS = 5.0
FLAT_TOLERANCE_SHARE = 0.10
REFERENCE_SECONDS = 3600
ASSESSMENT = "accepted boolean, weight double, rejection_reason string, reference_count int, reference_median double, reference_mad double, modified_z double"


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def array_median(values: Column) -> Column:
    """Median of a short array of doubles."""
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def assess_sample(df: DataFrame, references: str = "references") -> DataFrame:
    """Accept or reject a travel time against an array of reference durations."""
    usable = F.filter(references, lambda x: finite(x) & (x > 0))
    df = df.withColumn("_refs", F.coalesce(usable, F.array().cast("array<double>")))
    df = df.withColumn("_median", array_median(F.col("_refs")))
    spread = F.transform("_refs", lambda x: F.abs(x - F.col("_median")))
    df = df.withColumn("_mad", array_median(spread))
    duration, distance, n = F.col("duration_seconds"), F.col("distance_m"), F.size("_refs")
    valid = finite(duration) & finite(distance) & (duration > 0) & (distance > 0)
    too_fast = F.when(valid, distance / duration * 3.6 > MAX_SPEED_KMH).otherwise(F.lit(False))
    compared = valid & ~too_fast & (n >= MIN_REFERENCES)
    deviation = F.abs(duration - F.col("_median"))
    z = F.when(F.col("_mad") > 0, Z_SCALE * deviation / F.col("_mad"))
    flat_limit = F.greatest(F.lit(FLAT_TOLERANCE_SECONDS), F.col("_median") * FLAT_TOLERANCE_SHARE)
    outlier = compared & F.when(F.col("_mad") == 0, deviation > flat_limit).otherwise(z > Z_LIMIT)
    reason = (
        F.when(~valid, "invalid_measurement").when(too_fast, "speed_over_80").when(outlier, "mad_outlier")
    )
    weight = (
        F.when(reason.isNotNull(), 0.0)
        .when(n < MIN_REFERENCES, 0.5)
        .when(F.col("confidence") == "high", 1.0)
        .otherwise(0.5)
    )
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        reason.isNull().alias("accepted"),
        weight.alias("weight"),
        reason.alias("rejection_reason"),
        n.alias("reference_count"),
        F.when(compared, F.col("_median")).alias("reference_median"),
        F.when(compared, F.col("_mad")).alias("reference_mad"),
        F.when(compared, z).alias("modified_z"),
    )


#: What a metric key of `metric_identities` stands for.
KEYED = ("scope", "origin_stop_id", "destination_stop_id", "route_id", "direction_id")


def metric_identities(segments: DataFrame) -> DataFrame:
    """Each measured segment once per scope: physical, and by route and direction."""
    none_route = F.lit(None).cast("string")
    none_direction = F.lit(None).cast("int")
    scopes = F.array(
        F.struct(F.lit("physical").alias("scope"), none_route.alias("route_id"), none_direction.alias("direction_id")),
        F.struct(
            F.lit("service").alias("scope"), F.col("route_id").cast("string").alias("route_id"),
            F.col("direction_id").cast("int").alias("direction_id"),
        ),
    )
    kept = [c for c in segments.columns if c not in ("route_id", "direction_id")]
    origin, destination = F.col("origin_stop_id"), F.col("destination_stop_id")
    return (
        segments.filter((origin != "") & (destination != "") & (origin != destination))
        .select(*kept, F.explode(scopes).alias("i"))
        .select(*kept, "i.*")
        .filter(
            "scope = 'physical' OR (route_id IS NOT NULL AND route_id <> '' AND direction_id IS NOT NULL)"
        )
        .withColumn(
            "metric_key",
            metric_key(F.col("scope"), origin, destination, F.col("route_id"), F.col("direction_id")),
        )
    )


def _deviation_median(ordered: list[float], median: float) -> float:
    """Median of |x - median| over a sorted list, by selection on its two halves."""
    n = len(ordered)
    middle = bisect_left(ordered, median)

    def smallest(k: int) -> float:
        # `left` elements come from below the median, the rest from above it
        lo, hi = max(0, k - (n - middle)), min(k, middle)
        while lo < hi:
            left = (lo + hi) // 2
            right = k - left
            if median - ordered[middle - 1 - left] < ordered[middle + right - 1] - median:
                lo = left + 1
            else:
                hi = left
        left, right = lo, k - lo
        below = median - ordered[middle - left] if left else -1.0
        above = ordered[middle + right - 1] - median if right else -1.0
        return max(below, above)

    return (smallest((n + 1) // 2) + smallest(n // 2 + 1)) / 2


def _judge(duration: float, distance: float, high: bool, ordered: list[float]) -> tuple:
    n = len(ordered)
    if not (np.isfinite(duration) and np.isfinite(distance) and duration > 0 and distance > 0):
        return False, 0.0, "invalid_measurement", n, None, None, None
    if distance / duration * 3.6 > MAX_SPEED_KMH:
        return False, 0.0, "speed_over_80", n, None, None, None
    if n < MIN_REFERENCES:
        return True, 0.5, None, n, None, None, None
    median = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    mad = _deviation_median(ordered, median)
    off = abs(duration - median)
    if mad == 0:
        z, outlier = None, off > max(FLAT_TOLERANCE_SECONDS, median * FLAT_TOLERANCE_SHARE)
    else:
        z = Z_SCALE * off / mad
        outlier = z > Z_LIMIT
    if outlier:
        return False, 0.0, "mad_outlier", n, median, mad, z
    return True, 1.0 if high else 0.5, None, n, median, mad, z


class ReferenceWindow:
    """Accepted durations of the trailing hour, kept in order of value."""

    def __init__(self, kept: list[tuple[int, float]] | None = None) -> None:
        self.recent: deque[tuple[int, float]] = deque(kept or [])
        self.ordered = sorted(value for _, value in self.recent)

    def assess(self, at_micros: int, duration: float, distance: float, confidence: str) -> tuple:
        limit = at_micros - REFERENCE_SECONDS * 1_000_000
        while self.recent and self.recent[0][0] <= limit:
            _, old = self.recent.popleft()
            del self.ordered[bisect_left(self.ordered, old)]
        verdict = _judge(duration, distance, confidence == "high", self.ordered)
        if verdict[0]:
            self.recent.append((at_micros, duration))
            insort(self.ordered, duration)
        return verdict


_VERDICT_COLUMNS = (
    "accepted", "weight", "rejection_reason", "reference_count",
    "reference_median", "reference_mad", "modified_z",
)


def _fold_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold over a partition sorted by key, run of chunks and completion, batch by batch.

    Rows marked `_assumed` were accepted in the chunk before the run; they enter the window and go no further.
    """
    current, window = None, ReferenceWindow()
    for frame in frames:
        verdicts = []
        rows = zip(
            frame["metric_key"], frame["_run"], frame["_assumed"], frame["completed_micros"],
            frame["duration_seconds"], frame["distance_m"], frame["confidence"],
        )
        for key, run, assumed, at, duration, distance, confidence in rows:
            if current != (key, run):
                current, window = (key, run), ReferenceWindow()
            if assumed:
                window.recent.append((int(at), duration))
                insort(window.ordered, duration)
            else:
                verdicts.append(window.assess(int(at), duration, distance, confidence))
        own = frame[~frame["_assumed"].astype(bool)]
        judged = pd.DataFrame(verdicts, columns=list(_VERDICT_COLUMNS), index=own.index)
        yield pd.concat([own, judged], axis=1)


_CHUNK = ["metric_key", "_chunk"]
_RUN = ["metric_key", "_run"]
#: Chunks that a run may hold, by how much more in each round.
RUN_GROWTH = 8


def _runs(chunks: DataFrame, length: int) -> DataFrame:
    """Adds `_run`, the first chunk of its run: chunks that follow each other, `length` at most."""
    order = Window.partitionBy("metric_key").orderBy("_chunk")
    island = chunks.withColumn("_island", F.col("_chunk") - F.row_number().over(order))
    first = F.min("_chunk").over(Window.partitionBy("metric_key", "_island"))
    into = F.pmod(F.col("_chunk") - first, F.lit(length))
    return island.select(*_CHUNK, (F.col("_chunk") - into).alias("_run"))


def _fold_runs(own: DataFrame, assumed: DataFrame) -> DataFrame:
    """Verdicts of the rows of `own`; `assumed` are accepted rows of the chunks before their runs."""
    given = {"metric_key": F.col("metric_key"), "_chunk": F.col("_chunk"), "_run": F.col("_chunk") + 1, "completed_micros": F.col("completed_micros"), "duration_seconds": F.col("duration_seconds")}
    # numbers stay whole in pandas only where none is null
    fill = lambda f: F.lit(0 if f.dataType.typeName() in ("integer", "long", "short", "byte") else None).cast(f.dataType)
    before = assumed.select(*[given.get(f.name, fill(f)).alias(f.name) for f in own.schema])
    both = own.withColumn("_assumed", F.lit(False)).unionByName(before.withColumn("_assumed", F.lit(True)))
    line = both.repartition(*_RUN).sortWithinPartitions(*_RUN, "completed_micros", "duration_seconds", "distance_m", "confidence")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in line.schema)
    return line.mapInPandas(_fold_sorted, f"{fields}, {ASSESSMENT}").drop("_assumed")


def _signatures(rows: DataFrame) -> DataFrame:
    """What tells two sets of accepted rows of a chunk apart."""
    mark = F.xxhash64("completed_micros", "duration_seconds")
    return rows.groupBy(*_CHUNK).agg(F.struct(F.count("*"), F.bit_xor(mark), F.sum(mark.bitwiseAND(0xFFFFFFFF))).alias("signature"))


def accept_in_rounds(observations: DataFrame) -> tuple[DataFrame, int]:
    """`accept_sequentially` and the number of rounds it took.

    References live one hour, so what an hour of a key decides depends on the accepted rows of
    the hour before and on nothing older. All hours are folded at once from an assumption: first
    that the hour before accepted all rows that are valid and not too fast, later what it did
    accept. Hours whose assumption proves different are folded again, until none is left. Those
    that follow each other are then folded as one run, whose hours need no assumption but the
    first, and hours behind them are taken along, twice as many in each round. A run may hold
    eight times as many hours in each round, so the rounds grow with the logarithm of a key's
    hours however often an hour changes what the next accepts.
    """
    columns = observations.columns
    at = F.unix_micros("completed_at")
    rows = materialize(observations.withColumns({"completed_micros": at, "_chunk": F.floor(at / (REFERENCE_SECONDS * 1_000_000))}))
    duration, distance = F.col("duration_seconds"), F.col("distance_m")
    valid = finite(duration) & finite(distance) & (duration > 0) & (distance > 0)
    chunks = rows.select(*_CHUNK).distinct()
    assumed = rows.where(valid & (distance / duration * 3.6 <= MAX_SPEED_KMH))
    believed = materialize(_signatures(assumed))
    folded = [materialize(_fold_runs(rows.withColumn("_run", F.col("_chunk")), assumed))]
    newest, todo = None, None
    while True:
        done = folded[-1]
        renewed = _signatures(done.where("accepted"))
        # chunks of the last round, and what the others accepted before
        again = done.select(*_CHUNK).distinct()
        found = materialize(renewed if newest is None else believed.join(again, _CHUNK, "left_anti").unionByName(renewed))
        old, new = believed.withColumnRenamed("signature", "old"), found.withColumnRenamed("signature", "new")
        differ = old.join(new, _CHUNK, "full").where(~F.col("old").eqNullSafe(F.col("new")))
        next_ = differ.select("metric_key", (F.col("_chunk") + 1).alias("_chunk")).join(chunks, _CHUNK, "left_semi")
        if todo is not None:
            # inside a run nothing was assumed
            next_ = next_.join(todo.where("_chunk > _run"), _CHUNK, "left_anti")
        next_ = materialize(next_)
        settled = next_.isEmpty()
        if not settled:
            # what differs may go on differing: hours behind are folded as well, twice as many in each round
            behind = F.explode(F.sequence(F.col("_chunk"), F.col("_chunk") + 2 ** (len(folded) - 1) - 1)).alias("_chunk")
            wanted = next_.select("metric_key", behind).distinct().join(chunks, _CHUNK, "left_semi")
            todo = materialize(_runs(wanted, RUN_GROWTH ** len(folded)))
        last = again.withColumn("_round", F.lit(len(folded) - 1))
        newest = materialize(last if newest is None else newest.join(again, _CHUNK, "left_anti").unionByName(last))
        versions = reduce(DataFrame.unionByName, [df.withColumn("_round", F.lit(k)) for k, df in enumerate(folded)])
        judged = versions.join(newest, [*_CHUNK, "_round"], "left_semi")
        if settled:
            return judged.select(*columns, *_VERDICT_COLUMNS), len(folded)
        before = todo.where("_chunk = _run").select("metric_key", (F.col("_chunk") - 1).alias("_chunk"))
        accepted = judged.where("accepted").join(before, _CHUNK, "left_semi").select(rows.columns)
        folded.append(materialize(_fold_runs(rows.join(todo, _CHUNK), accepted)))
        believed = found


def accept_sequentially(observations: DataFrame) -> DataFrame:
    """Assess per metric key in completion order; accepted ones become references for an hour.

    Acceptance depends on earlier acceptance, so this is a fold; `accept_in_rounds` runs the
    hours of a key in parallel, then runs of hours. A task streams its sorted rows and holds
    the references of one hour.
    """
    return accept_in_rounds(observations)[0]


def assessment_counters(assessed: DataFrame, keys: list[str]) -> DataFrame:
    """Completed by confidence, accepted, and rejected by reason."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    reason = F.col("rejection_reason")
    return assessed.groupBy(*keys).agg(
        F.count("*").alias("written"),
        flag(F.col("confidence") == "high").alias("completed_high"),
        flag(F.col("confidence") == "reduced").alias("completed_reduced"),
        flag(F.col("accepted")).alias("accepted"),
        flag(reason == "speed_over_80").alias("rejected_speed"),
        flag(reason == "mad_outlier").alias("rejected_mad"),
        flag(reason == "invalid_measurement").alias("rejected_invalid"),
    )
