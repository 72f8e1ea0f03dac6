"""Ordered computations that split a hot key over many tasks.

A plain window puts all rows of a key into one task. Here the order is cut
into chunks (say, hours): windows run inside (key, chunk), one small row per
chunk is carried forward, and the carry is joined back. The rows are shuffled
once; a key with a third of the data spreads over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hour_chunk(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 3_600_000_000)


def carry_forward(
    df: DataFrame, keys: list[str], chunk: str, aggregates: dict[str, Column], carried: dict[str, Column]
) -> DataFrame:
    """Join to every row what the earlier chunks of its key leave behind.

    `aggregates` summarise a chunk; `carried` are window expressions over the
    chunk summaries and see only earlier chunks (`Window` is applied here). Chunks that
    nothing is left to, such as the first of a key, are not sent back to their rows.
    """
    order = Window.partitionBy(*keys).orderBy(chunk)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*keys, chunk).agg(*[a.alias(n) for n, a in aggregates.items()])
    carry = summary.select(*keys, chunk, *[c.over(earlier).alias(n) for n, c in carried.items()]).filter(_any_known(carried))
    return df.join(carry, [*keys, chunk], "left")


def _any_known(names: Iterable[str]) -> Column:
    return reduce(or_, [F.col(n).isNotNull() for n in names])


def two_previous(df: DataFrame, keys: list[str], chunk: str, order: list[str], fields: list[str]) -> DataFrame:
    """Adds structs `prev_1` and `prev_2` with the two rows before each row."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    row = F.struct(*fields)
    lagged = df.select(
        "*",
        F.lag(row, 1).over(inside).alias("_l1"),
        F.lag(row, 2).over(inside).alias("_l2"),
        F.row_number().over(inside).alias("_rn"),
    )
    tail = F.max_by(F.struct(row.alias("last"), F.col("_l1").alias("before")), F.struct(*order))
    summary = lagged.groupBy(*keys, chunk).agg(tail.alias("tail"))
    by_chunk = Window.partitionBy(*keys).orderBy(chunk)
    carry = summary.select(
        *keys, chunk,
        F.lag("tail.last", 1).over(by_chunk).alias("_c1"),
        F.coalesce(
            F.lag("tail.before", 1).over(by_chunk), F.lag("tail.last", 2).over(by_chunk)
        ).alias("_c2"),
    ).filter(_any_known(["_c1", "_c2"]))
    joined = lagged.join(carry, [*keys, chunk], "left")
    return joined.select(
        *df.columns,
        F.when(F.col("_rn") == 1, F.col("_c1")).otherwise(F.col("_l1")).alias("prev_1"),
        F.when(F.col("_rn") == 1, F.col("_c2"))
        .when(F.col("_rn") == 2, F.col("_c1"))
        .otherwise(F.col("_l2"))
        .alias("prev_2"),
    )


def max_before(
    df: DataFrame, keys: list[str], chunk: str, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Adds the maximum of `value` over all earlier rows of the key."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    columns = df.columns
    valued = df.withColumn("_v", value).withColumn("_w", F.max("_v").over(earlier))
    carried = carry_forward(valued, keys, chunk, {"_m": F.max("_v")}, {"_c": F.max("_m")})
    # greatest() does not take structs, so pick by comparison
    merged = F.when(F.col("_w").isNull(), F.col("_c")).when(
        F.col("_c").isNull() | (F.col("_w") >= F.col("_c")), F.col("_w")
    ).otherwise(F.col("_c"))
    return carried.select(*columns, merged.alias(name))


def last_until(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str
) -> DataFrame:
    """Adds the last non-null `value` up to and including each row."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    columns = df.columns
    valued = df.withColumn("_v", value).withColumn("_w", F.last("_v", ignorenulls=True).over(inside))
    tail = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    carried = carry_forward(
        valued, keys, chunk, {"_m": tail}, {"_c": F.last("_m", ignorenulls=True)}
    )
    return carried.select(*columns, F.coalesce("_w", "_c").alias(name))


def running_sum(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str
) -> DataFrame:
    """Adds the sum of `value` up to and including each row."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    columns = df.columns
    valued = df.withColumn("_v", value).withColumn("_w", F.sum("_v").over(inside))
    carried = carry_forward(valued, keys, chunk, {"_m": F.sum("_v")}, {"_c": F.sum("_m")})
    return carried.select(*columns, (F.col("_w") + F.coalesce("_c", F.lit(0))).alias(name))


MEDIAN = ("(n - 1) div 2", "n div 2")


def nearest_rank(percent: int) -> tuple[str, str]:
    """Zero-based rank ceil(p·n) - 1, in integer arithmetic."""
    rank = f"(n * {percent} + 99) div 100 - 1"
    return rank, rank


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, str]], buckets: int = 256
) -> DataFrame:
    """Exact quantiles per group without gathering a group in one place.

    Equal values are counted first. A per-group histogram over the value range, on a
    logarithmic scale so that an outlier leaves the others apart, finds the buckets
    with the wanted ranks; only those are ordered. `wanted`
    maps a name to a pair of ranks (SQL over `n`) whose values are averaged.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_x"))
        .agg(F.count("*").alias("_k"))
    )
    span = counted.groupBy(*keys).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_k").alias("n")
    )
    low, width = _spread(F.col("_lo")), _spread(F.col("_hi")) - _spread(F.col("_lo"))
    share = F.floor((_spread(F.col("_x")) - low) / width * buckets)
    bucket = F.when(width > 0, F.least(F.lit(buckets - 1), share)).otherwise(F.lit(0))
    placed = _null_safe(counted, span, keys).withColumn("_b", bucket)
    per_bucket = placed.groupBy(*keys, "_b").agg(F.sum("_k").alias("_kb"), F.max("n").alias("n"))
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranks = [r for pair in wanted.values() for r in pair]
    holds = " OR ".join(f"(_before <= {r} AND _before + _kb > {r})" for r in ranks)
    chosen = (
        per_bucket.withColumn("_before", F.coalesce(F.sum("_kb").over(running), F.lit(0)))
        .filter(holds)
        .select(*keys, "_b", "_before")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _null_safe(placed, chosen, [*keys, "_b"]).withColumn(
        "_from", F.col("_before") + F.coalesce(F.sum("_k").over(inside), F.lit(0))
    )

    def at(rank: str) -> Column:
        return F.max(F.when(F.expr(f"_from <= {rank} AND _from + _k > {rank}"), F.col("_x")))

    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[((at(low) + at(high)) / 2).alias(name) for name, (low, high) in wanted.items()],
    )


def _spread(x: Column) -> Column:
    """Signed logarithm of one plus the size; it never falls where x rises."""
    number = x.cast("double")
    return F.signum(number) * F.log1p(F.abs(number))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join keeping null keys as their own group; no keys means one-row `right`."""
    if not keys:
        extra = [c for c in right.columns]
        packed = right.select(F.struct(*extra).alias("_one"))
        return left.withColumn("_one", packed.scalar()).select(*left.columns, *[f"_one.{c}" for c in extra])
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_r_{key}"])
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])
