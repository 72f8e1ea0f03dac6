"""Helpers of the training-data operators: tables, stored steps, column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrain.session import BROADCAST_BYTES, shared_dir, ship_package, small_side

__all__ = ["BROADCAST_BYTES", "let", "ship_package", "small_side", "stored", "table", "vocabulary", "without", "words_of"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written below the shared checkpoint folder and read again.

    Later steps read the files, so the loss of an executor repeats single tasks
    of the step at hand and never the steps before it.
    """
    folder = shared_dir(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def without(df: DataFrame, id_col: str, dropped: DataFrame, dropped_col: str) -> DataFrame:
    """`df` without the rows whose id `dropped`, a stored table, lists; rows without id stay."""
    return df.join(small_side(dropped.select(F.col(dropped_col).alias("__dropped")), 16), df[id_col] == F.col("__dropped"), "left_anti")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than blank and U+0009 to U+000D; null gives none."""
    blanks = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(blanks, " "), "")
