"""Table upkeep: upsert, expiry, run audit and GeoJSON export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrain.functions.geo import line_geojson, point_geojson
from fleetgrain.functions.times import at_lit
from fleetgrain.session import materialize


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], newer: Column | None = None, ties: bool = False) -> DataFrame:
    """Rows of `target` with `updates` applied: insert, or replace on equal keys.

    With `newer`, an update replaces only a row whose `newer` value is
    strictly smaller, or equal with `ties`. One aggregate decides per key, so both sides are
    combined before the shuffle and no key is ever sorted.
    """
    columns = target.columns
    order = newer if newer is not None else F.lit(0)
    value = F.struct(*[F.col(c) for c in columns])
    # on a tie the update wins without a guard and loses with one
    priority = 0 if newer is not None and not ties else 1
    old = target.select(*keys, value.alias("row"), F.struct(order.alias("o"), F.lit(1 - priority).alias("p")).alias("rank"))
    new = updates.select(*columns).select(
        *keys, value.alias("row"), F.struct(order.alias("o"), F.lit(priority).alias("p")).alias("rank")
    )
    merged = old.unionByName(new).groupBy(*keys).agg(F.max_by("row", "rank").alias("row"))
    return merged.select("row.*")


def overwrite_upsert(
    spark: SparkSession, path: str, updates: DataFrame, keys: list[str], newer: Column | None = None,
    partition: str | None = None, ties: bool = False,
) -> None:
    """Upsert into a Parquet table as a new version folder, then point to it.

    Readers always see a complete version (`read_current`); a lost executor or
    a failed job leaves the old pointer in place. With `partition`, only the
    touched partitions are rewritten.
    """
    if partition:
        touched = updates.select(partition).distinct()
        current = _read_or_empty(spark, path, updates)
        affected = current.join(touched, partition, "left_semi")
        merged = materialize(upsert(affected, updates, keys, newer, ties))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            partition
        ).parquet(path)
        return
    current = read_current(spark, path)
    # repeated keys of the updates meet each other on the first write as well
    merged = upsert(updates.limit(0) if current is None else current, updates, keys, newer, ties)
    version = _next_version(spark, path)
    merged.write.mode("overwrite").parquet(f"{path}/v{version:012d}")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Version folders whose write committed, oldest first."""
    folder, fs = _fs(spark, path)
    if not fs.exists(folder):
        return []
    done = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        marker, _ = _fs(spark, f"{path}/{name}/_SUCCESS")
        if name.startswith("v") and fs.exists(marker):
            done.append(name)
    return sorted(done)


def _next_version(spark: SparkSession, path: str) -> int:
    versions = _versions(spark, path)
    return int(versions[-1][1:]) + 1 if versions else 0


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/{versions[-1]}") if versions else None


def _read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    folder, fs = _fs(spark, path)
    if not fs.exists(folder):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)


def expire(df: DataFrame, ts_col: str, at: Column | str, keep: str) -> DataFrame:
    """Rows younger than `keep` (an interval such as '1 HOUR') at `at`."""
    return df.filter(F.col(ts_col) > at_lit(at) - F.expr(f"INTERVAL {keep}"))


def expire_dates(df: DataFrame, date_col: str, day: str, days: int = 7) -> DataFrame:
    """Daily rows not older than `days` before `day`; prunes a partitioned table."""
    return df.filter(F.col(date_col) >= F.date_sub(F.lit(day).cast("date"), days))


def to_geojson(df: DataFrame, geometry: Column, properties: Sequence[str], identity: str) -> DataFrame:
    """One GeoJSON feature text per row."""
    # the geometry is JSON text already; splice it in rather than re-parse numbers
    shell = F.to_json(
        F.struct(F.lit("Feature").alias("type"), F.col(identity).alias("id"), F.struct(*properties).alias("properties"))
    )
    text = F.concat(F.regexp_replace(shell, r"\}$", ""), F.lit(',"geometry":'), geometry, F.lit("}"))
    return df.select(identity, text.alias("feature"))


def line_features(lines: DataFrame, properties: Sequence[str], identity: str) -> DataFrame:
    return to_geojson(lines, line_geojson(F.col("points")), properties, identity)


def point_features(points: DataFrame, properties: Sequence[str], identity: str) -> DataFrame:
    geometry = point_geojson(F.col("longitude"), F.col("latitude"))
    return to_geojson(points, geometry, properties, identity)


def segment_features(speed_map: DataFrame, show_planned: bool) -> DataFrame:
    """Speed-map segments with geometry text; planned ones only when asked for."""
    shown = speed_map if show_planned else speed_map.filter("source <> 'gtfs_planned'")
    named = shown.withColumn("segment_id", F.concat_ws(">", "origin_stop_id", "destination_stop_id"))
    return to_geojson(named, F.col("geometry"), ["source", "speed_kmh"], "segment_id")


def run_status(rejected: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(rejected > 0, "partial").otherwise("succeeded")


def run_audit(counters: DataFrame, at: Column | str) -> DataFrame:
    """Audit rows per payload: partial with any rejection, failed without records to read."""
    unreadable = F.col("received").isNull()
    return counters.select(
        "batch_id", at_lit(at).alias("finished_at"),
        run_status(F.coalesce("rejected", F.lit(0)), unreadable).alias("status"),
        F.coalesce("received", F.lit(0)).alias("records_received"),
        (F.coalesce("received", F.lit(0)) - F.coalesce("rejected", F.lit(0)) - F.coalesce("duplicate_prefixes", F.lit(0))).alias("records_written"),
        F.coalesce("rejected", F.lit(0)).alias("records_rejected"),
        F.coalesce("duplicate_prefixes", F.lit(0)).alias("duplicate_prefixes"),
        F.coalesce("invalid_locations", F.lit(0)).alias("invalid_locations"),
        F.coalesce("invalid_timestamps", F.lit(0)).alias("invalid_timestamps"),
    )
