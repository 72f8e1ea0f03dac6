"""Keyed tables whose updates rewrite only the buckets that hold their keys.

A key lies in the bucket that its hash names, so an update of n keys touches at most n
buckets, whatever the size of the table. Touched buckets are merged into a folder of the
update's own; a small file for each version, created only if it does not exist yet, then
names the folder of every bucket. Until that moment readers see the version before, so a
failure leaves the old table, and of two updates from one version the later one is refused.
A rewritten bucket is one file again, so the number of files stays that of the buckets.

Null keys are equal to one another. An update without rows makes no version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from fleetgrain.session import materialize
from fleetgrain.sources.loads import _create, _open, _read
from fleetgrain.sources.tables import upsert

VERSIONS, DATA, BUCKET = "_versions", "data", "__bucket"


class Conflict(RuntimeError):
    """Another update was published from the same version; nothing was changed."""


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _open(spark, f"{path}/{VERSIONS}")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())


def _current(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the newest whole version; torn ones are passed over."""
    for number in reversed(_numbers(spark, path)):
        content = _read(spark, f"{path}/{VERSIONS}/{number:012d}")
        if content is not None:
            return number, content
    return -1, None


def _rows(spark: SparkSession, path: str, version: dict, wanted: set[int] | None = None) -> DataFrame:
    paths = [f"{path}/{DATA}/{folder}/{BUCKET}={b}" for b, folder in version["folders"].items() if wanted is None or int(b) in wanted]
    schema = StructType.fromJson(version["schema"])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_merged(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, or None if there is none."""
    _, version = _current(spark, path)
    return None if version is None else _rows(spark, path, version)


def merge_into(
    spark: SparkSession, path: str, updates: DataFrame, keys: list[str], newer: Column | None = None, ties: bool = False, buckets: int = 64,
) -> list[int]:
    """Apply `updates` by the rules of `upsert`; gives the buckets that were rewritten.

    The first update sets schema, keys and number of buckets: choose it so that a bucket of
    the full table fits a task. Later updates are cast to that schema.
    """
    number, version = _current(spark, path)
    if version is None:
        version = {"schema": updates.schema.jsonValue(), "keys": keys, "buckets": buckets, "folders": {}}
    if version["keys"] != keys:
        raise ValueError(f"the table's keys are {version['keys']}")
    schema = StructType.fromJson(version["schema"])
    if any(isinstance(schema[k].dataType, (FloatType, DoubleType)) for k in keys):
        raise ValueError("keys of floating point have several forms of one value")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(version["buckets"])).cast("int")
    given = materialize(updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))
    # at most as many rows as buckets
    touched = sorted(r[0] for r in given.select(bucket.alias(BUCKET)).distinct().collect())
    if not touched:
        return []
    merged = upsert(_rows(spark, path, version, set(touched)), given, keys, newer, ties)
    folder = uuid.uuid4().hex
    merged.withColumn(BUCKET, bucket).repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{DATA}/{folder}")
    content = version | {"folders": version["folders"] | {str(b): folder for b in touched}}
    if not _create(spark, f"{path}/{VERSIONS}/{number + 1:012d}", content):
        raise Conflict(f"version {number + 1} of {path}")
    return touched


def remove_old(spark: SparkSession, path: str, older_than_ms: int, keep: int = 1) -> int:
    """Remove all versions but the newest `keep`, and bucket folders that none of these names.

    Only folders last written before a point in time go, so that updates at work keep theirs.
    """
    whole = [(n, v) for n in _numbers(spark, path) if (v := _read(spark, f"{path}/{VERSIONS}/{n:012d}")) is not None]
    used = {(folder, f"{BUCKET}={b}") for _, v in whole[-keep:] for b, folder in v["folders"].items()}
    root, fs = _open(spark, f"{path}/{DATA}")
    for n, _ in whole[:-keep]:
        fs.delete(_open(spark, f"{path}/{VERSIONS}/{n:012d}")[0], False)
    removed = 0
    for status in fs.listStatus(root) if fs.exists(root) else []:
        if status.getModificationTime() >= older_than_ms:
            continue
        for part in fs.listStatus(status.getPath()):
            if part.isDirectory() and (status.getPath().getName(), part.getPath().getName()) not in used:
                fs.delete(part.getPath(), True)
                removed += 1
    return removed
