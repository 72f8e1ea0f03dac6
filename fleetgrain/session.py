"""Session settings shared by jobs, tests and the registered queries."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import partial
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OPERATIONAL_TZ = "America/Sao_Paulo"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
#: Compressed bytes of a shuffled partition; in a sort its rows take ten times that and more.
PARTITION_BYTES = "16m"


def build_session(master: str = "local[8]", app: str = "fleetgrain", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter supplies one."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what the operators rely on; all of it is runtime configuration.

    Timestamps are instants and local fields always go through an explicit
    zone, so the session zone is fixed to UTC. State goes to RocksDB so keyed
    streams are not bounded by executor heap. Shuffled partitions are joined up to
    `PARTITION_BYTES` only, as a task sorts for several windows and joins at once.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session.

    The driver's path is not theirs: without it their Python tasks find the package only
    where the working folder happens to hold it.
    """
    context = spark.sparkContext
    if getattr(context, "_fleetgrain_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="fleetgrain-zip-")) / "fleetgrain_tasks.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    context._fleetgrain_sent = True


def ensure_checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names, also set for `checkpoint()`.

    Only a local session may go without: it gets a temporary folder. On a cluster the
    executors would each write to a disk of their own, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return base or current.get()
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fleetgrain-")
    spark.sparkContext.setCheckpointDir(base)
    return base


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Codec of stored steps; they are written once, read a few times and mostly numbers.
STEP_CODEC = "zstd"
_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files as soon as they have ended.

    A write has a plan of its own that nothing runs again. Otherwise its files stay until a
    garbage collection of the driver finds the plan gone, however full the disks are by then.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _step_dir(spark: SparkSession) -> str:
    folder = shared_dir(spark, "step")
    if (stored := _steps.get()) is not None:
        stored.append(folder)
    return folder


def _step(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    df = spark.read.schema(schema).parquet(folder)
    df._step = folder
    return df


def step_of(df: DataFrame) -> str | None:
    """The folder of a frame that is a stored step, as the steps below return it."""
    return getattr(df, "_step", None)


def _append(df: DataFrame, folder: str) -> None:
    with run_once(df.sparkSession):
        df.write.mode("append").option("compression", STEP_CODEC).parquet(folder)


def materialize(df: DataFrame) -> DataFrame:
    """`df` written below the checkpoint folder and read again, also after the loss of an executor.

    The files are columns, encoded and compressed: a checkpoint of rows takes several times
    their space, and its readers would load all columns where they need a few.
    """
    folder = _step_dir(df.sparkSession)
    _append(df, folder)
    return _step(df.sparkSession, df.schema, folder)


@contextmanager
def without_steps(spark: SparkSession) -> Iterator[list[str]]:
    """Steps that are stored inside are removed at the end; nothing may read them any more."""
    stored: list[str] = []
    token = _steps.set(stored)
    try:
        yield stored
    finally:
        _steps.reset(token)
        for folder in stored:
            remove(spark, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of `make`; the other steps that were stored on the way to it are removed."""
    outer = _steps.get()
    with without_steps(spark) as stored:
        made = make()
        own = step_of(made)
        if own in stored:
            stored.remove(own)
            if outer is not None:
                outer.append(own)
            return made
        token = _steps.set(outer)
        try:
            return materialize(made)
        finally:
            _steps.reset(token)


#: Rows that a slice of a step has at least, and the most slices: each reads the whole stored input.
SLICE_ROWS = 4_000_000
MOST_SLICES = 8


def slices_of(df: DataFrame) -> int:
    """How many slices a step over the stored `df` is worked off in."""
    return min(MOST_SLICES, max(1, df.count() // SLICE_ROWS))


def _in_slice(k: int, count: int, *keys: str) -> Column:
    if count == 1:
        return F.lit(True)
    # equal values may have other types in another table
    return F.pmod(F.xxhash64(*[F.col(x).cast("string") for x in keys]), F.lit(count)) == k


def in_slices(spark: SparkSession, count: int, make: Callable[[Callable[..., Column]], DataFrame]) -> DataFrame:
    """The stored rows of all slices, made one after the other, so that only one has its shuffles and steps on disk.

    `make` gets a condition by columns, which holds in one slice for each of their values and for equal
    values of any table in the same; it must treat what meets by them for itself.
    """
    folder = _step_dir(spark)
    for k in range(count):
        with without_steps(spark):
            made = make(partial(_in_slice, k, count))
            _append(made, folder)
    return _step(spark, made.schema, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder and what is in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Side of a join that may be sent to all executors, in bytes; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df` with a broadcast hint if its counted rows stay below `BROADCAST_BYTES`.

    `df` must be a stored table, as its rows are counted first. Beyond the bound
    the join is an ordinary shuffled one, which AQE splits at hot keys.
    """
    rows = df.count()
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder, visible to all executors."""
    return f"{ensure_checkpoints(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
