"""Streaming twins equal their batch operators, with rows out of order and state that ends."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fleetgrain.catalog.metrics import _dense
from fleetgrain.catalog.streams import crossed
from fleetgrain.catalog.views import Views
from fleetgrain.operators import crossings, positions, samples
from fleetgrain.operators.metrics import daily_metrics
from fleetgrain.session import shared_dir
from fleetgrain.sources.tables import read_current
from fleetgrain.streaming import jobs, state

FOLDER = "/root/testdata/sf0.001"


class Stream:
    """One query over files that are added slice by slice; a run takes what is there and stops."""

    def __init__(self, spark, schema, build):
        self.spark, self.schema, self.build = spark, schema, build
        self.folder, self.out, self.checkpoint = (shared_dir(spark, x) for x in ("in", "out", "ckpt"))

    def feed(self, rows):
        rows.select(*self.schema.names).coalesce(1).write.mode("append").parquet(self.folder)
        source = self.spark.readStream.schema(self.schema).parquet(self.folder)
        self.build(source).writeStream.format("parquet").option("path", self.out).option(
            "checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()

    def beat(self, column, at):
        """A row without key moves the watermark a day past `at`."""
        one = self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != column], (F.lit(at) + F.expr("INTERVAL 3 DAY")).alias(column))
        self.feed(one)

    def rows(self, columns):
        return sorted(map(repr, self.spark.read.parquet(self.out).select(*columns).collect()))

    def held(self, name, operator=0):
        """Rows of a state variable that are still kept."""
        flat = self.spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name)
        return flat.option("flattenCollectionTypes", True).load(self.checkpoint).count()


def late_slices(rows, order, parts=3, seed=1):
    """Consecutive slices; a third of each slice's rows comes one slice later, in any order."""
    line = sorted(rows.select("event_id", order).collect(), key=lambda r: r[1]) if "event_id" in rows.columns else None
    rng = random.Random(seed)
    share, slices = len(line) / parts, [[] for _ in range(parts)]
    for i, r in enumerate(line):
        k = min(parts - 1, int(i / share))
        slices[min(parts - 1, k + (rng.random() < 1 / 3))].append(r["event_id"])
    return [rows.where(F.col("event_id").isin(ids)) for ids in slices]


def test_position_windows(spark):
    rows = Views(spark, FOLDER).tracks.withColumn("arrival_no", F.col("event_id") + (F.col("k") % 10) * 30)
    columns = ["event_id", "window_reset", "position_sample_count", "low_speed_since", "latitude", "shape_id", "k"]
    batch = positions.low_speed_since(positions.position_window(positions.drop_out_of_order(rows, ["arrival_no", "event_id"])))
    stream = Stream(spark, rows.schema, lambda df: state.current_state_stream(df, "60 days"))
    low, high = rows.approxQuantile("arrival_no", [0.3, 0.7], 0.0)
    for part in (f"arrival_no <= {low}", f"arrival_no > {low} AND arrival_no <= {high}", f"arrival_no > {high}"):
        stream.feed(rows.where(part))
    assert stream.rows(columns) == sorted(map(repr, batch.select(*columns).collect()))
    assert stream.held("vehicle") > 0
    newest = rows.agg(F.max("source_timestamp")).first()[0]
    one = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "source_timestamp"], (F.lit(newest) + F.expr("INTERVAL 90 DAY")).alias("source_timestamp"))
    stream.feed(one)
    assert stream.held("vehicle") == 0


def test_late_assessments_equal_the_batch(spark):
    rows = _dense(Views(spark, FOLDER))
    columns = ["event_id", "accepted", "weight", "rejection_reason", "reference_count", "modified_z", "origin_stop_id"]
    batch = samples.accept_sequentially(rows)
    stream = Stream(spark, rows.schema, lambda df: state.assessment_stream(df, "2 days"))
    for part in late_slices(rows, "completed_at"):
        stream.feed(part)
    newest = rows.agg(F.max("completed_at")).first()[0]
    assert stream.held("waiting") > 0
    stream.beat("completed_at", newest)
    assert stream.rows(columns) == sorted(map(repr, batch.select(*columns).collect()))
    assert stream.held("waiting") == 0
    stream.beat("completed_at", newest.replace(year=newest.year + 1))
    assert stream.held("references") == 0


def _chain_rows(spark):
    rows = crossed(Views(spark, FOLDER)).withColumn("event_id", F.xxhash64("vehicle_prefix", "stop_sequence", "crossed_at"))
    rows = rows.where(F.pmod(F.xxhash64("vehicle_prefix"), F.lit(6)) == 0)
    return rows.withColumn("route_id", F.lit("R1")).withColumn("direction_id", F.col("session_id").cast("int") % 2).persist()


def _expected(rows):
    done = crossings.completed_segments(rows)
    return done, samples.accept_sequentially(samples.metric_identities(done))


CHAINED = ["metric_key", "vehicle_prefix", "completed_at", "accepted", "weight", "rejection_reason", "reference_count", "route_id"]


def test_chain_from_crossings_to_samples(spark):
    rows = _chain_rows(spark)
    done, assessed = _expected(rows)
    newest = rows.agg(F.max("crossed_at")).first()[0]
    single = Stream(spark, rows.schema, lambda df: state.crossing_stream(df, "2 days"))
    chain = Stream(spark, rows.schema, lambda df: state.travel_time_stream(df, "2 days"))
    for part in late_slices(rows, "crossed_at"):
        single.feed(part)
        chain.feed(part)
    for stream in (single, chain):
        stream.beat("crossed_at", newest)
    columns = ["vehicle_prefix", "origin_stop_sequence", "destination_stop_sequence", "duration_seconds", "distance_m", "confidence"]
    assert single.rows(columns) == sorted(map(repr, done.select(*columns).collect()))
    assert chain.rows(CHAINED) == sorted(map(repr, assessed.select(*CHAINED).collect()))
    assert {r.operatorId for r in spark.read.format("state-metadata").load(chain.checkpoint).collect()} == {0, 1}


def test_chain_starts_from_a_batch(spark):
    rows = _chain_rows(spark)
    _, assessed = _expected(rows)
    newest = rows.agg(F.max("crossed_at")).first()[0]
    cut = rows.selectExpr("percentile_approx(unix_micros(crossed_at), 0.5) AS p").first()["p"]
    before, after = rows.where(F.unix_micros("crossed_at") <= cut), rows.where(F.unix_micros("crossed_at") > cut)
    first = _expected(before)[1].persist()
    stream = Stream(spark, rows.schema, lambda df: state.travel_time_stream(df, "2 days", state.open_boundaries(before), state.open_references(first)))
    stream.feed(after)
    stream.beat("crossed_at", newest)
    both = sorted([*map(repr, first.select(*CHAINED).collect()), *stream.rows(CHAINED)])
    assert both == sorted(map(repr, assessed.select(*CHAINED).collect()))


def test_windows_of_a_failed_batch_are_recovered(spark):
    rows = Views(spark, FOLDER).assessed
    newest = rows.agg(F.max("completed_at")).first()[0]
    recent = rows.withColumn("completed_at", F.lit(newest) - F.expr("make_dt_interval(0, 0, 0, event_id % 3500)"))
    root = shared_dir(spark, "metrics")
    each = jobs.materialize_windows(spark, root)
    each(recent.where("event_id % 2 = 0 AND event_id < 400"), 0)
    # the next batch stored its rows and failed
    lost = recent.where("event_id % 2 = 1 OR event_id >= 400")
    lost.withColumn("day", F.to_date("completed_at")).withColumn("batch", F.lit(1)).write.mode("append").partitionBy("day", "batch").parquet(f"{root}/observations")
    late = str(newest)
    want = daily_metrics(recent)
    keys = ["metric_key", "service_date", "slot_index"]
    known = read_current(spark, f"{root}/daily").select(*keys)
    missing = want.join(known, keys, "left_anti").count()
    assert missing > 0 and jobs.recover_windows(spark, root, late) == missing and jobs.recover_windows(spark, root, late) == 0
    columns = [*keys, "sample_count_total", "mean_seconds", "median_seconds"]
    show = lambda df: sorted(map(repr, df.join(known, keys, "left_anti").select(*columns).collect()))
    assert show(read_current(spark, f"{root}/daily")) == show(want)
