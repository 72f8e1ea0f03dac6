"""Cases that the registered queries' tables do not hold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetgrain.functions.text import canonical_text
from fleetgrain.operators.decisions import recent_decisions
from fleetgrain.operators.fleet import natural_key, sort_fleet
from fleetgrain.plans.jobs import _content_of
from fleetgrain.sources.tables import overwrite_upsert, read_current
from fleetgrain.streaming import jobs


def test_natural_order_of_long_numbers(spark):
    names = ["V10", "v9", "V1234567890123", "V9234567890123", "V234567890123", "V007", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in sort_fleet(df, "name").collect()][:6] == ["V007", "v9", "V10", "V234567890123", "V1234567890123", "V9234567890123"]
    assert [r.name for r in sort_fleet(df, "name", "desc").collect()][:2] == ["V9234567890123", "V1234567890123"]
    keys = {r.k for r in df.where("name <> ''").select(natural_key(F.col("name")).alias("k")).collect()}
    assert len(keys) == 6


def test_canonical_text_beyond_latin(spark):
    pairs = {"Stra\u00dfe": "strasse", "\ufb01n": "fin", "\u039f\u0394\u039f\u03a3": "\u03bf\u03b4\u03bf\u03c3", "e\u0301te": "ete", " S\u00e3o  Jos\u00e9": "sao jose", "\u0419": "\u0438", None: ""}
    df = spark.createDataFrame([(k,) for k in pairs], "s string")
    assert {r.s: r.c for r in df.select("s", canonical_text(F.col("s")).alias("c")).collect()} == pairs


def test_recent_decisions_are_not_cut(spark):
    at = dt.datetime(2025, 3, 9)
    df = spark.range(600).select(F.concat(F.lit("G"), "id").alias("execution_key"), F.lit(at).alias("updated_at"))
    assert recent_decisions(df, "2025-03-09 12:00:00").count() == 600
    assert recent_decisions(df, "2025-03-09 12:00:00", 7).count() == 7


def test_an_equal_guard_replaces_when_ties_are_asked_for(spark, tmp_path):
    path, schema = str(tmp_path / "live"), "k string, w int, n int"
    for n in (1, 2):
        overwrite_upsert(spark, path, spark.createDataFrame([("a", 5, n)], schema), ["k"], F.col("w"), ties=True)
    overwrite_upsert(spark, path, spark.createDataFrame([("a", 4, 9)], schema), ["k"], F.col("w"), ties=True)
    assert [tuple(r) for r in read_current(spark, path).collect()] == [("a", 5, 2)]


def test_windows_follow_later_batches(spark, tmp_path):
    each = jobs.materialize_windows(spark, str(tmp_path / "m"))
    schema = "metric_key string, completed_at timestamp, duration_seconds double, weight double, accepted boolean"
    row = lambda s, d: ("k", dt.datetime(2025, 3, 9, 8, 1, s), d, 1.0, True)
    each(spark.createDataFrame([row(1, 100.0)], schema), 0)
    each(spark.createDataFrame([row(9, 200.0)], schema), 1)
    for name in ("live", "daily"):
        got = read_current(spark, f"{tmp_path}/m/{name}").collect()
        assert [(r.sample_count_total, r.mean_seconds) for r in got] == [(2, 150.0)]


def test_correlation_keeps_rows_without_a_time_and_calls_the_sink_once(spark, tmp_path):
    schema = "vehicle_prefix string, received_at timestamp, current_line string, current_direction string, current_planned_time string"
    rows = [("A", dt.datetime(2025, 3, 9, 12), "1", "0", "08:00"), ("B", dt.datetime(2025, 3, 10, 12), "1", "0", "08:00"), ("C", None, "1", "0", "08:00")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    active = spark.createDataFrame([("F", "t1", "r", "s", "1", "0", "08:00", 28800)], "feed_id string, trip_id string, route_id string, shape_id string, line string, direction string, planned_time string, start_seconds int")
    calls = []
    query = jobs.correlate_stream(
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda day: active,
        lambda df, batch: calls.append((batch, {r.vehicle_prefix: r.correlation_reason for r in df.collect()})), str(tmp_path / "ck"), available_now=True)
    query.awaitTermination()
    assert [c[0] for c in calls] == [0] and set(calls[0][1]) == {"A", "B", "C"}
    assert calls[0][1]["C"] == "no_exact_match"


def test_content_of_a_folder(spark, tmp_path):
    def made(name, stops):
        folder = tmp_path / name
        (folder / "stops.txt").mkdir(parents=True)
        (folder / "trips.txt").write_text("trip_id\nt1\n")
        for k, part in enumerate(stops):
            (folder / "stops.txt" / f"part-{k}.csv").write_text(part)
        return _content_of(spark, str(folder)).first()["content"]

    assert made("a", ["x\n", "y\n"]) == made("b", ["y\n", "x\n"])
    assert made("c", ["x\n", "z\n"]) != made("d", ["x\n", "y\n"])
