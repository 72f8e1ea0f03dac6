"""Assessment rules, their sequential form against a plain fold, and window statistics."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from fleetgrain.operators.metrics import merge_moments, window_statistics
from fleetgrain.operators.samples import accept_in_rounds, accept_sequentially, assess_sample


def judge(duration, distance, confidence, references):
    n = len(references)
    if distance / duration * 3.6 > 80:
        return False, 0.0, "speed_over_80", n
    if n < 5:
        return True, 0.5, None, n
    median = statistics.median(references)
    mad = statistics.median(abs(x - median) for x in references)
    off = abs(duration - median)
    outlier = off > max(5.0, median * 0.1) if mad == 0 else 0.6745 * off / mad > 3.5
    if outlier:
        return False, 0.0, "mad_outlier", n
    return True, 1.0 if confidence == "high" else 0.5, None, n


def test_outlier_and_flat_references(spark):
    rows = [
        (140.0, 500.0, "high", [58.0, 59.0, 60.0, 61.0, 62.0]),
        (65.0, 500.0, "high", [60.0] * 5),
        (67.0, 500.0, "high", [60.0] * 5),
        (10.0, 500.0, "high", []),
        (60.0, 500.0, "high", [60.0]),
    ]
    df = spark.createDataFrame(rows, "duration_seconds double, distance_m double, confidence string, references array<double>")
    got = [(r["accepted"], r["rejection_reason"], r["weight"]) for r in assess_sample(df).collect()]
    assert got == [
        (False, "mad_outlier", 0.0), (True, None, 1.0), (False, "mad_outlier", 0.0), (False, "speed_over_80", 0.0), (True, None, 0.5),
    ]


def test_sequential_acceptance_equals_plain_fold(spark):
    rng, rows, clock = random.Random(3), [], {"a": 0, "b": 0}
    for i in range(600):
        key = rng.choice("ab")
        clock[key] += rng.choice([20, 60, 200, 4000 if i % 60 == 0 else 90])
        duration = rng.choice([60.0, 61.0, 62.5, 70.0, 300.0, 58.25])
        rows.append((key, i, clock[key], duration, duration * rng.choice([5.0, 8.0, 30.0]), rng.choice(["high", "reduced"])))
    df = spark.createDataFrame(
        rows, "metric_key string, event_id int, s int, duration_seconds double, distance_m double, confidence string"
    ).withColumn("completed_at", F.timestamp_seconds("s"))
    got = {r["event_id"]: (r["accepted"], r["weight"], r["rejection_reason"], r["reference_count"]) for r in accept_sequentially(df).collect()}
    kept: dict[str, list] = {"a": [], "b": []}
    for key, i, at, duration, distance, confidence in sorted(rows, key=lambda r: (r[2], r[0], r[3])):
        kept[key] = [(t, d) for t, d in kept[key] if t > at - 3600]
        want = judge(duration, distance, confidence, [d for _, d in kept[key]])
        assert got[i] == want, (i, got[i], want)
        if want[0]:
            kept[key].append((at, duration))


def test_a_key_without_pause_is_folded_by_the_hour(spark):
    rng, rows, at = random.Random(4), [], 0
    for i in range(1500):
        at += rng.choice([40, 60, 90])
        duration = rng.choice([60.0, 61.0, 62.5, 70.0, 58.25]) + (200.0 if (at // 3600) % 5 == 3 else 0.0) + rng.random()
        rows.append((i + (1 << 60), "k", at, duration, duration * rng.choice([5.0, 8.0, 30.0]), rng.choice(["high", "reduced"]), None if i % 3 else "x"))
    df = spark.createDataFrame(
        rows, "event_id bigint, metric_key string, s int, duration_seconds double, distance_m double, confidence string, note string"
    ).withColumn("completed_at", F.timestamp_seconds("s"))
    judged, rounds = accept_in_rounds(df)
    got = {r["event_id"]: (r["accepted"], r["weight"], r["rejection_reason"], r["reference_count"], r["note"]) for r in judged.collect()}
    kept: list = []
    for event, _, at, duration, distance, confidence, note in rows:
        kept = [(t, d) for t, d in kept if t > at - 3600]
        want = judge(duration, distance, confidence, [d for _, d in kept])
        assert got[event] == (*want, note), (event, got[event], want)
        if want[0]:
            kept.append((at, duration))
    assert len(got) == len(rows) and 1 < rounds < rows[-1][2] // 3600


def test_hours_that_disturb_each_other_take_few_rounds(spark):
    rows, at = [], 0
    # the first hour holds one value; the others accept all three only if the hour before did
    for i in range(40 * 60):
        at += 60
        rows.append((i, "k", at, 60.0 + 20.0 * (i % 3) * (at > 3600), 500.0, "high"))
    df = spark.createDataFrame(
        rows, "event_id int, metric_key string, s int, duration_seconds double, distance_m double, confidence string"
    ).withColumn("completed_at", F.timestamp_seconds("s"))
    judged, rounds = accept_in_rounds(df)
    got = {r["event_id"]: (r["accepted"], r["reference_count"]) for r in judged.collect()}
    kept: list = []
    for event, _, at, duration, distance, confidence in rows:
        kept = [(t, d) for t, d in kept if t > at - 3600]
        want = judge(duration, distance, confidence, [d for _, d in kept])
        assert got[event] == (want[0], want[3]), (event, got[event], want)
        if want[0]:
            kept.append((at, duration))
    assert len(got) == len(rows) and rounds <= 9


def test_window_statistics_golden(spark):
    rows = [(100.0, True), (140.0, True), (900.0, False), (float("nan"), True)]
    df = spark.createDataFrame(rows, "duration_seconds double, accepted boolean").withColumn("weight", F.lit(1.0)).withColumn(
        "completed_at", F.lit("2026-08-28 10:00:00").cast("timestamp")).withColumn("k", F.lit(1))
    row = window_statistics(df, ["k"]).first()
    assert (row["sample_count_total"], row["sample_count_accepted"]) == (4, 2)
    assert (row["mean_seconds"], row["standard_deviation_seconds"], row["m2_seconds"], row["median_seconds"]) == (120.0, 20.0, 800.0, 120.0)


def test_moments_merge_golden(spark):
    parts = [(1, 2, 2.0, 110.0, 200.0, 100.0, 120.0), (1, 2, 2.0, 135.0, 50.0, 130.0, 140.0), (1, 0, 0.0, None, 0.0, None, None)]
    df = spark.createDataFrame(parts, "k int, count int, weight_sum double, mean double, m2 double, minimum double, maximum double")
    row = merge_moments(df, ["k"]).first()
    assert (row["mean"], round(row["m2"], 6), row["minimum"], row["maximum"]) == (122.5, 875.0, 100.0, 140.0)
