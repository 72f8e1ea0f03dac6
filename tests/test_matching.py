"""Three-sample matching, monotone placement and line geometry on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetgrain.functions.geo import line_slice, split_line
from fleetgrain.operators.matching import match_three_samples, monotone_path

CANDIDATE = (
    "struct<segment_sequence:int,progress_m:double,shape_position:double,distance_to_shape_m:double,"
    "bearing_degrees:double,projected_latitude:double,projected_longitude:double>"
)
SAMPLES = f"samples array<struct<order:int,sample_timestamp:timestamp,latitude:double,longitude:double,candidates:array<{CANDIDATE}>>>"


def candidate(progress, distance=5.0, bearing=90.0, segment=1):
    return (segment, float(progress), progress / 1000.0, float(distance), float(bearing), 0.0, 0.0)


def window(spark, candidates, gap=10, step=0.0002):
    rows = [
        (i, f"2026-08-28 13:00:{i * gap:02d}" if gap < 20 else f"2026-08-28 13:{i * gap // 60:02d}:{i * gap % 60:02d}", 0.0, i * step, c)
        for i, c in enumerate(candidates)
    ]
    raw = spark.createDataFrame([(rows,)], SAMPLES.replace("sample_timestamp:timestamp", "sample_timestamp:string"))
    typed = F.transform(
        "samples",
        lambda s: F.struct(
            s["order"].alias("order"), s["sample_timestamp"].cast("timestamp").alias("sample_timestamp"),
            s["latitude"].alias("latitude"), s["longitude"].alias("longitude"), s["candidates"].alias("candidates"),
        ),
    )
    return match_three_samples(raw.withColumn("samples", typed)).first()


def test_consistent_progress_resolves(spark):
    row = window(spark, [[candidate(100)], [candidate(110)], [candidate(120)]])
    assert row["match_status"] == "resolved"
    assert [s["progress_m"] for s in row["path"]] == [100.0, 110.0, 120.0]


@pytest.mark.parametrize(
    ("candidates", "gap", "step", "status"),
    [
        ([[candidate(100)], [candidate(110)], []], 10, 0.0002, "fallback_required"),
        ([[candidate(100)], [candidate(110)]], 10, 0.0002, "collecting"),
        ([[candidate(100)], [candidate(110)], [candidate(120)]], 10, 0.00001, "collecting"),
        ([[candidate(100)], [candidate(110)], [candidate(120)]], 400, 0.0002, "collecting"),
        ([[candidate(100)], [candidate(110)], [candidate(120, bearing=270)]], 10, 0.0002, "ambiguous"),
        ([[candidate(100)], [candidate(110)], [candidate(120), candidate(900)]], 10, 0.0002, "ambiguous"),
        ([[candidate(500)], [candidate(300)], [candidate(120)]], 10, 0.0002, "ambiguous"),
    ],
)
def test_other_states(spark, candidates, gap, step, status):
    assert window(spark, candidates, gap, step)["match_status"] == status


STOP = "array<array<struct<progress_m:double,segment_sequence:int,shape_position:double,distance_to_shape_m:double>>>"


def path(spark, windows):
    rows = [[(float(p), i, p / 1000.0, float(d)) for i, (p, d) in enumerate(w)] for w in windows]
    df = spark.createDataFrame([(rows,)], f"windows {STOP}")
    found = df.select(monotone_path(F.col("windows")).alias("p")).first()["p"]
    return None if found is None else [c["progress_m"] for c in found]


def test_loop_keeps_order(spark):
    assert path(spark, [[(0, 1), (800, 1)], [(100, 10), (900, 1)], [(200, 1)]]) == [0.0, 100.0, 200.0]


def test_no_monotone_choice(spark):
    assert path(spark, [[(500, 1)], [(100, 1)]]) is None
    assert path(spark, [[(500, 1)], []]) is None


def test_line_is_cut_by_fractions(spark):
    line = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)],)], "points array<struct<lon:double,lat:double>>")
    row = line.select(
        line_slice(F.col("points"), F.lit(0.75), F.lit(0.25)).alias("cut"), split_line(F.col("points"), F.lit(0.25)).alias("s")
    ).first()
    assert [tuple(p) for p in row["cut"]] == [(0.5, 0.0), (1.0, 0.0), (1.5, 0.0)]
    assert [tuple(p) for p in row["s"]["completed"]] == [(0.0, 0.0), (0.5, 0.0)]
    assert [tuple(p) for p in row["s"]["remaining"]] == [(0.5, 0.0), (1.0, 0.0), (2.0, 0.0)]
