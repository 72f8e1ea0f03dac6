"""Updates that rewrite only the buckets of their keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetgrain.sources import merge

SCHEMA = "k long, j string, at int, x int"


def content(spark, path):
    return sorted(map(tuple, merge.read_merged(spark, path).collect()), key=str)


def test_updates_equal_a_plain_fold_and_touch_few_buckets(spark, tmp_path):
    path, rng, want = str(tmp_path / "t"), random.Random(4), {}
    for size in (400, 3, 60, 1):
        rows = [(rng.choice([None, *range(300)]), rng.choice(["a", None]), rng.randint(0, 9), rng.randint(0, 10**6)) for _ in range(size)]
        # one update for each key, as the order of equal ones is not defined
        rows = list({r[:2]: r for r in rows}.values())
        done = merge.merge_into(spark, path, spark.createDataFrame(rows, SCHEMA), ["k", "j"], F.col("at"), buckets=32)
        for r in rows:
            if r[:2] not in want or want[r[:2]][2] < r[2]:
                want[r[:2]] = r
        assert content(spark, path) == sorted(want.values(), key=str)
        assert 0 < len(done) <= min(size, 32)
    # a narrower type of a key finds the same bucket
    merge.merge_into(spark, path, spark.createDataFrame([(7, "a", 99, 1)], "k int, j string, at int, x int"), ["k", "j"], F.col("at"))
    want[7, "a"] = (7, "a", 99, 1)
    assert content(spark, path) == sorted(want.values(), key=str)
    assert merge.merge_into(spark, path, spark.createDataFrame([], SCHEMA), ["k", "j"]) == []
    assert merge.remove_old(spark, path, 1 << 62) > 0 and content(spark, path) == sorted(want.values(), key=str)
    files = list((tmp_path / "t" / merge.DATA).rglob("part-*.parquet"))
    assert len(files) <= 32


def test_failures_and_conflicts_leave_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first, second = (spark.createDataFrame([(1, "a", k, k)], SCHEMA) for k in (1, 2))
    assert merge.read_merged(spark, path) is None
    merge.merge_into(spark, path, first, ["k", "j"])
    publish, other = merge._create, merge._current(spark, path)[1]
    with monkeypatch.context() as patch:
        patch.setattr(merge, "_create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            merge.merge_into(spark, path, second, ["k", "j"])
    assert content(spark, path) == [(1, "a", 1, 1)]

    def late(session, name, version):
        publish(session, name, other)
        return publish(session, name, version)

    with monkeypatch.context() as patch:
        patch.setattr(merge, "_create", late)
        with pytest.raises(merge.Conflict):
            merge.merge_into(spark, path, second, ["k", "j"])
    (tmp_path / "t" / merge.VERSIONS / f"{2:012d}").write_text('{"torn')
    assert content(spark, path) == [(1, "a", 1, 1)]
    merge.merge_into(spark, path, second, ["k", "j"])
    assert content(spark, path) == [(1, "a", 2, 2)]
    with pytest.raises(ValueError, match="keys"):
        merge.merge_into(spark, path, second, ["k"])
