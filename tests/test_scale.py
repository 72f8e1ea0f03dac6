"""Steps that large tables need: rows dealt once, stored as columns, no exploded side sent whole."""

from __future__ import annotations

import math
import re
import time
import uuid
from datetime import date
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fleetgrain import session
from fleetgrain.catalog import jobs as fixtures
from fleetgrain.catalog import streams, views
from fleetgrain.functions.text import normalize_line
from fleetgrain.operators import estimates, metrics, samples, shapes, timetable
from fleetgrain.plans import jobs
from fleetgrain.session import materialize
from fleetgrain.sources.loads import publish, read_published
from fleetgrain.streaming import state


def exchanges(df) -> int:
    """Shuffles of the plan, one that is read twice counted once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(bool(re.search(r"\bExchange (hash|range)partitioning", line)) for line in plan.splitlines() if "ReusedExchange" not in line)


def traversals(spark):
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-24 12:00:00").cast("timestamp")) + F.col("id") * 977_000_000)
    return spark.range(600).select(
        F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("origin_stop_id"), F.concat(F.lit("P"), (F.col("id") % 3).cast("string")).alias("destination_stop_id"),
        F.concat(F.lit("R"), (F.col("id") % 2).cast("string")).alias("route_id"), (F.col("id") % 2).cast("int").alias("direction_id"), at.alias("completed_at"),
        (60.0 + F.col("id") % 50).alias("duration_seconds"), (F.col("id") % 10 > 0).alias("accepted"), F.lit(1.0).alias("weight"))


def test_steps_are_stored_as_columns(spark):
    stored = materialize(spark.range(10).selectExpr("id", "CAST(NULL AS STRING) AS s"))
    assert all(name.endswith(".parquet") for name in stored.inputFiles()) and stored.inputFiles()
    assert stored.count() == 10


def test_metrics_of_dealt_rows_need_one_shuffle(spark):
    seen = samples.metric_identities(traversals(spark).repartition("origin_stop_id", "destination_stop_id"))
    profile = metrics.rolling_profile(metrics.daily_metrics(seen, samples.KEYED), date(2024, 1, 31), samples.KEYED)
    live = metrics.live_metrics(seen, samples.KEYED)
    assert exchanges(profile) == 1 and exchanges(live) == 1
    plain = samples.metric_identities(traversals(spark))
    for dealt, other in ((profile, metrics.rolling_profile(metrics.daily_metrics(plain), date(2024, 1, 31))), (live, metrics.live_metrics(plain))):
        columns = sorted(dealt.columns)
        assert columns == sorted(other.columns)
        order = ["metric_key", *[c for c in ("day_type", "slot_index") if c in columns]]
        rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(dealt.dtypes)]
        assert dealt.select(rounded).orderBy(order).collect() == other.select(rounded).orderBy(order).collect()


def test_planned_means_shuffle_the_runs_once(spark):
    stop_times = spark.range(120).select(
        F.lit("F").alias("feed_id"), F.floor(F.col("id") / 6).alias("trip_id"), (F.col("id") % 6).cast("int").alias("stop_sequence"),
        F.concat(F.lit("S"), (F.col("id") % 5).cast("string")).alias("stop_id"), (F.col("id") % 6 * 120 + 3600).cast("int").alias("arrival_seconds"),
        (F.col("id") % 6 * 120 + 3615).cast("int").alias("departure_seconds"))
    trips = spark.range(20).select(
        F.lit("F").alias("feed_id"), F.col("id").alias("trip_id"), F.lit("R").alias("route_id"), (F.col("id") % 2).cast("int").alias("direction_id"), F.lit("W").alias("service_id"))
    days = [F.lit(True).alias(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")]
    services = spark.range(1).select(F.lit("F").alias("feed_id"), F.lit("W").alias("service_id"), *days, F.lit("2024-01-01").cast("date").alias("start_date"), F.lit("2024-01-31").cast("date").alias("end_date"))
    none = spark.createDataFrame([], "feed_id string, service_id string, service_date date, exception_type int")
    asked = materialize(timetable.adjacent_stop_pairs(stop_times).join(trips, timetable.TRIP).select(*timetable.PAIR, "route_id", "direction_id").distinct())
    means = timetable.planned_slot_means(timetable.planned_traversals(asked, stop_times, trips, services, none, ["2024-01-03", "2024-01-04"]), asked)
    # stops by trip, runs by pair
    assert exchanges(means) == 2
    totals = {r["scope"]: r["n"] for r in means.groupBy("scope").agg(F.sum("trip_count").alias("n")).collect()}
    assert totals == {"physical": 200, "service": 200}


def test_points_meet_shapes_without_an_exploded_side(spark):
    points = spark.range(2000).select(
        F.lit("F").alias("feed_id"), F.concat(F.lit("H"), (F.col("id") % 20).cast("string")).alias("shape_id"), F.floor(F.col("id") / 20).cast("int").alias("sequence"),
        (-15.8 + 0.0006 * F.floor(F.col("id") / 20)).alias("latitude"), (-47.9 + 0.0004 * (F.floor(F.col("id") / 20) % 7)).alias("longitude"))
    pings = spark.range(400).select(
        "id", F.lit("F").alias("feed_id"), F.concat(F.lit("H"), (F.col("id") % 22).cast("string")).alias("shape_id"),
        (-15.81 + 0.0002 * F.col("id")).alias("latitude"), F.when(F.col("id") % 40 > 0, -47.9 + 0.0001 * (F.col("id") % 60)).alias("longitude"))
    segments = materialize(shapes.shape_segments(points))
    near = shapes.nearby_segments(pings, segments, ["id"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    # every segment of the shape, in plain code
    by_shape: dict = {}
    for s in segments.collect():
        by_shape.setdefault(s["shape_id"], []).append(s)

    def planar(p, s):
        dx, dy = s["end_lon"] - s["start_lon"], s["end_lat"] - s["start_lat"]
        t = max(0.0, min(1.0, ((p["longitude"] - s["start_lon"]) * dx + (p["latitude"] - s["start_lat"]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(s["start_lon"] + t * dx - p["longitude"], s["start_lat"] + t * dy - p["latitude"])

    whole = [p for p in pings.collect() if p["longitude"] is not None and p["shape_id"] in by_shape]
    want = {p["id"]: min(planar(p, s) for s in by_shape[p["shape_id"]]) for p in whole}
    got = {r["id"]: r["nearest"]["planar_distance"] for r in shapes.nearest_segment(pings, segments, ["id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert max(want.values()) > shapes.BOX_DEGREES
    rows = near.collect()
    assert {r["id"] for r in rows} == set(range(400))
    union = {(r["id"], r["candidate"]["segment_sequence"]) for r in shapes.candidate_union(pings, segments, ["id"]).collect()}
    assert {(r["id"], r["candidate"]["segment_sequence"]) for r in rows if r["candidate"] is not None} <= union
    assert {i for i, _ in union} == want.keys()


def test_stored_segments_are_packed_in_one_shuffle(spark):
    points = spark.range(600).select(
        F.lit("F").alias("feed_id"), F.concat(F.lit("H"), (F.col("id") % 3).cast("string")).alias("shape_id"), F.floor(F.col("id") / 3).cast("int").alias("sequence"),
        (-15.8 + 0.0006 * F.floor(F.col("id") / 3)).alias("latitude"), (-47.9 + 0.0004 * (F.floor(F.col("id") / 3) % 7)).alias("longitude"))
    segments = materialize(shapes.shape_segments(points))
    packed = shapes.packed_shapes(segments)
    assert exchanges(packed) == 1
    got = {r["shape_id"]: r["runs"] for r in packed.collect()}
    for shape, rows in {s: [r for r in segments.collect() if r["shape_id"] == s] for s in got}.items():
        assert sorted(r["segment_sequence"] for r in rows) == [s["segment_sequence"] for run in got[shape] for s in run["segments"]]
        for run in got[shape]:
            assert 0 < len(run["segments"]) <= shapes.CHUNK
            assert run["west"] == min(min(s["start_lon"], s["end_lon"]) for s in run["segments"])
            assert run["north"] == max(max(s["start_lat"], s["end_lat"]) for s in run["segments"])
    assert got.keys() == {"H0", "H1", "H2"}


def test_replayed_rows_are_dealt_by_hour_once(spark):
    at = F.timestamp_seconds(1704340800 + F.col("id") * 40)
    pings = spark.range(400).select(
        F.concat(F.lit("V"), (F.col("id") % 3).cast("string")).alias("vehicle_prefix"), F.col("id").cast("int").alias("pos"), at.alias("received_at"), at.alias("source_timestamp"),
        F.lit(-15.8).alias("latitude"), F.lit(-47.9).alias("longitude"), (F.col("id") % 4).cast("double").alias("speed_kmh"),
        F.lit("7").alias("current_line"), F.lit("0").alias("current_direction"), F.lit("10:30").alias("current_planned_time"))
    active = spark.sql("SELECT 'F' AS feed_id, 1L AS trip_id, 'R' AS route_id, 'H' AS shape_id, '0' AS direction, '10:30:00' AS planned_time").withColumn("line", normalize_line(F.lit("7")))
    windows = jobs.correlated_windows(pings, active)
    # by hour for the windows, low speed and sessions: three rows of their own made it 16
    assert exchanges(windows) <= 8
    rows = windows.orderBy("event_at").collect()
    assert len(rows) == 400 and {r["trip_id"] for r in rows} == {1} and "_chunk" not in windows.columns
    # 120 s between the pings of a vehicle: one run each, low where the speed is below 1
    assert {r["session_id"] for r in rows} == {1} and sum(r["low_speed_since"] is not None for r in rows) == 100


def test_files_of_a_replay_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    view = SimpleNamespace(spark=spark)
    stream = streams.replay(view, spark.range(2000), files=2)
    out = streams.drain(view, stream.select("id", F.col("_metadata.file_path").alias("file")))
    per_file = [r["count"] for r in out.groupBy("file").count().collect()]
    assert sum(per_file) == 2000 and out.select("id").distinct().count() == 2000
    assert len(per_file) == 20 and max(per_file) <= 110


def test_points_of_lines_are_not_shuffled_by_trip(spark):
    named = {"feed_id": F.lit("F"), "shape_id": F.lit("H")}
    trips = spark.range(3).select(F.col("id").alias("trip_id"), F.lit("R").alias("route_id"), F.lit(0).alias("direction_id"), *[v.alias(k) for k, v in named.items()])
    feeds = spark.sql("SELECT 'F' AS feed_id, TIMESTAMP '2024-01-01 00:00:00' AS retrieved_at")
    routes = spark.sql("SELECT 'F' AS feed_id, 'R' AS route_id, 'r' AS short_name")
    points = spark.range(4).select(F.col("id").cast("int").alias("sequence"), F.col("id").cast("double").alias("latitude"), F.col("id").cast("double").alias("longitude"), *[v.alias(k) for k, v in named.items()])
    stops = spark.sql("SELECT 'F' AS feed_id, 'S' AS stop_id, 'Stop' AS name, 0D AS latitude, 0D AS longitude")
    stop_times = spark.range(2).select(
        F.lit("F").alias("feed_id"), F.col("id").alias("trip_id"), F.lit(1).alias("stop_sequence"), F.lit("S").alias("stop_id"), F.lit(0.0).alias("shape_progress_m"),
        F.lit(1).alias("arrival_seconds"), F.lit(2).alias("departure_seconds"), F.lit("valid").alias("quality"))
    found = timetable.trip_geometry(trips, routes, feeds, shapes.assemble_lines(points), stop_times, stops)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "points" not in next(line for line in plan.splitlines() if "max_by" in line)
    rows = {r["trip_id"]: r for r in found.collect()}
    assert {k: len(r["points"]) for k, r in rows.items()} == {0: 4, 1: 4, 2: 4}
    assert rows[2]["stops"] is None and len(rows[0]["stops"]) == 1


def test_views_shuffle_only_columns_that_their_rows_show(spark, tmp_path):
    # two of each pair of lines differ only in price and date, which no row of the views shows
    lines = spark.range(400).select(
        F.floor(F.col("id") / 8).alias("l_orderkey"), (F.col("id") % 5).alias("l_partkey"), (F.col("id") % 2).alias("l_suppkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
        (F.col("id") * 37 % 101).cast("double").alias("l_extendedprice"), F.timestamp_seconds(F.col("id") * 7919 % 1009).alias("l_shipdate"))
    lines.unionByName(lines.withColumn("l_extendedprice", -F.col("l_extendedprice"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    v = views.Views(spark, str(tmp_path))
    for name in ("stop_times", "shape_points"):
        present = {t: v.table(t) for t in ("lineitem", "orders") if t in views.VIEWS[name]}
        whole = v.sql(views._fill(views.VIEWS[name], views._SPARK), **present)
        short = getattr(v, name)
        assert sorted(map(str, short.collect())) == sorted(map(str, whole.collect()))
        assert "l_extendedprice" not in short._jdf.queryExecution().executedPlan().toString()


def test_live_metrics_that_are_too_old_are_not_built(spark):
    seen = samples.metric_identities(traversals(spark))
    at = "2024-01-31 06:00:00"
    usable = "window_end >= TIMESTAMP '2024-01-31 05:00:00'"
    young, every = metrics.live_metrics(seen, samples.KEYED, at), materialize(metrics.live_metrics(seen, samples.KEYED))
    order = ["metric_key"]
    expected = every.where(usable).orderBy(*order).collect()
    assert 0 < len(expected) < every.count()
    assert young.orderBy(*order).select(*every.columns).collect() == expected


def test_estimates_ask_profiles_for_their_slots_only(spark):
    asked = estimates.in_fallback_slots(spark, "2024-01-31 12:00:00")
    slots = spark.range(288).select(F.col("id").cast("int").alias("slot_index"), F.explode(F.array(*[F.lit(d) for d in ("weekday", "saturday", "sunday")])).alias("day_type"))
    assert [(r["day_type"], r["slot_index"]) for r in slots.where(asked).orderBy("slot_index").collect()] == [("weekday", k) for k in range(102, 115)]
    # near midnight a Friday's estimate falls back to Saturday's first slots too
    late = slots.where(estimates.in_fallback_slots(spark, "2024-02-03 02:50:00")).groupBy("day_type").count().collect()
    assert {r["day_type"]: r["count"] for r in late} == {"weekday": 8, "saturday": 5}
    # the test reaches the rows below the aggregate
    profile = metrics.rolling_profile(metrics.daily_metrics(samples.metric_identities(traversals(spark)), samples.KEYED), date(2024, 1, 31), samples.KEYED)
    plan = profile.where(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("102") > plan.rindex("Aggregate")


def test_stored_catalog_holds_keys_in_runs(spark):
    rows = spark.range(3000).select(F.sha2((F.col("id") * 7 % 50).cast("string"), 256).alias("metric_key"), F.col("id").alias("value_seconds")).repartition(3)
    stored = estimates.stored_catalog(rows)
    assert stored.count() == 3000
    for name in stored.inputFiles():
        keys = [r["metric_key"] for r in spark.read.parquet(name).collect()]
        assert keys == sorted(keys)


def test_shuffled_partitions_stay_small_enough_to_sort(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def stored_steps(spark, monkeypatch, tmp_path) -> Path:
    """From now on steps go to a folder of this test."""
    monkeypatch.setattr(session, "ensure_checkpoints", lambda _: str(tmp_path))
    return tmp_path


def test_a_write_leaves_no_shuffle_files(spark, monkeypatch, tmp_path):
    root = stored_steps(spark, monkeypatch, tmp_path)
    files = lambda: set(Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*"))
    before = files()
    stored = materialize(spark.range(20_000).repartition(5, "id"))
    deadline = time.time() + 20
    while (left := files() - before) and time.time() < deadline:
        time.sleep(0.2)
    assert not left
    # a frame that its user runs again keeps its own
    frame = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(frame.collect()) == sorted(frame.collect()) and files() - before
    assert stored.count() == 20_000 and len(list(root.glob("step-*"))) == 1


def test_steps_on_the_way_are_removed(spark, monkeypatch, tmp_path):
    root = stored_steps(spark, monkeypatch, tmp_path)
    kept = lambda: len(list(root.glob("step-*")))
    inner = lambda: session.settled(spark, lambda: materialize(spark.range(10)).selectExpr("id * 2 AS id"))
    outer = session.settled(spark, lambda: inner().selectExpr("id + 1 AS id"))
    assert kept() == 1 and outer.agg(F.sum("id")).first()[0] == 100
    # a result that is a step already is not written again
    assert session.settled(spark, lambda: materialize(outer)).count() == 10 and kept() == 2
    with pytest.raises(ZeroDivisionError):
        session.settled(spark, lambda: materialize(spark.range(1)) and 1 / 0)
    assert kept() == 2


def test_the_replay_in_slices_gives_the_same_rows(spark, monkeypatch, tmp_path):
    source = "/root/testdata/sf0.001"
    view = views.Views(spark, source)

    def replayed() -> tuple[dict, int]:
        monkeypatch.setattr(session, "ensure_checkpoints", lambda _: str(tmp_path / uuid.uuid4().hex))
        made = []
        monkeypatch.setattr(session, "_append", lambda df, folder, put=append: made.append(folder) or put(df, folder))
        tables = jobs.project_timetable(fixtures.walked_tables(view))
        active = materialize(timetable.active_trips(view.trips, view.routes, view.services, view.exceptions, fixtures.SERVICE_DAY))
        out = jobs.travel_time_replay(fixtures.walking_pings(view, active), tables, active)
        names = {"states": ["previous_state_1", "previous_state_2"], "completed": [], "observations": [], "daily": []}
        return {n: sorted(map(str, out[n].drop(*drop).collect())) for n, drop in names.items()}, len(made)

    append = session._append
    whole, few = replayed()
    monkeypatch.setattr(session, "SLICE_ROWS", 200)
    sliced, many = replayed()
    assert many >= few + 4 * (session.MOST_SLICES - 1) and whole["states"] and whole["daily"]
    assert whole == sliced


def test_a_payload_names_no_fields(spark):
    rows = spark.sql(
        "SELECT id, 'k' AS key, CASE WHEN id > 0 THEN concat('\\\"', id, ',') END AS a_rather_long_name, TIMESTAMP '2024-01-31 10:00:00.123456' + make_interval(0, 0, 0, 0, 0, 0, id) AS seen_at,"
        " named_struct('at', TIMESTAMP '1969-12-31 23:59:59.999999', 'n', id) AS nested, 1.1D / 3 AS share FROM range(3)")
    sent = rows.select("id", state._payload(rows, ["id", "key"]))
    assert not any("name" in r["payload"] or "2024" in r["payload"] for r in sent.collect())
    back = state._restored(sent, rows, ["id", "key"], ["id"])
    assert back.dtypes == rows.drop("key").dtypes and back.orderBy("id").collect() == rows.drop("key").orderBy("id").collect()


def test_a_replayed_stream_leaves_its_files_only(spark, monkeypatch, tmp_path):
    root = stored_steps(spark, monkeypatch, tmp_path)
    monkeypatch.setattr(streams, "shared_dir", session.shared_dir)
    files = lambda: set(Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data"))
    before = files()
    view = SimpleNamespace(spark=spark)
    out = streams.drain(view, streams.replay(view, spark.range(5000), files=2).dropDuplicates(["id"]))
    deadline = time.time() + 20
    while (left := files() - before) and time.time() < deadline:
        time.sleep(0.2)
    assert not left and not list(root.glob("step-*"))
    assert out.count() == 5000


def test_a_spent_step_is_removed_once_it_is_published(spark, monkeypatch, tmp_path):
    root = stored_steps(spark, monkeypatch, tmp_path)
    rows = spark.range(5).selectExpr("'F' AS feed_id", "id")
    step, target = materialize(rows.where("id > 1")), str(tmp_path / "core")
    assert list(publish({"a": rows, "b": step}, target, "first", spent=True).items()) == [("a", 5), ("b", 3)]
    assert not list(root.glob("step-*")) and read_published(spark, target, "b").count() == 3
    publish({"b": materialize(rows)}, target, "second")
    assert len(list(root.glob("step-*"))) == 1


def test_a_load_leaves_its_tables_only(spark, monkeypatch, tmp_path):
    root = stored_steps(spark, monkeypatch, tmp_path)
    monkeypatch.setattr(fixtures, "shared_dir", session.shared_dir)
    view = views.Views(spark, "/root/testdata/sf0.001")
    folder, target = fixtures._folder(view), str(tmp_path / "core")
    none = spark.createDataFrame([], "content_hash string")
    counts = jobs.timetable_job(spark, folder, "F1", target, none, "2024-01-04 00:00:00")
    assert not list(root.glob("step-*"))
    assert all(read_published(spark, target, name).count() == rows for name, rows in counts.items())
    assert counts["stop_times"] == view.stop_times.count() and read_published(spark, target, "stop_times").where("shape_progress_m IS NULL").count() == 0
    parts = list(Path(folder).rglob("part-*"))
    assert parts and all(p.name.endswith(".csv.gz") for p in parts)
