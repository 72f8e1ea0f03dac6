"""Composed jobs: a timetable published once, and what the replay returns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetgrain.catalog import jobs as fixtures
from fleetgrain.catalog.views import Views
from fleetgrain.operators import shapes, timetable
from fleetgrain.plans import jobs
from fleetgrain.session import materialize, shared_dir
from fleetgrain.sources.loads import publications, read_published

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    """The tables of some customers; one of them keeps a single line item."""
    v = Views(spark, FOLDER)
    orders = v.table("orders").where("o_custkey % 4 = 1")
    lone = orders.agg(F.min("o_custkey")).first()[0]
    items = v.table("lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = items.where(F.col("o_custkey") == lone).agg(F.min(F.struct("l_orderkey", "l_linenumber"))).first()[0]
    kept = items.where((F.col("o_custkey") != lone) | ((F.col("l_orderkey") == first[0]) & (F.col("l_linenumber") == first[1]))).drop("o_orderkey", "o_custkey")
    folder = shared_dir(spark, "few")
    for name, df in (("orders", orders), ("lineitem", kept), *((n, v.table(n)) for n in ("region", "customer", "events"))):
        df.write.parquet(f"{folder}/{name}.parquet")
    return Views(spark, folder), lone


def test_timetable_is_published_once(spark, views, monkeypatch):
    v, lone = views
    folder, target = fixtures._folder(v), shared_dir(spark, "core")
    none = spark.createDataFrame([], "content_hash string")
    load = lambda: jobs.timetable_job(spark, folder, "F1", target, none, "2024-01-04 00:00:00")
    read = jobs.read_gtfs

    def torn(*args):
        tables = read(*args)
        tables["feed_info"] = tables["feed_info"].withColumn("version", F.raise_error(F.lit("torn")).cast("string"))
        return tables

    monkeypatch.setattr(jobs, "read_gtfs", torn)
    with pytest.raises(Exception, match="torn"):
        load()
    assert not publications(spark, target) and read_published(spark, target, "routes") is None
    monkeypatch.setattr(jobs, "read_gtfs", read)
    counts = load()
    # the list of known contents was read before another job published this one
    assert load() == {}
    for name, rows in counts.items():
        assert read_published(spark, target, name).count() == rows
    assert read_published(spark, target, "feeds").count() == 1
    assert read_published(spark, target, "shape_segments").where(F.col("shape_id") == f"SH{lone}").count() == 1


def test_replay_places_every_vehicle(spark, views):
    v, _ = views
    tables = jobs.project_timetable(fixtures.walked_tables(v))
    tables |= {n: materialize(tables[n]) for n in ("stop_times", "shape_segments")}
    active = materialize(timetable.active_trips(v.trips, v.routes, v.services, v.exceptions, fixtures.SERVICE_DAY))
    out = jobs.travel_time_replay(fixtures.walking_pings(v, active), tables, active)
    states = out["states"].persist()
    open_ = states.where("correlation_status = 'matched' AND map_match_status <> 'resolved'")
    assert open_.count() > 0 and open_.where("shape_position IS NULL OR projection_quality IS NULL").count() == 0
    placed = shapes.project_on_shape(open_, tables["shape_segments"], ["vehicle_prefix", "event_at"])
    both = open_.join(placed.select("vehicle_prefix", "event_at", F.col("shape_progress_m").alias("want")), ["vehicle_prefix", "event_at"])
    assert both.count() == open_.count() and both.where("shape_progress_m <> want").count() == 0
    assert {r[0] for r in open_.where("distance_to_shape_m > 50").select("map_match_status").distinct().collect()} <= {"fallback_required"}
    current = {r["vehicle_prefix"]: r for r in out["current"].collect()}
    assert len(current) == states.select("vehicle_prefix").distinct().count()
    stops = {}
    for r in tables["stop_times"].select("trip_id", "stop_sequence", "stop_id", "shape_position", "quality").collect():
        stops.setdefault(str(r["trip_id"]), []).append(tuple(r)[1:])
    located = 0
    for r in current.values():
        want = None
        if r["map_match_status"] == "resolved":
            line = sorted(stops.get(str(r["trip_id"]), []))
            pairs = [(a, b) for a, b in zip(line, line[1:]) if a[3] in ("valid", "reduced") and b[3] in ("valid", "reduced")]
            around = [(a[2], a[0], a[1], b[1]) for a, b in pairs if a[2] <= r["shape_position"] < b[2]]
            want = max(around)[2:] if around else None
        got = (r["current_origin_stop_id"], r["current_destination_stop_id"])
        assert got == (want or (None, None))
        located += want is not None
    assert located > 0
