"""Timetable archives, feed payloads and upserts."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from fleetgrain.functions.times import gtfs_seconds, source_timestamp
from fleetgrain.sources.feeds import read_position_feed, state_columns
from fleetgrain.sources.loads import PUBLISHED, STAGED, AlreadyPublished, discard_unpublished, publications, publish, read_published
from fleetgrain.sources.tables import overwrite_upsert, read_current
from fleetgrain.sources.timetable import read_gtfs

MEMBERS = {
    "agency.txt": "agency_id,agency_name,agency_url,agency_timezone\nharbour,Harbour Lines,https://example.org,Europe/Lisbon\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nweekend,0,0,0,0,0,1,1,20250301,20250430\n",
    "calendar_dates.txt": "service_id,date,exception_type\nfair,20250315,1\n",
    "feed_info.txt": "feed_publisher_name,feed_lang,feed_start_date,feed_version\nHarbour Lines,en,20250301,spring\n",
    "routes.txt": "route_id,agency_id,route_short_name,route_type\nquay,harbour,Q7,3\n",
    "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nquay-out,38.70,-9.15,1\nquay-out,38.72,-9.12,2\nquay-out,38.73,-9.10,3\n",
    "stop_times.txt": "\ufefftrip_id,arrival_time,departure_time,stop_id,stop_sequence\nnight-4,24:41:00,24:42:15,pier,5\nnight-4,24:55:00,24:55:00,market,9\n",
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\npier,\"Pier, west side\",38.70,-9.15\nmarket,Market,38.73,-9.10\n",
    "trips.txt": "route_id,service_id,trip_id,direction_id,shape_id\nquay,weekend,night-4,0,quay-out\n",
}


def test_zip_and_folder_agree(spark, tmp_path):
    archive = tmp_path / "feed.zip"
    folder = tmp_path / "feed"
    folder.mkdir()
    with zipfile.ZipFile(archive, "w") as z:
        for name, text in MEMBERS.items():
            z.writestr(name, text)
            (folder / name).write_text(text)
    for path in (str(archive), str(folder)):
        tables = read_gtfs(spark, path, "F1")
        assert tables["trips"].first()["start_seconds"] == 88_935
        assert {r["name"] for r in tables["stops"].collect()} == {"Pier, west side", "Market"}
        services = {r["service_id"]: r for r in tables["services"].collect()}
        assert set(services) == {"weekend", "fair"} and services["fair"]["start_date"] is None and not services["fair"]["saturday"]


def test_missing_members_are_named(spark, tmp_path):
    (tmp_path / "agency.txt").write_text("agency_id\n")
    with pytest.raises(ValueError, match="trips.txt"):
        read_gtfs(spark, str(tmp_path), "F1")


def test_feed_rows_and_rejections(spark, tmp_path):
    (tmp_path / "poll.json").write_text(
        '{"campos":["Prefixo","DataHora","GPS_Latitude","GPS_Longitude","Velocidade","Linha_atual","novo"],'
        '"dados":[["B-17","09/03/2025 21:05:30","38.71","-9.14","2,25","4.112",{"door":"open"}],[null,"","","","","",""],["x"],7]}'
    )
    rows = state_columns(read_position_feed(spark, str(tmp_path))).orderBy("pos").collect()
    assert [r["reject_reason"] for r in rows] == [None, "no_prefix", "wrong_length", "not_a_list"]
    first = rows[0]
    assert (first["vehicle_prefix"], first["normalized_current_line"], first["speed_kmh"]) == ("B-17", "4112", 2.25)
    assert first["source_timestamp"].isoformat() == "2025-03-10T00:05:30"
    assert first["source_timestamp"] is not None and first["source_data"]["novo"] == '{"door":"open"}'


def test_time_text(spark):
    row = spark.range(1).select(
        gtfs_seconds(F.lit("31:02:09")).alias("s"), source_timestamp(F.lit("2025-11-02T23:15:40Z")).alias("z"),
        source_timestamp(F.lit("2025-11-02 20:15")).alias("n"), source_timestamp(F.lit("later today")).alias("bad"),
    ).first()
    assert row["s"] == 111_729 and row["z"].second == 40 and row["n"].hour == 23 and row["bad"] is None


def test_a_load_is_visible_whole_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "core")
    good = spark.range(5).withColumn("feed_id", F.lit("A"))
    bad = good.withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("torn member"))).otherwise(F.col("id")))
    five = {f"t{k}": bad if k == 4 else good for k in range(6)}
    with pytest.raises(Exception, match="torn member"):
        publish(five, target, "h1")
    assert read_published(spark, target, "t0") is None and not publications(spark, target)
    assert publish({**five, "t4": good}, target, "h1") == {f"t{k}": 5 for k in range(6)}
    assert publish({"t0": good.withColumn("feed_id", F.lit("B"))}, target, "h2") == {"t0": 5}
    assert sorted(r["feed_id"] + str(r["id"]) for r in read_published(spark, target, "t0").collect()) == [f"{f}{i}" for f in "AB" for i in range(5)]
    with pytest.raises(AlreadyPublished):
        publish({"t0": good}, target, "h1")
    assert read_published(spark, target, "t0").count() == 10 and read_published(spark, target, "t5").count() == 5
    # a crash between creating the publication and its last byte
    (tmp_path / "core" / PUBLISHED / "h3").write_text('{"folder": "st')
    assert read_published(spark, target, "t0").count() == 10
    publish({"t0": good}, target, "h3")
    assert read_published(spark, target, "t0").count() == 15
    before = len(list((tmp_path / "core" / STAGED).iterdir()))
    assert before == 4 and len(discard_unpublished(spark, target, 1 << 62)) == 1 and read_published(spark, target, "t0").count() == 15


def test_upsert_keeps_the_newer_row(spark, tmp_path):
    path = str(tmp_path / "state")
    schema = "k string, at int, x int"
    overwrite_upsert(spark, path, spark.createDataFrame([("a", 5, 1), ("b", 5, 1), ("a", 3, 7)], schema), ["k"], F.col("at"))
    assert sorted(tuple(r) for r in read_current(spark, path).collect()) == [("a", 5, 1), ("b", 5, 1)]
    overwrite_upsert(spark, path, spark.createDataFrame([("a", 4, 2), ("b", 6, 2), ("c", 1, 2)], schema), ["k"], F.col("at"))
    assert sorted(tuple(r) for r in read_current(spark, path).collect()) == [("a", 5, 1), ("b", 6, 2), ("c", 1, 2)]
