"""Registered source and sink queries; files are written by Spark from the tables first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.functions.times import clock_text
from fleetgrain.session import shared_dir
from fleetgrain.sources.feeds import read_delimited
from fleetgrain.sources.loads import read_published
from fleetgrain.sources.merge import merge_into, read_merged
from fleetgrain.sources.timetable import append_feed_tables, new_feed_versions, read_gtfs

R = Registry()
c = F.col


def timetable_folder(v) -> str:
    """The timetable views written as a folder of comma-separated members."""
    folder = shared_dir(v.spark, "timetable")
    flag = lambda d: c(d).cast("int").cast("string").alias(d)
    day = lambda d: F.date_format(d, "yyyyMMdd")
    members = {
        "agency.txt": v.nation.select(c("n_nationkey").alias("agency_id"), c("n_name").alias("agency_name"), F.lit("http://localhost").alias("agency_url"), F.lit("America/Sao_Paulo").alias("agency_timezone")),
        "calendar.txt": v.services.select("service_id", *[flag(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")], day("start_date").alias("start_date"), day("end_date").alias("end_date")),
        "calendar_dates.txt": v.exceptions.select("service_id", day("service_date").alias("date"), "exception_type"),
        "feed_info.txt": v.region.agg(F.min("r_name").alias("feed_publisher_name")).withColumn("feed_lang", F.lit("pt")),
        "routes.txt": v.routes.select("route_id", c("short_name").alias("route_short_name"), c("long_name").alias("route_long_name"), F.lit(3).alias("route_type")),
        "shapes.txt": v.shape_points.select("shape_id", c("latitude").alias("shape_pt_lat"), c("longitude").alias("shape_pt_lon"), c("sequence").alias("shape_pt_sequence")),
        "stop_times.txt": v.stop_times.select("trip_id", clock_text(c("arrival_seconds")).alias("arrival_time"), clock_text(c("departure_seconds")).alias("departure_time"), "stop_id", "stop_sequence"),
        "stops.txt": v.stops.select("stop_id", c("name").alias("stop_name"), c("latitude").alias("stop_lat"), c("longitude").alias("stop_lon")),
        "trips.txt": v.trips.select("route_id", "service_id", "trip_id", c("headsign").alias("trip_headsign"), "direction_id", "shape_id"),
    }
    for name, df in members.items():
        df.write.option("header", True).csv(f"{folder}/{name}")
    return folder


COUNT_SQL = """SELECT 'agencies' AS table_name, count(*) AS rows FROM nation UNION ALL SELECT 'services', count(*) FROM (SELECT service_id FROM services UNION SELECT service_id FROM exceptions)
UNION ALL SELECT 'service_exceptions', count(*) FROM exceptions UNION ALL SELECT 'routes', count(*) FROM routes UNION ALL SELECT 'shape_points', count(*) FROM shape_points
UNION ALL SELECT 'stops', count(*) FROM stops UNION ALL SELECT 'trips', count(*) FROM trips UNION ALL SELECT 'stop_times', count(*) FROM stop_times UNION ALL SELECT 'feed_info', 1"""
VIEWS = "services exceptions routes shape_points stops trips stop_times"


def _counts(v):
    tables = read_gtfs(v.spark, timetable_folder(v), "F1")
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(name)) for name, df in tables.items()])


R.add("S01_read_gtfs", "table_name:s, rows:i", _counts, COUNT_SQL, VIEWS)
R.add(
    "S01_read_gtfs_trips", "trip_id:i, route_id:s, direction_id:i, start_seconds:i, headsign:s", lambda v: read_gtfs(v.spark, timetable_folder(v), "F1")["trips"],
    "SELECT t.trip_id, route_id, direction_id, s.dep AS start_seconds, headsign FROM trips t LEFT JOIN (SELECT trip_id, arg_min(departure_seconds, stop_sequence) AS dep FROM stop_times GROUP BY 1) s USING (trip_id)", "trips stop_times",
)


def _appended(v):
    """Tables appended twice under two versions, read back by version."""
    folder = shared_dir(v.spark, "core")
    for feed in ("F1", "F2"):
        append_feed_tables({"stop_times": v.stop_times.withColumn("feed_id", F.lit(feed)), "trips": v.trips.withColumn("feed_id", F.lit(feed))}, folder)
    tables = [read_published(v.spark, folder, n).groupBy("feed_id").agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(n)) for n in ("stop_times", "trips")]
    return tables[0].unionByName(tables[1])


R.add(
    "S06_append_feed_tables", "table_name:s, feed_id:s, rows:i", _appended,
    "SELECT 'stop_times' AS table_name, f AS feed_id, count(*) AS rows FROM stop_times, (VALUES ('F1'), ('F2')) AS x(f) GROUP BY f UNION ALL SELECT 'trips', f, count(*) FROM trips, (VALUES ('F1'), ('F2')) AS x(f) GROUP BY f", "stop_times trips",
)


def _delimited(v):
    folder = shared_dir(v.spark, "deliveries")
    v.deliveries.write.option("header", True).option("sep", ";").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return read_delimited(v.spark, folder)


R.add(
    "S04_read_delimited", "o_orderkey:s, id_viagem:s, filial:s, motivo:s, valor_frete:s", _delimited,
    "SELECT o_orderkey, id_viagem, nullif(filial, '') AS filial, motivo, valor_frete FROM deliveries", "deliveries",
)


def _versions(v):
    """Documents as incoming contents; those of one language count as loaded."""
    docs = v.documents.select(c("doc_id").cast("string").alias("source"), F.encode("text", "UTF-8").alias("content"), "lang")
    loaded = docs.filter("lang = 'en'").select(F.sha2("content", 256).alias("content_hash")).distinct()
    return new_feed_versions(docs.select("source", "content"), loaded)


R.add(
    "S05_new_feed_versions", "content_hash:s, source:s", _versions,
    "SELECT sha256(text) AS content_hash, min(CAST(doc_id AS VARCHAR)) AS source FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY 1",
)


def _merged(v):
    """Orders as first load, their shipments as an update that wins where it is newer."""
    folder = shared_dir(v.spark, "merged")
    orders = v.orders.select("o_orderkey", c("o_orderdate").cast("date").alias("day"), c("o_custkey").cast("long").alias("amount"))
    shipped = v.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("date").alias("day"), F.count("*").alias("amount"))
    for updates in (orders, shipped):
        merge_into(v.spark, folder, updates, ["o_orderkey"], c("day"), buckets=16)
    return read_merged(v.spark, folder).withColumn("day", c("day").cast("string"))


R.add(
    "S07_merge_into", "o_orderkey:i, day:s, amount:i", _merged,
    """SELECT coalesce(o.o_orderkey, s.k) AS o_orderkey, CAST(CASE WHEN o.day IS NULL OR s.day > o.day THEN s.day ELSE o.day END AS VARCHAR) AS day, CASE WHEN o.day IS NULL OR s.day > o.day THEN s.n ELSE o.c END AS amount
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_custkey AS c FROM orders) o FULL JOIN (SELECT l_orderkey AS k, CAST(min(l_shipdate) AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1) s ON o.o_orderkey = s.k""",
)
