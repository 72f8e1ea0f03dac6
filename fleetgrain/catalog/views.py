"""Domain views over the given tables, in SQL that Spark and DuckDB both run.

The given tables hold no timetable and no positions, so operators run on
these views. A view reads whole tables; `{json}` and the date formats are the
only engine-specific parts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AT = "2024-01-31 00:00:00"
TABLES = ("nation", "customer", "orders", "lineitem", "part", "events")
_SPARK = {
    "json": "get_json_object",
    "fmt_iso": "date_format(o_orderdate,'yyyy-MM-dd')",
    "fmt_br": "date_format(o_orderdate,'dd/MM/yyyy')",
    "ship_iso": "date_format(l_shipdate,'yyyy-MM-dd HH:mm')",
    "days": "date_add(l_shipdate, l_linenumber)",
    "day_iso": "date_format(d,'yyyy-MM-dd HH:mm')",
    "secs": "make_dt_interval(0,0,0,({0}))",
    "doc_bytes": "encode(text,'UTF-8')",
}
_DUCK = {
    "json": "json_extract_string",
    "fmt_iso": "strftime(o_orderdate,'%Y-%m-%d')",
    "fmt_br": "strftime(o_orderdate,'%d/%m/%Y')",
    "ship_iso": "strftime(l_shipdate,'%Y-%m-%d %H:%M')",
    "days": "(l_shipdate + to_days(l_linenumber))",
    "day_iso": "strftime(d,'%Y-%m-%d %H:%M')",
    "secs": "to_seconds({0})",
    "doc_bytes": "text",
}

_K = "(SELECT *, CAST({json}(props,'$.k') AS INT) AS k FROM events) e"
_SEQ = (
    "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,"
    " l_extendedprice, l_shipdate) AS INT)"
)

VIEWS: dict[str, str] = {
    "pings": f"""
SELECT event_id, concat('V', CAST(user_id AS STRING)) AS vehicle_prefix, CAST(ts AS TIMESTAMP) AS source_timestamp,
 CAST(ts AS TIMESTAMP) AS received_at, value / 10.0 AS speed_kmh, event_type AS line, k % 2 AS direction_id, k,
 CAST(-15.8 + ((event_id * 7919) % 2000) / 100000.0 AS DOUBLE) AS latitude, CAST(-47.9 + ((event_id * 104729) % 2000) / 100000.0 AS DOUBLE) AS longitude,
 CAST(((event_id * 37) % 5000) * 1.0 AS DOUBLE) AS shape_progress_m, 'F1' AS feed_id,
 concat('T', CAST(user_id % 7 AS STRING)) AS trip_id, concat('SH', CAST(user_id % 7 AS STRING)) AS shape_id
 FROM {_K}""",
    # a denser stream: one vehicle per event type, so windows and resets both occur
    "tracks": f"""
SELECT event_id, concat('V', event_type) AS vehicle_prefix, CAST(ts AS TIMESTAMP) AS source_timestamp,
 CAST(ts AS TIMESTAMP) AS received_at, CASE WHEN k % 5 = 0 THEN NULL ELSE value / 10.0 END AS speed_kmh,
 CAST(-15.8 + ((event_id * 7919) % 2000) / 100000.0 AS DOUBLE) AS latitude, CAST(-47.9 + ((event_id * 104729) % 2000) / 100000.0 AS DOUBLE) AS longitude,
 'F1' AS feed_id, concat('T', CAST(event_id - event_id % 400 AS STRING)) AS trip_id, 'SH1' AS shape_id, k
 FROM {_K}""",
    "completions": f"""
SELECT event_id, concat(event_type, '>', CAST(user_id % 5 AS STRING)) AS metric_key, event_type AS origin_stop_id,
 CAST(user_id % 5 AS STRING) AS destination_stop_id, CAST(ts AS TIMESTAMP) AS completed_at, 30.0 + value AS duration_seconds,
 (30.0 + value) * (2 + k % 25) AS distance_m, CASE WHEN k % 3 = 0 THEN 'reduced' ELSE 'high' END AS confidence, k
 FROM {_K}""",
    "assessed": """
SELECT *, (duration_seconds > 0 AND distance_m / duration_seconds * 3.6 <= 80.0) AS accepted,
 CASE WHEN distance_m / duration_seconds * 3.6 > 80.0 THEN CAST(0 AS DOUBLE) WHEN confidence = 'high' THEN 1.0 ELSE 0.5 END AS weight,
 CASE WHEN distance_m / duration_seconds * 3.6 <= 80.0 THEN NULL ELSE 'speed_over_80' END AS rejection_reason
 FROM completions""",
    "stop_times": f"""
SELECT 'F1' AS feed_id, trip_id, seq AS stop_sequence, concat('S', CAST(l_suppkey % 40 AS STRING)) AS stop_id,
 CAST(18000 + (trip_id % 900) * 60 + seq * 120 + l_partkey % 60 AS INT) AS arrival_seconds,
 CAST(18000 + (trip_id % 900) * 60 + seq * 120 + l_partkey % 60 + 15 AS INT) AS departure_seconds,
 CAST(seq * 400 + l_partkey % 150 AS DOUBLE) AS shape_progress_m,
 CAST(seq * 400 + l_partkey % 150 AS DOUBLE) / 8000.0 AS shape_position,
 CASE WHEN l_partkey % 50 < 35 THEN 'valid' WHEN l_partkey % 50 < 45 THEN 'reduced' ELSE 'fallback_required' END AS quality
 FROM (SELECT l_orderkey AS trip_id, l_partkey, l_suppkey, {_SEQ} AS seq FROM lineitem) x""",
    "trips": """
SELECT 'F1' AS feed_id, o_orderkey AS trip_id, concat('R', CAST(o_custkey % 20 AS STRING)) AS route_id,
 CAST(o_orderkey % 2 AS INT) AS direction_id, o_orderpriority AS service_id, concat('SH', CAST(o_custkey AS STRING)) AS shape_id,
 concat('to ', CAST(o_custkey % 9 AS STRING)) AS headsign, CAST(18000 + (o_orderkey % 900) * 60 AS INT) AS start_seconds
 FROM orders""",
    "routes": """
SELECT DISTINCT 'F1' AS feed_id, concat('R', CAST(o_custkey % 20 AS STRING)) AS route_id,
 concat('0.', CAST(o_custkey % 20 AS STRING)) AS short_name, concat('Route ', CAST(o_custkey % 20 AS STRING)) AS long_name FROM orders""",
    "stops": """
SELECT DISTINCT 'F1' AS feed_id, concat('S', CAST(l_suppkey % 40 AS STRING)) AS stop_id,
 concat('Stop ', CAST(l_suppkey % 40 AS STRING)) AS name,
 CAST(-15.8 + (l_suppkey % 40) * 0.0007 AS DOUBLE) AS latitude, CAST(-47.9 + (l_suppkey % 40) * 0.0005 AS DOUBLE) AS longitude FROM lineitem""",
    "services": """
SELECT 'F1' AS feed_id, service_id, i % 2 = 1 AS monday, i % 2 = 1 AS tuesday, i % 3 > 0 AS wednesday, true AS thursday, i < 5 AS friday,
 i IN (2, 4) AS saturday, i = 5 AS sunday, DATE '2024-01-01' AS start_date,
 CASE WHEN i = 3 THEN DATE '2024-01-15' ELSE DATE '2024-01-31' END AS end_date
 FROM (SELECT DISTINCT o_orderpriority AS service_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS i FROM orders) p""",
    "exceptions": " UNION ALL ".join(
        f"SELECT 'F1' AS feed_id, service_id, DATE '2024-01-{1 + d:02d}' AS service_date, {1 if d % 2 == 0 else 2} AS exception_type"
        " FROM (SELECT DISTINCT o_orderpriority AS service_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS i FROM orders)"
        f" p{d} WHERE (i + {d}) % 2 = 0"
        for d in (3, 6, 11, 20)
    ),
    "shape_points": """
SELECT 'F1' AS feed_id, shape_id, seq AS sequence, CAST(-15.8 + 0.0006 * seq + (l_partkey % 10) * 0.00005 AS DOUBLE) AS latitude,
 CAST(-47.9 + 0.0004 * seq + (l_partkey % 7) * 0.00005 AS DOUBLE) AS longitude
 FROM (SELECT concat('SH', CAST(o_custkey AS STRING)) AS shape_id, l_partkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x""",
    # positions near their shape: a ping per order around the shape of its customer
    "shape_pings": """
SELECT o_orderkey AS ping_id, 'F1' AS feed_id, concat('SH', CAST(o_custkey AS STRING)) AS shape_id,
 CAST(-15.8 + 0.0006 * (1 + o_orderkey % 30) + (o_orderkey % 13 - 6) * 0.00006 AS DOUBLE) AS latitude,
 CAST(-47.9 + 0.0004 * (1 + o_orderkey % 30) + (o_orderkey % 11 - 5) * 0.00006 AS DOUBLE) AS longitude FROM orders""",
    "feeds": """
SELECT concat('F', CAST(user_id AS STRING)) AS feed_id, max(CAST(ts AS TIMESTAMP)) AS retrieved_at FROM events GROUP BY user_id""",
    "deliveries": """
SELECT o_orderkey, CAST(o_orderkey - o_orderkey % 40 % 2 AS STRING) AS id_viagem,
 CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN upper(n_name) WHEN o_orderkey % 7 = 0 THEN concat('  ', n_name, ' ') ELSE n_name END AS filial,
 c_mktsegment AS segmento, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderpriority END AS motivo,
 CASE WHEN o_orderkey % 3 = 0 THEN {fmt_iso} WHEN o_orderkey % 3 = 1 THEN {fmt_br} WHEN o_orderkey % 31 = 0 THEN 'n/d' ELSE {fmt_iso} END AS data_coleta,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '.', ',')
  ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END AS valor_frete,
 CAST(o_orderkey % 90 - 30 AS STRING) AS atraso_min, CASE WHEN o_orderkey % 90 - 30 <= (o_orderkey % 11) THEN '1' ELSE '0' END AS entregue_no_prazo,
 CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE concat('sys', CAST(o_orderkey % 4 AS STRING)) END AS origem_registo,
 CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE CAST(o_custkey % 700 AS STRING) END AS rota_km,
 CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE CAST(o_orderkey % 120 - 50 AS STRING) END AS temperatura,
 CASE WHEN o_orderkey % 41 = 0 THEN '-5' ELSE CAST(o_orderkey % 90001 AS STRING) END AS peso_kg,
 CAST(o_custkey % 260 AS STRING) AS volume_m3, CAST(o_orderkey % 26000 AS STRING) AS combustivel, CAST(o_orderkey % 12000 AS STRING) AS pedagio
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    # planned and actual times per consignment line
    "shipments": """
SELECT l_orderkey, CASE WHEN l_quantity > 48 THEN '' ELSE {ship_iso} END AS saida_real,
 {day_iso} AS chegada_real, {ship_iso} AS saida_prevista,
 CASE WHEN l_linenumber % 2 = 0 THEN {day_iso} ELSE {ship_iso} END AS chegada_prevista,
 CASE WHEN l_quantity < 3 THEN '31/02/2020' ELSE {fmt_br} END AS data_coleta, CAST(l_linenumber * 1440 AS STRING) AS atraso_min
 FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, o_orderdate, {days} AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x""",
    "commitments": """
SELECT concat('V', CAST(o_orderkey AS STRING)) AS vehicle_prefix, concat('T', CAST(o_custkey AS STRING)) AS terminal_id,
 CAST(o_orderkey % 97 * 60 - 1200 AS INT) AS arrival_s, CAST((o_orderkey * 7 + o_custkey) % 83 * 60 AS INT) AS departure_s,
 TIMESTAMP '2024-01-31 00:00:00' + {secs:o_orderkey % 97 * 60 - 1200} AS arrival_at,
 TIMESTAMP '2024-01-31 00:00:00' + {secs:(o_orderkey * 7 + o_custkey) % 83 * 60} AS departure_at,
 CAST((o_orderkey % 10) / 10.0 AS DOUBLE) AS eta_reliability FROM orders""",
    "roster": """
SELECT concat('V', CAST(o_custkey AS STRING)) AS vehicle_prefix, o_orderkey AS trip_number, concat('L', CAST(o_custkey % 20 AS STRING)) AS line,
 concat('T', CAST(o_custkey % 60 AS STRING)) AS destination_name,
 TIMESTAMP '2024-01-30 00:00:00' + {secs:o_orderkey % 2880 * 60} AS planned_start_at,
 TIMESTAMP '2024-01-30 00:00:00' + {secs:o_orderkey % 2880 * 60 + 2700} AS planned_end_at,
 CASE WHEN o_orderkey % 3 > 0 THEN TIMESTAMP '2024-01-30 00:00:00' + {secs:o_orderkey % 2880 * 60 + o_orderkey % 11 * 60} END AS actual_start_at,
 CASE WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '2024-01-30 00:00:00' + {secs:o_orderkey % 2880 * 60 + 2700 + o_orderkey % 7 * 60} END AS actual_end_at FROM orders""",
    "decision_events": """
SELECT event_id, concat('G', CAST(user_id AS STRING)) AS execution_key, CAST(ts AS TIMESTAMP) AS occurred_at, concat('op', CAST(event_id % 9 AS STRING)) AS actor,
 CASE event_type WHEN 'view' THEN 'in_analysis' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'executed' WHEN 'error' THEN 'rejected' ELSE 'in_analysis' END AS status,
 CASE WHEN event_type = 'error' AND event_id % 4 > 0 THEN 'no driver' END AS reason FROM events""",
    "runs": f"""
SELECT event_id AS run_id, event_type AS source_system, CAST(ts AS TIMESTAMP) AS started_at,
 CASE WHEN k % 10 = 0 THEN 'failed' WHEN k % 10 = 1 THEN 'partial' ELSE 'succeeded' END AS status,
 CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + INTERVAL 4 SECOND END AS finished_at, k AS records_received FROM {_K}""",
    "states": """
SELECT 'F1' AS feed_id, concat('V', CAST(o_orderkey AS STRING)) AS vehicle_prefix, o_orderkey AS trip_id,
 concat('R', CAST(o_custkey % 20 AS STRING)) AS route_id, CAST(o_orderkey % 2 AS INT) AS direction_id, concat('SH', CAST(o_custkey AS STRING)) AS shape_id,
 CAST(o_orderkey % 400 AS INT) AS source_age_s, TIMESTAMP '2024-01-31 00:00:00' - {secs:o_orderkey % 400} AS source_timestamp,
 TIMESTAMP '2024-01-31 00:00:00' - {secs:o_orderkey % 400} AS projected_at,
 CAST(300 + o_orderkey % 1500 AS DOUBLE) AS shape_progress_m, CAST(300 + o_orderkey % 1500 AS DOUBLE) / 8000.0 AS shape_position,
 o_totalprice / 10000.0 AS speed_kmh,
 CASE WHEN o_orderkey % 6 = 0 THEN 'ambiguous' WHEN o_orderkey % 7 = 0 THEN 'collecting' WHEN o_orderkey % 11 = 0 THEN 'fallback_required' ELSE 'resolved' END AS map_match_status,
 CASE WHEN o_orderkey % 9 = 0 THEN 'no_exact_match' ELSE 'unique_exact_match' END AS correlation_reason,
 CASE WHEN o_orderkey % 8 = 0 THEN ' ' ELSE '10:30' END AS current_planned_time, CAST(o_orderkey % 53 AS DOUBLE) AS distance_to_shape_m,
 CASE WHEN o_orderkey % 53 <= 30 THEN 'valid' WHEN o_orderkey % 53 <= 50 THEN 'reduced' ELSE 'fallback_required' END AS projection_quality,
 CASE WHEN o_orderkey % 14 > 0 THEN CAST(-15.8 + (o_orderkey % 50) * 0.001 AS DOUBLE) END AS latitude, CAST(-47.9 + (o_orderkey % 70) * 0.001 AS DOUBLE) AS longitude,
 CASE WHEN o_totalprice < 10000 THEN TIMESTAMP '2024-01-31 00:00:00' - {secs:o_orderkey % 900} END AS low_speed_since,
 concat('0.', CAST(o_custkey % 20 AS STRING)) AS current_line, concat('to ', CAST(o_custkey % 9 AS STRING)) AS headsign,
 CAST(1 + o_orderkey % 3 AS INT) AS current_origin_stop_sequence, CAST(2 + o_orderkey % 3 AS INT) AS current_destination_stop_sequence,
 concat('S', CAST(o_custkey % 50 AS STRING)) AS current_origin_stop_id, concat('S', CAST(o_orderkey % 50 AS STRING)) AS current_destination_stop_id,
 CAST(1 + o_orderkey % 4 AS INT) AS position_sample_count FROM orders""",
    "snapshots": """
SELECT concat('V', CAST(o_orderkey AS STRING)) AS vehicle_prefix, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS trip_id,
 concat('R', CAST(o_custkey % 20 AS STRING)) AS route_id,
 TIMESTAMP '2024-01-31 00:00:00' - {secs:o_orderkey % 900} AS generated_at,
 CASE WHEN o_orderkey % 4 = 0 THEN 'planned_baseline' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'enriched' END AS calculation_mode,
 TIMESTAMP '2024-01-31 00:00:00' + {secs:o_orderkey % 3000} AS estimated_at,
 CASE WHEN o_orderkey % 6 > 0 THEN TIMESTAMP '2024-01-31 00:00:00' + {secs:o_orderkey % 2500} END AS planned_trip_end_at
 FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) seen ON o_orderkey = l_orderkey""",
    "eta_counts": """
SELECT concat('V', CAST(o_orderkey AS STRING)) AS vehicle_prefix, CAST(o_orderkey % 4 AS BIGINT) AS live, CAST(o_custkey % 3 AS BIGINT) AS historical,
 CAST(o_orderkey % 7 AS BIGINT) AS gtfs_planned FROM orders""",
}
# The same rows for Spark, with fewer columns in the shuffle: rows that are equal in all columns
# a view reads give the same rows in either order, so nothing else needs to break their ties.
# trip_id is named above the window, so that Spark sees that its rows lie by trip already.
_SHORT_SEQ = _SEQ.replace(", l_extendedprice, l_shipdate", "")
_FOR_SPARK = {
    "stop_times": VIEWS["stop_times"].replace(
        f"(SELECT l_orderkey AS trip_id, l_partkey, l_suppkey, {_SEQ} AS seq FROM lineitem)",
        f"(SELECT l_orderkey AS trip_id, l_partkey, l_suppkey, seq FROM (SELECT l_orderkey, l_partkey, l_suppkey, {_SHORT_SEQ} AS seq FROM lineitem) y)",
    ),
    "shape_points": VIEWS["shape_points"].replace(
        "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)", "ORDER BY l_orderkey, l_linenumber, l_partkey)"
    ),
}
_DEPENDS = {"assessed": ["completions"]}


def _fill(sql: str, engine: dict[str, str]) -> str:
    def one(match: re.Match) -> str:
        name, _, argument = match.group(1).partition(":")
        return engine[name].replace("{0}", argument) if argument else engine[name]

    return re.sub(r"\{([a-z_]+(?::[^{}]*)?)\}", one, sql)


def duck_view(name: str) -> str:
    return _fill(VIEWS[name], _DUCK)


def duck_with(names: list[str]) -> str:
    """WITH clause defining the named views and what they depend on."""
    ordered: list[str] = []
    for name in names:
        for needed in (*_DEPENDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    return "WITH " + ",\n".join(f"{n} AS ({duck_view(n)})" for n in ordered)


class Views:
    """Spark DataFrames of the views and tables below one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        text = _fill(_FOR_SPARK.get(name, VIEWS[name]), _SPARK)
        sources = {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", text)}
        sources |= {d: getattr(self, d) for d in _DEPENDS.get(name, ())}
        return self.sql(text, **sources)

    def sql(self, text: str, **sources: DataFrame) -> DataFrame:
        for source in sources:
            text = re.sub(rf"(?<=FROM |JOIN ){source}\b", "{" + source + "}", text)
        return self.spark.sql(text, **sources)
