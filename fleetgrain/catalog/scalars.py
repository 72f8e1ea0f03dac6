"""Registered projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.catalog.views import AT
from fleetgrain.functions import identity, status, text, times
from fleetgrain.functions.times import at_lit
from fleetgrain.operators import fleet
from fleetgrain.operators.eta import eligible_for_eta
from fleetgrain.operators.samples import metric_identities
from fleetgrain.operators.swaps import eta_payload_fields
from fleetgrain.sources.feeds import state_columns

R = Registry()
T = f"TIMESTAMP '{AT}'"
c = F.col

R.add(
    "P01_text_or_null", "o_orderkey:i, filial:s, motivo:s",
    lambda v: v.deliveries.select("o_orderkey", text.text_or_null(c("filial")).alias("filial"), text.text_or_null(c("motivo")).alias("motivo")),
    "SELECT o_orderkey, nullif(trim(filial), '') AS filial, nullif(trim(motivo), '') AS motivo FROM deliveries", "deliveries",
)
R.add(
    "P02_decimal_comma", "o_orderkey:i, valor:f, rota:f",
    lambda v: v.deliveries.select("o_orderkey", text.decimal_comma(c("valor_frete")).alias("valor"), text.decimal_comma(c("rota_km")).alias("rota")),
    "SELECT o_orderkey, TRY_CAST(replace(trim(valor_frete), ',', '.') AS DOUBLE) AS valor, TRY_CAST(replace(trim(rota_km), ',', '.') AS DOUBLE) AS rota FROM deliveries",
    "deliveries",
)
R.add(
    "P03_source_timestamp", "event_id:i, iso:t, zoned:t, day_first:t, bad:t",
    lambda v: v.pings.select(
        "event_id",
        times.source_timestamp(F.date_format("source_timestamp", "yyyy-MM-dd HH:mm:ss")).alias("iso"),
        times.source_timestamp(F.date_format("source_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("zoned"),
        times.source_timestamp(F.date_format("source_timestamp", "dd/MM/yyyy HH:mm")).alias("day_first"),
        times.source_timestamp(F.date_format("source_timestamp", "HH:mm dd.MM.yyyy")).alias("bad"),
    ),
    """SELECT event_id, date_trunc('second', source_timestamp) + INTERVAL 3 HOUR AS iso, date_trunc('second', source_timestamp) AS zoned,
 date_trunc('minute', source_timestamp) + INTERVAL 3 HOUR AS day_first, CAST(NULL AS TIMESTAMP) AS bad FROM pings""",
    "pings",
)
R.add(
    "P04_locale_number", "o_orderkey:i, valor:f, grouped:f, reversed:f",
    lambda v: v.deliveries.select(
        "o_orderkey", text.locale_number(c("valor_frete")).alias("valor"),
        text.locale_number(F.concat(F.lit("1."), c("peso_kg"), F.lit(",25"))).alias("grouped"),
        text.locale_number(F.concat(F.lit("1,"), c("peso_kg"), F.lit(".25"))).alias("reversed"),
    ),
    """SELECT o_orderkey, TRY_CAST(replace(trim(valor_frete), ',', '.') AS DOUBLE) AS valor,
 TRY_CAST(concat('1', peso_kg, '.25') AS DOUBLE) AS grouped, TRY_CAST(concat('1', peso_kg, '.25') AS DOUBLE) AS reversed FROM deliveries""",
    "deliveries",
)
R.add(
    "P05_locale_date", "o_orderkey:i, collected:t",
    lambda v: v.deliveries.select("o_orderkey", times.locale_date(c("data_coleta")).alias("collected")),
    """SELECT o_orderkey, coalesce(try_strptime(trim(data_coleta), '%Y-%m-%d %H:%M'), try_strptime(trim(data_coleta), '%Y-%m-%d'),
 try_strptime(trim(data_coleta), '%d/%m/%Y %H:%M'), try_strptime(trim(data_coleta), '%d/%m/%Y')) AS collected FROM deliveries""",
    "deliveries",
)
R.add(
    "P06_canonical_text", "o_orderkey:i, canonical:s",
    lambda v: v.deliveries.select("o_orderkey", text.canonical_text(F.concat(c("filial"), F.lit("  São "), c("motivo"))).alias("canonical")),
    "SELECT o_orderkey, lower(strip_accents(regexp_replace(trim(concat(filial, '  São ', motivo)), '\\s+', ' ', 'g'))) AS canonical FROM deliveries",
    "deliveries",
)
R.add(
    "P07_is_blank", "o_orderkey:i, filial:b, motivo:b, valor:b",
    lambda v: v.deliveries.select("o_orderkey", text.is_blank(c("filial")).alias("filial"), text.is_blank(c("motivo")).alias("motivo"), text.is_blank(c("valor_frete")).alias("valor")),
    "SELECT o_orderkey, coalesce(trim(filial), '') = '' AS filial, coalesce(trim(motivo), '') = '' AS motivo, coalesce(trim(valor_frete), '') = '' AS valor FROM deliveries",
    "deliveries",
)
R.add(
    "P08_normalize_line", "vehicle_prefix:s, line:s",
    lambda v: v.states.select("vehicle_prefix", text.normalize_line(F.concat(F.lit(" "), c("current_line"), F.lit(" "))).alias("line")),
    "SELECT vehicle_prefix, nullif(replace(trim(concat(' ', current_line, ' ')), '.', ''), '') AS line FROM states", "states",
)
R.add(
    "P09_service_time", "trip_id:i, stop_sequence:i, plain:s, inside:s",
    lambda v: v.stop_times.select(
        "trip_id", "stop_sequence",
        text.service_time(times.clock_text(c("arrival_seconds"))).alias("plain"),
        text.service_time(F.concat(F.lit("x123:45 "), F.floor(c("arrival_seconds") / 3600).cast("string"), F.lit(":07 y"))).alias("inside"),
    ),
    """SELECT trip_id, stop_sequence,
 concat(lpad(CAST(arrival_seconds // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST(arrival_seconds % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(arrival_seconds % 60 AS VARCHAR), 2, '0')) AS plain,
 concat(lpad(CAST(arrival_seconds // 3600 AS VARCHAR), 2, '0'), ':07:00') AS inside FROM stop_times""",
    "stop_times",
)
R.add(
    "P10_gtfs_date", "o_orderkey:i, day:d, empty:d",
    lambda v: v.orders.select("o_orderkey", times.gtfs_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), times.gtfs_date(F.lit("")).alias("empty")),
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS DATE) AS empty FROM orders",
)
R.add(
    "P11_gtfs_seconds", "trip_id:i, stop_sequence:i, clock:s, seconds:i",
    lambda v: v.stop_times.withColumn("clock", times.clock_text(c("arrival_seconds") + 50000)).select("trip_id", "stop_sequence", "clock", times.gtfs_seconds(c("clock")).alias("seconds")),
    """SELECT trip_id, stop_sequence, arrival_seconds + 50000 AS seconds,
 concat(lpad(CAST((arrival_seconds + 50000) // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST((arrival_seconds + 50000) % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST((arrival_seconds + 50000) % 60 AS VARCHAR), 2, '0')) AS clock FROM stop_times""",
    "stop_times",
)
R.add(
    "P12_valid_position", "event_id:i, latitude:f, longitude:f, valid:b",
    lambda v: v.pings.select("event_id", status.valid_position(c("latitude") * (c("k") - 40), c("longitude") * (c("k") % 7)).alias("p")).select("event_id", "p.*"),
    """SELECT event_id, CASE WHEN ok THEN la END AS latitude, CASE WHEN ok THEN lo END AS longitude, ok AS valid
 FROM (SELECT *, la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AS ok FROM (SELECT event_id, latitude * (k - 40) AS la, longitude * (k % 7) AS lo FROM pings) a) b""",
    "pings",
)
R.add(
    "P13_nonnegative_speed", "event_id:i, speed:f",
    lambda v: v.pings.select("event_id", status.nonnegative_speed(c("speed_kmh") - 5).alias("speed")),
    "SELECT event_id, CASE WHEN speed_kmh - 5 >= 0 THEN speed_kmh - 5 END AS speed FROM pings", "pings",
)
R.add(
    "P14_optional_number", "o_orderkey:i, as_int:i, as_double:f",
    lambda v: v.deliveries.select("o_orderkey", text.optional_number(c("temperatura"), "int").alias("as_int"), text.optional_number(c("temperatura")).alias("as_double")),
    "SELECT o_orderkey, TRY_CAST(nullif(temperatura, '') AS INTEGER) AS as_int, TRY_CAST(nullif(temperatura, '') AS DOUBLE) AS as_double FROM deliveries",
    "deliveries",
)
R.add(
    "P15_five_minute_window", "event_id:i, start:t, stop:t",
    lambda v: v.pings.select("event_id", times.five_minute_window(c("source_timestamp")).alias("w")).select("event_id", c("w.start").alias("start"), c("w.end").alias("stop")),
    "SELECT event_id, time_bucket(INTERVAL 5 MINUTE, source_timestamp) AS start, time_bucket(INTERVAL 5 MINUTE, source_timestamp) + INTERVAL 5 MINUTE AS stop FROM pings",
    "pings",
)
_LOCAL = "(source_timestamp - INTERVAL 3 HOUR)"
_DAY = "CASE isodow({0}) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END"
R.add(
    "P16_day_type", "event_id:i, day_type:s",
    lambda v: v.pings.select("event_id", times.day_type(c("source_timestamp")).alias("day_type")),
    f"SELECT event_id, {_DAY.format(_LOCAL)} AS day_type FROM pings", "pings",
)
R.add(
    "P17_service_date", "event_id:i, service_date:d",
    lambda v: v.pings.select("event_id", times.service_date(c("source_timestamp")).alias("service_date")),
    f"SELECT event_id, CAST({_LOCAL} AS DATE) AS service_date FROM pings", "pings",
)
R.add(
    "P18_slot_index", "event_id:i, slot:i",
    lambda v: v.pings.select("event_id", times.slot_index(c("source_timestamp")).alias("slot")),
    f"SELECT event_id, hour({_LOCAL}) * 12 + minute({_LOCAL}) // 5 AS slot FROM pings", "pings",
)
R.add(
    "P19_fallback_slots", "event_id:i, rank:i, offset_minutes:i, day_type:s, slot_index:i, local_date:d",
    lambda v: v.pings.select("event_id", F.explode(times.fallback_slots(c("source_timestamp"))).alias("s")).select("event_id", "s.*"),
    f"""SELECT event_id, rank, offset_minutes, {_DAY.format('w')} AS day_type, hour(w) * 12 + minute(w) // 5 AS slot_index, CAST(w AS DATE) AS local_date
 FROM (SELECT event_id, o.rank, o.offset_minutes, {_LOCAL} + to_minutes(o.offset_minutes) AS w FROM pings,
 (VALUES (1,0),(2,-5),(3,5),(4,-10),(5,10),(6,-15),(7,15),(8,-20),(9,20),(10,-25),(11,25),(12,-30),(13,30)) AS o(rank, offset_minutes)) x""",
    "pings",
)
R.add(
    "P20_metric_key", "event_id:i, physical:s, service:s",
    lambda v: v.completions.select(
        "event_id",
        identity.metric_key(F.lit("physical"), c("origin_stop_id"), c("destination_stop_id"), F.lit(None), F.lit(None)).alias("physical"),
        identity.metric_key(F.lit("service"), c("origin_stop_id"), c("destination_stop_id"), F.concat(F.lit("R"), c("k").cast("string")), c("k") % 2).alias("service"),
    ),
    """SELECT event_id,
 sha256(concat('{"destination_stop_id":"', destination_stop_id, '","direction_id":null,"origin_stop_id":"', origin_stop_id, '","route_id":null,"scope":"physical"}')) AS physical,
 sha256(concat('{"destination_stop_id":"', destination_stop_id, '","direction_id":', CAST(k % 2 AS VARCHAR), ',"origin_stop_id":"', origin_stop_id, '","route_id":"R', CAST(k AS VARCHAR), '","scope":"service"}')) AS service
 FROM completions""",
    "completions",
)
R.add(
    "P21_metric_identities", "event_id:i, scope:s, route_id:s, direction_id:i, metric_key:s",
    lambda v: metric_identities(
        v.completions.drop("metric_key").withColumn("route_id", F.when(c("k") % 4 > 0, F.concat(F.lit("R"), c("k").cast("string")))).withColumn("direction_id", c("k") % 2)
    ),
    """WITH base AS (SELECT event_id, origin_stop_id o, destination_stop_id d, CASE WHEN k % 4 > 0 THEN concat('R', CAST(k AS VARCHAR)) END AS r, k % 2 AS dir FROM completions)
SELECT event_id, 'physical' AS scope, CAST(NULL AS VARCHAR) AS route_id, CAST(NULL AS INTEGER) AS direction_id,
 sha256(concat('{"destination_stop_id":"', d, '","direction_id":null,"origin_stop_id":"', o, '","route_id":null,"scope":"physical"}')) AS metric_key FROM base WHERE o <> d
UNION ALL SELECT event_id, 'service', r, dir,
 sha256(concat('{"destination_stop_id":"', d, '","direction_id":', CAST(dir AS VARCHAR), ',"origin_stop_id":"', o, '","route_id":"', r, '","scope":"service"}')) FROM base WHERE r IS NOT NULL AND o <> d""",
    "completions",
)
R.add(
    "P22_projection_quality", "vehicle_prefix:s, quality:s",
    lambda v: v.states.select("vehicle_prefix", status.projection_quality(c("distance_to_shape_m")).alias("quality")),
    "SELECT vehicle_prefix, CASE WHEN distance_to_shape_m <= 30 THEN 'valid' WHEN distance_to_shape_m <= 50 THEN 'reduced' ELSE 'fallback_required' END AS quality FROM states",
    "states",
)
R.add(
    "P23_nearest_departure", "event_id:i, departure_at:t",
    lambda v: v.pings.select("event_id", times.nearest_departure(F.concat_ws(":", F.lpad((c("k") % 24).cast("string"), 2, "0"), F.lit("30")), c("source_timestamp")).alias("departure_at")),
    f"""WITH cand AS (SELECT event_id, {_LOCAL} AS here, CAST(CAST({_LOCAL} AS DATE) AS TIMESTAMP) + to_days(d) + to_hours(k % 24) + INTERVAL 30 MINUTE AS w, d
 FROM pings, (VALUES (-1), (0), (1)) AS o(d)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(w) - epoch_us(here)), d) AS rn FROM cand)
SELECT event_id, w + INTERVAL 3 HOUR AS departure_at FROM r WHERE rn = 1""",
    "pings",
)
R.add(
    "P24_planned_trip_end", "trip_id:i, stop_sequence:i, ends_at:t, negative:t",
    lambda v: v.stop_times.select("trip_id", "stop_sequence", times.planned_trip_end(c("arrival_seconds") + 40000, at_lit(AT)).alias("ends_at"), times.planned_trip_end(-c("arrival_seconds"), at_lit(AT)).alias("negative")),
    f"SELECT trip_id, stop_sequence, CAST(CAST({T} - INTERVAL 3 HOUR AS DATE) AS TIMESTAMP) + to_seconds(arrival_seconds + 40000) + INTERVAL 3 HOUR AS ends_at, CAST(NULL AS TIMESTAMP) AS negative FROM stop_times",
    "stop_times",
)
_W = "(k % 13) * 0.5"
R.add(
    "P25_reliability", "event_id:i, reliability:f",
    lambda v: v.completions.select("event_id", status.reliability((c("k") % 13) * 0.5, c("k") % 13, c("k") % 13 + c("k") % 5 + 1).alias("reliability")),
    f"SELECT event_id, least(1.0, {_W} / 5.0) * (k % 13) / (k % 13 + k % 5 + 1) AS reliability FROM completions", "completions",
)
R.add(
    "P26_metric_status", "event_id:i, status:s",
    lambda v: v.completions.select("event_id", status.metric_status((c("k") % 13) * 0.5, c("k") % 13, c("k") % 13 + c("k") % 5 + 1).alias("status")),
    f"""SELECT event_id, CASE WHEN n >= 3 AND (n - a) / n >= 0.5 THEN 'anomalous' WHEN a = 0 THEN 'insufficient'
 WHEN r < 0.4 THEN 'low' WHEN r < 0.8 THEN 'medium' ELSE 'high' END AS status
 FROM (SELECT event_id, k % 13 AS a, k % 13 + k % 5 + 1 AS n, least(1.0, {_W} / 5.0) * (k % 13) / (k % 13 + k % 5 + 1) AS r FROM completions) x""",
    "completions",
)
R.add(
    "P27_delay_seconds", "vehicle_prefix:s, delay:i",
    lambda v: v.commitments.select("vehicle_prefix", status.delay_seconds(c("arrival_at"), c("departure_at")).alias("delay")),
    "SELECT vehicle_prefix, greatest(0, arrival_s - departure_s) AS delay FROM commitments", "commitments",
)
R.add(
    "P28_delay_status", "vehicle_prefix:s, status:s",
    lambda v: v.snapshots.select("vehicle_prefix", status.delay_status(c("estimated_at"), F.lit(None).cast("timestamp"), c("planned_trip_end_at")).alias("status")),
    """SELECT vehicle_prefix, CASE WHEN planned_trip_end_at IS NULL THEN 'no_reference'
 WHEN epoch(estimated_at) - epoch(planned_trip_end_at) > 600 THEN 'delayed'
 WHEN epoch(estimated_at) - epoch(planned_trip_end_at) > 0 THEN 'warning' ELSE 'on_time' END AS status FROM snapshots""",
    "snapshots",
)
R.add(
    "P29_vehicle_alerts", "vehicle_prefix:s, stale:b, low_speed:b",
    lambda v: v.states.select("vehicle_prefix", status.vehicle_alerts(c("source_timestamp"), c("speed_kmh"), c("low_speed_since"), at_lit(AT)).alias("a")).select("vehicle_prefix", "a.*"),
    f"""SELECT vehicle_prefix, source_age_s > 300 AS stale,
 coalesce(speed_kmh < 1 AND epoch({T}) - epoch(low_speed_since) > 300, false) AS low_speed FROM states""",
    "states",
)
PROJECTED_SQL = "map_match_status = 'resolved' AND projection_quality IN ('valid', 'reduced')"
CLASS_SQL = f"""CASE WHEN {PROJECTED_SQL} THEN 'projected' WHEN coalesce(trim(current_planned_time), '') = '' THEN 'missing_planned_time'
 WHEN map_match_status = 'ambiguous' THEN 'ambiguous' WHEN correlation_reason IN ('no_exact_match', 'ambiguous_exact_match') THEN 'no_exact_match'
 WHEN map_match_status = 'collecting' THEN 'collecting' ELSE 'other' END"""
R.add(
    "P30_operational_class", "vehicle_prefix:s, class:s",
    lambda v: v.states.select("vehicle_prefix", status.operational_class().alias("class")),
    f"SELECT vehicle_prefix, {CLASS_SQL} AS class FROM states", "states",
)
R.add(
    "P31_average_speed", "event_id:i, kmh:f",
    lambda v: v.completions.select("event_id", status.average_speed(c("distance_m"), c("duration_seconds")).alias("kmh")),
    "SELECT event_id, distance_m / duration_seconds * 3.6 AS kmh FROM completions", "completions",
)
R.add(
    "P32_execution_key", "terminal_id:s, execution_key:s",
    lambda v: v.commitments.groupBy("terminal_id").agg(
        F.sort_array(F.collect_list(F.struct("departure_at", c("vehicle_prefix").alias("commitment"), c("vehicle_prefix").alias("assigned")))).alias("steps")
    ).select("terminal_id", identity.execution_key(c("terminal_id"), c("steps")).alias("execution_key")),
    """SELECT terminal_id, sha256(concat(terminal_id, '|', string_agg(concat(vehicle_prefix, '>', vehicle_prefix, '@', strftime(departure_at, '%Y-%m-%dT%H:%M:%S+00:00')), '|' ORDER BY departure_at, vehicle_prefix))) AS execution_key
 FROM commitments GROUP BY terminal_id""",
    "commitments",
)
R.add(
    "P33_effective_decision", "event_id:i, effective:s",
    lambda v: v.decision_events.select("event_id", status.effective_decision(F.when(c("event_id") % 5 > 0, c("status")), c("occurred_at"), at_lit("2024-01-15 00:00:00")).alias("effective")),
    """SELECT event_id, CASE WHEN s IN ('executed', 'rejected') THEN s WHEN occurred_at <= TIMESTAMP '2024-01-15' THEN 'expired' ELSE coalesce(s, 'new') END AS effective
 FROM (SELECT *, CASE WHEN event_id % 5 > 0 THEN status END AS s FROM decision_events) x""",
    "decision_events",
)


def _payload(at, reliability, complete):
    end = F.struct(
        complete.alias("complete"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("estimated_at"),
        reliability.alias("reliability"), F.create_map(F.lit("live"), F.lit(2)).alias("source_counts"),
    )
    service = F.struct(F.struct(end.alias("trip_end")).alias("service"))
    return F.to_json(F.struct(service.alias("future_time")))


R.add(
    "P34_eta_payload_fields", "vehicle_prefix:s, arrival_at:t, reliability:f, live:i",
    lambda v: v.commitments.select("vehicle_prefix", eta_payload_fields(_payload(c("arrival_at"), c("eta_reliability"), c("arrival_s") % 120 == 0)).alias("e")).filter("e IS NOT NULL").select(
        "vehicle_prefix", "e.arrival_at", c("e.eta_reliability").alias("reliability"), c("e.eta_source_counts")["live"].alias("live")),
    "SELECT vehicle_prefix, arrival_at, eta_reliability AS reliability, 2 AS live FROM commitments WHERE arrival_s % 120 = 0", "commitments",
)
R.add(
    "P35_date_format_class", "o_orderkey:i, class:s",
    lambda v: v.deliveries.select("o_orderkey", text.date_format_class(c("data_coleta")).alias("class")),
    """SELECT o_orderkey, CASE WHEN regexp_full_match(trim(data_coleta), '\\d{4}-\\d{2}-\\d{2}') THEN 'iso'
 WHEN regexp_full_match(trim(data_coleta), '\\d{2}/\\d{2}/\\d{4}') THEN 'dd/mm/yyyy' WHEN trim(data_coleta) <> '' THEN 'other' END AS class FROM deliveries""",
    "deliveries",
)
R.add(
    "P36_fresh", "vehicle_prefix:s, age:i",
    lambda v: v.states.filter(times.fresh(c("source_timestamp"), at_lit(AT), status.SIGNAL_SECONDS)).select("vehicle_prefix", c("source_age_s").alias("age")),
    "SELECT vehicle_prefix, source_age_s AS age FROM states WHERE source_age_s <= 60", "states",
)
R.add(
    "P37_contains_filter", "o_orderkey:i, filial:s, segmento:s",
    lambda v: text.contains_filter(v.deliveries, {"filial": "nation_1", "segmento": " House ", "motivo": ""}).select("o_orderkey", "filial", "segmento"),
    "SELECT o_orderkey, filial, segmento FROM deliveries WHERE contains(lower(coalesce(filial, '')), 'nation_1') AND contains(lower(segmento), 'house')", "deliveries",
)
R.add(
    "P38_eligible_for_eta", "vehicle_prefix:s, reason:s",
    lambda v: eligible_for_eta(v.states.withColumn("trip_id", F.when(c("map_match_status") == "resolved", c("trip_id"))), AT).select("vehicle_prefix", c("eta_reason").alias("reason")),
    "SELECT vehicle_prefix, CASE WHEN map_match_status <> 'resolved' THEN 'unresolved' WHEN source_age_s > 300 THEN 'stale' END AS reason FROM states", "states",
)


def _feed_rows(v):
    """Pings as parsed feed records with a source map."""
    fields = {
        "Prefixo": c("vehicle_prefix"), "DataHora": F.date_format("source_timestamp", "dd/MM/yyyy HH:mm:ss"),
        "GPS_Latitude": F.replace(F.round("latitude", 5).cast("string"), F.lit("."), F.lit(",")),
        "GPS_Longitude": F.when(c("k") != 3, F.round("longitude", 5).cast("string")),
        "Velocidade": (c("k") - 3).cast("string"),
        "Linha_atual": F.concat(F.lit("0."), c("line")), "GTFS_Sentido_atual": c("direction_id").cast("string"),
    }
    entries = [x for name, value in fields.items() for x in (F.lit(name), value)]
    return v.pings.select("event_id", "vehicle_prefix", "received_at", F.create_map(*entries).alias("source_data"))


R.add(
    "P39_state_columns", "event_id:i, source_timestamp:t, latitude:f, longitude:f, location_valid:b, speed_kmh:f, low_speed_since:t, normalized_current_line:s, current_direction:s, map_match_status:s, position_sample_count:i",
    lambda v: state_columns(_feed_rows(v)),
    """SELECT event_id, moment AS source_timestamp, CASE WHEN k <> 3 THEN round(latitude, 5) END AS latitude, CASE WHEN k <> 3 THEN round(longitude, 5) END AS longitude,
 k <> 3 AS location_valid, CASE WHEN k >= 3 THEN k - 3 END AS speed_kmh, CASE WHEN k = 3 THEN moment END AS low_speed_since,
 concat('0', line) AS normalized_current_line, CAST(direction_id AS VARCHAR) AS current_direction, 'collecting' AS map_match_status, 1 AS position_sample_count
 FROM (SELECT *, date_trunc('second', source_timestamp) + INTERVAL 3 HOUR AS moment FROM pings) x""",
    "pings",
)
R.add(
    "P40_speed_band", "vehicle_prefix:s, band:s",
    lambda v: v.states.select("vehicle_prefix", status.speed_band(c("speed_kmh"), F.when(c("map_match_status") == "ambiguous", "gtfs_planned").otherwise("live")).alias("band")),
    """SELECT vehicle_prefix, CASE WHEN map_match_status = 'ambiguous' THEN 'planned' WHEN speed_kmh <= 10 THEN 'up_to_10' WHEN speed_kmh <= 20 THEN 'up_to_20'
 WHEN speed_kmh <= 30 THEN 'up_to_30' ELSE 'over_30' END AS band FROM states""",
    "states",
)


def fleet_view(v):
    roster = fleet.select_roster_trip(v.roster, AT)
    positions = v.states.join(v.routes.select("feed_id", "route_id", c("short_name").alias("route_short_name")), ["feed_id", "route_id"]).withColumn(
        "current_destination_stop_name", F.lit(None).cast("string"))
    return fleet.fleet_rows(positions, v.snapshots, roster, AT)


ROSTER_SQL = f"""picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_prefix ORDER BY in_progress DESC, coalesce(actual_start_at, planned_start_at) DESC, trip_number DESC) AS rn
 FROM (SELECT *, actual_start_at IS NOT NULL AND actual_end_at IS NULL AS in_progress FROM roster) a
 WHERE in_progress OR (planned_start_at - INTERVAL 10 MINUTE <= {T} AND {T} <= planned_end_at + INTERVAL 30 MINUTE)) b WHERE rn = 1)"""
FLEET_SQL = f"""{ROSTER_SQL},
fleet0 AS (SELECT s.*, r.short_name AS route_short_name, e.estimated_at, e.planned_trip_end_at, p.line AS roster_line, p.destination_name AS roster_destination,
 p.planned_start_at, p.actual_start_at, coalesce(p.planned_end_at, e.planned_trip_end_at) AS planned_at
 FROM states s JOIN routes r ON s.route_id = r.route_id LEFT JOIN snapshots e ON s.vehicle_prefix = e.vehicle_prefix AND s.trip_id = e.trip_id
 LEFT JOIN picked p ON s.vehicle_prefix = p.vehicle_prefix),
fleet1 AS (SELECT *, CAST(epoch(estimated_at) - epoch(planned_at) AS BIGINT) AS arrival_delay_seconds, CAST(epoch(actual_start_at) - epoch(planned_start_at) AS BIGINT) AS departure_delay_seconds,
 coalesce(roster_line, route_short_name, current_line) AS shown_line, coalesce(roster_destination, headsign) AS shown_destination,
 source_age_s > 300 AS stale, coalesce(speed_kmh < 1 AND epoch({T}) - epoch(low_speed_since) > 300, false) AS low_speed FROM fleet0),
fleet AS (SELECT *, CASE WHEN arrival_delay_seconds IS NULL THEN 'no_reference' WHEN arrival_delay_seconds > 600 THEN 'delayed' WHEN arrival_delay_seconds > 0 THEN 'warning' ELSE 'on_time' END AS delay_status FROM fleet1)"""
FLEET_VIEWS = "states routes snapshots roster"
R.add(
    "P41_facet_filter", "vehicle_prefix:s, line:s, status:s",
    lambda v: fleet.facet_filter(fleet_view(v), line="L3", status="delayed").select("vehicle_prefix", c("shown_line").alias("line"), c("delay_status").alias("status")),
    f"WITH {FLEET_SQL} SELECT vehicle_prefix, shown_line AS line, delay_status AS status FROM fleet WHERE shown_line = 'L3' AND delay_status = 'delayed'", FLEET_VIEWS,
)
R.add(
    "P41_facet_values", "value:s",
    lambda v: fleet.facet_values(fleet_view(v), "shown_line"),
    f"WITH {FLEET_SQL} SELECT DISTINCT shown_line AS value FROM fleet WHERE shown_line <> ''", FLEET_VIEWS,
)
