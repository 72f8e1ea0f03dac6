"""Registered position, feed and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.catalog.views import AT
from fleetgrain.functions.times import clock_text
from fleetgrain.operators import positions
from fleetgrain.operators.correlation import exact_trip_match
from fleetgrain.operators.decisions import newest_per_key
from fleetgrain.operators.timetable import active_trips
from fleetgrain.sources import tables
from fleetgrain.sources.feeds import parse_envelopes, parse_roster, state_columns

R = Registry()
c = F.col
FIELDS = ("Prefixo", "DataHora", "GPS_Latitude", "GPS_Longitude", "Velocidade", "Linha_atual", "extra")


def envelopes(v):
    """Pings packed into hourly poll payloads, with malformed records among them."""
    values = F.array(
        F.when(c("k") != 13, c("vehicle_prefix")), F.date_format("source_timestamp", "dd/MM/yyyy HH:mm:ss"),
        F.round("latitude", 5).cast("string"), F.when(c("k") != 3, F.round("longitude", 5).cast("string")),
        (c("k") - 3).cast("string"), F.concat(F.lit("0."), c("line")), c("event_id").cast("string"),
    )
    record = (
        F.when(c("k") == 7, F.to_json(F.slice(values, 1, 4), {"ignoreNullFields": "false"}))
        .when(c("k") == 11, F.lit('"text"'))
        .otherwise(F.to_json(values, {"ignoreNullFields": "false"}))
    )
    hour = F.date_trunc("hour", "source_timestamp")
    return v.pings.groupBy(F.date_format(hour, "yyyy-MM-dd HH").alias("batch_id"), hour.alias("received_at")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", record.alias("r")))), lambda x: x["r"]).alias("dados")
    ).withColumn("campos", F.array(*[F.lit(f) for f in FIELDS]))


FEED_SQL = """feed AS (SELECT *, strftime(source_timestamp, '%Y-%m-%d %H') AS batch_id, row_number() OVER (PARTITION BY strftime(source_timestamp, '%Y-%m-%d %H') ORDER BY event_id) - 1 AS pos,
 CASE k WHEN 11 THEN 'not_a_list' WHEN 7 THEN 'wrong_length' WHEN 13 THEN 'no_prefix' END AS reject_reason FROM pings)"""
R.add(
    "S02_read_position_feed", "batch_id:s, pos:i, vehicle_prefix:s, reject_reason:s, latitude:s, speed:s, extra:s",
    lambda v: parse_envelopes(envelopes(v)).select(
        "*", c("source_data")["GPS_Latitude"].alias("latitude"), c("source_data")["Velocidade"].alias("speed"), c("source_data")["extra"].alias("extra")),
    f"""WITH {FEED_SQL} SELECT batch_id, pos, CASE WHEN reject_reason IS NULL THEN vehicle_prefix END AS vehicle_prefix, reject_reason,
 CASE WHEN k NOT IN (7, 11) THEN CAST(round(latitude, 5) AS VARCHAR) END AS latitude, CASE WHEN k NOT IN (7, 11) THEN CAST(k - 3 AS VARCHAR) END AS speed,
 CASE WHEN k NOT IN (7, 11) THEN CAST(event_id AS VARCHAR) END AS extra FROM feed""",
    "pings",
)


def parsed(v):
    return state_columns(parse_envelopes(envelopes(v)))


R.add(
    "A19_batch_counters", "batch_id:s, received:i, rejected:i, duplicate_prefixes:i, invalid_locations:i, invalid_timestamps:i",
    lambda v: positions.batch_counters(parsed(v)),
    f"""WITH {FEED_SQL} SELECT batch_id, count(*) AS received, count(reject_reason) AS rejected,
 count(*) FILTER (reject_reason IS NULL) - count(DISTINCT vehicle_prefix) FILTER (reject_reason IS NULL) AS duplicate_prefixes,
 count(*) FILTER (reject_reason IS NULL AND k = 3) AS invalid_locations, 0 AS invalid_timestamps FROM feed GROUP BY batch_id""",
    "pings",
)
R.add(
    "S10_run_audit", "batch_id:s, status:s, records_received:i, records_written:i, records_rejected:i",
    lambda v: tables.run_audit(positions.batch_counters(parsed(v)), AT),
    f"""WITH {FEED_SQL} SELECT batch_id, CASE WHEN count(reject_reason) > 0 THEN 'partial' ELSE 'succeeded' END AS status, count(*) AS records_received,
 count(DISTINCT vehicle_prefix) FILTER (reject_reason IS NULL) AS records_written, count(reject_reason) AS records_rejected FROM feed GROUP BY batch_id""",
    "pings",
)
R.add(
    "W03_last_record_wins", "batch_id:s, vehicle_prefix:s, pos:i, speed_kmh:f, duplicate_count:i",
    lambda v: positions.last_record_wins(parsed(v).filter("NOT rejected").select("batch_id", "vehicle_prefix", "pos", "speed_kmh"), ["batch_id"]),
    f"""WITH {FEED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, vehicle_prefix ORDER BY pos DESC) AS rn, count(*) OVER (PARTITION BY batch_id, vehicle_prefix) - 1 AS duplicate_count
 FROM feed WHERE reject_reason IS NULL) SELECT batch_id, vehicle_prefix, pos, CASE WHEN k >= 3 THEN k - 3 END AS speed_kmh, duplicate_count FROM r WHERE rn = 1""",
    "pings",
)


def roster_payloads(v):
    """Roster trips as JSON payloads per line, with entries to skip."""
    def text(name):
        return F.date_format(c(name) - F.expr("INTERVAL 3 HOURS"), "dd/MM/yyyy HH:mm:ss")

    trip = F.to_json(
        F.struct(
            F.when(c("trip_number") % 10 > 0, c("vehicle_prefix")).otherwise(F.lit(" ")).alias("veiculo"),
            text("planned_start_at").alias("inicioProgramado"), text("actual_start_at").alias("inicioRealizado"),
            text("planned_end_at").alias("fimProgramado"), text("actual_end_at").alias("fimRealizado"),
            c("line").alias("linha"), c("destination_name").alias("nomePontoFim"), c("trip_number").cast("string").alias("numeroViagem"),
        )
    )
    raw = F.when(c("trip_number") % 17 == 0, F.lit("7")).otherwise(trip)
    return v.roster.groupBy("vehicle_prefix").agg(F.collect_list(raw).alias("viagens"))


R.add(
    "S03_read_trip_roster", "vehicle_prefix:s, trip_number:s, line:s, destination_name:s, planned_start_at:t, actual_start_at:t, actual_end_at:t",
    lambda v: parse_roster(roster_payloads(v)),
    "SELECT vehicle_prefix, trip_number, line, destination_name, planned_start_at, actual_start_at, actual_end_at FROM roster WHERE trip_number % 10 > 0 AND trip_number % 17 > 0",
    "roster",
)

TRACK_KEYS = "event_id:i, vehicle_prefix:s"


def _accepted(v):
    arrived = v.tracks.withColumn("arrival_no", c("event_id") + (c("k") % 10) * 30)
    return positions.drop_out_of_order(arrived, ["arrival_no", "event_id"])


ACCEPTED_SQL = """acc AS (SELECT * FROM (SELECT *, source_timestamp AS event_at, max(source_timestamp) OVER (PARTITION BY vehicle_prefix ORDER BY event_id + (k % 10) * 30, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM tracks) a
 WHERE seen IS NULL OR event_at > seen)"""
R.add(
    "W05_drop_out_of_order", f"{TRACK_KEYS}, event_at:t", _accepted,
    f"WITH {ACCEPTED_SQL} SELECT event_id, vehicle_prefix, event_at FROM acc", "tracks",
)
SESSION_SQL = f"""{ACCEPTED_SQL}, lagged AS (SELECT *, lag(event_at) OVER w AS pe, lag(trip_id) OVER w AS pt FROM acc WINDOW w AS (PARTITION BY vehicle_prefix ORDER BY event_at)),
flagged AS (SELECT *, pe IS NULL OR pt <> trip_id OR epoch_us(event_at) - epoch_us(pe) > 300000000 AS reset FROM lagged),
sess AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_prefix ORDER BY event_at ROWS UNBOUNDED PRECEDING) AS session_id FROM flagged)"""
R.add(
    "W04_position_window", f"{TRACK_KEYS}, window_reset:b, position_sample_count:i, previous_1:t, previous_2:t",
    lambda v: positions.position_window(_accepted(v)).select(
        "*", c("previous_state_1.event_at").alias("previous_1"), c("previous_state_2.event_at").alias("previous_2")),
    f"""WITH {SESSION_SQL} SELECT event_id, vehicle_prefix, reset AS window_reset, least(3, row_number() OVER s) AS position_sample_count,
 lag(event_at, 1) OVER s AS previous_1, lag(event_at, 2) OVER s AS previous_2 FROM sess WINDOW s AS (PARTITION BY vehicle_prefix, session_id ORDER BY event_at)""",
    "tracks",
)
R.add(
    "W06_low_speed_since", f"{TRACK_KEYS}, low_speed_since:t",
    lambda v: positions.low_speed_since(positions.position_window(_accepted(v).withColumn("speed_kmh", c("speed_kmh") / 5))),
    f"""WITH {SESSION_SQL}, low AS (SELECT *, coalesce(speed_kmh / 5 < 1, false) AS is_low FROM sess),
isl AS (SELECT *, sum(CASE WHEN is_low THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_prefix, session_id ORDER BY event_at ROWS UNBOUNDED PRECEDING) AS island FROM low)
SELECT event_id, vehicle_prefix, CASE WHEN is_low THEN min(event_at) FILTER (is_low) OVER (PARTITION BY vehicle_prefix, session_id, island) END AS low_speed_since FROM isl""",
    "tracks",
)
R.add(
    "J08_sample_rows", "event_id:i, sample_index:i, sample_timestamp:t, latitude:f",
    lambda v: positions.sample_rows(positions.position_window(_accepted(v))),
    f"""WITH {SESSION_SQL}, w AS (SELECT *, lag(event_at, 1) OVER s AS e1, lag(latitude, 1) OVER s AS l1, lag(event_at, 2) OVER s AS e2, lag(latitude, 2) OVER s AS l2 FROM sess WINDOW s AS (PARTITION BY vehicle_prefix, session_id ORDER BY event_at))
SELECT event_id, 0 AS sample_index, event_at AS sample_timestamp, latitude FROM w UNION ALL SELECT event_id, 1, e1, l1 FROM w WHERE e1 IS NOT NULL UNION ALL SELECT event_id, 2, e2, l2 FROM w WHERE e2 IS NOT NULL""",
    "tracks",
)


def _matched(v):
    lines = v.states.withColumn("current_planned_time", F.when(c("trip_id") % 8 > 0, clock_text(18000 + (c("trip_id") * 13 % 900) * 60)))
    seen = lines.withColumn("current_direction", c("direction_id").cast("string"))
    return exact_trip_match(seen, active_trips(v.trips, v.routes, v.services, v.exceptions, "2024-01-04"))


DOW = "CASE isodow({0}) WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday WHEN 6 THEN saturday ELSE sunday END"


def active_sql(day: str) -> str:
    return f"""running AS (SELECT s.service_id FROM services s LEFT JOIN exceptions e ON e.service_id = s.service_id AND e.service_date = DATE '{day}'
 WHERE e.exception_type = 1 OR (e.exception_type IS NULL AND start_date <= DATE '{day}' AND end_date >= DATE '{day}' AND {DOW.format(f"DATE '{day}'")})),
active AS (SELECT t.*, replace(r.short_name, '.', '') AS line, CAST(t.direction_id AS VARCHAR) AS direction,
 concat(lpad(CAST(start_seconds // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST(start_seconds % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(start_seconds % 60 AS VARCHAR), 2, '0')) AS planned_time
 FROM trips t JOIN running USING (service_id) JOIN routes r ON r.route_id = t.route_id)"""


R.add(
    "J01_exact_trip_match", "vehicle_prefix:s, trip_id:i, route_id:s, correlation_status:s, correlation_reason:s, correlation_level:i, correlation_candidate_count:i", _matched,
    f"""WITH {active_sql('2024-01-04')}, pos AS (SELECT vehicle_prefix, replace(current_line, '.', '') AS line, CAST(direction_id AS VARCHAR) AS direction, CASE WHEN trip_id % 8 > 0 THEN
 concat(lpad(CAST((18000 + (trip_id * 13 % 900) * 60) // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST((18000 + (trip_id * 13 % 900) * 60) % 3600 // 60 AS VARCHAR), 2, '0'), ':00') END AS planned_time FROM states),
m AS (SELECT p.vehicle_prefix, p.planned_time, count(a.trip_id) AS n, min(a.trip_id) AS t, min(a.route_id) AS r FROM pos p LEFT JOIN active a ON a.line = p.line AND a.direction = p.direction AND a.planned_time = p.planned_time GROUP BY 1, 2)
SELECT vehicle_prefix, CASE WHEN n = 1 THEN t END AS trip_id, CASE WHEN n = 1 THEN r END AS route_id, CASE WHEN n = 1 THEN 'matched' ELSE 'fallback_required' END AS correlation_status,
 CASE WHEN planned_time IS NULL THEN 'missing_input' WHEN n = 0 THEN 'no_exact_match' WHEN n = 1 THEN 'unique_exact_match' ELSE 'ambiguous_exact_match' END AS correlation_reason,
 CASE WHEN n = 1 THEN 1 END AS correlation_level, n AS correlation_candidate_count FROM m""",
    "states trips routes services exceptions",
)
R.add(
    "S07_upsert", "vehicle_prefix:s, event_id:i, source_timestamp:t",
    lambda v: tables.upsert(
        *[newest_per_key(v.pings.filter(f"event_id % 2 = {half}").select("vehicle_prefix", "event_id", "source_timestamp"), ["vehicle_prefix"], [F.desc("source_timestamp")]) for half in (0, 1)],
        ["vehicle_prefix"], c("source_timestamp")),
    "SELECT vehicle_prefix, event_id, source_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_prefix ORDER BY source_timestamp DESC) AS rn FROM pings) x WHERE rn = 1",
    "pings",
)
R.add(
    "S08_expire", "event_id:i, completed_at:t",
    lambda v: tables.expire(v.completions, "completed_at", "2024-01-20 12:00:00", "1 HOUR"),
    "SELECT event_id, completed_at FROM completions WHERE completed_at > TIMESTAMP '2024-01-20 11:00:00'", "completions",
)
R.add(
    "S08_expire_dates", "event_id:i, day:d",
    lambda v: tables.expire_dates(v.completions.withColumn("day", F.to_date("completed_at")), "day", "2024-01-25"),
    "SELECT event_id, CAST(completed_at AS DATE) AS day FROM completions WHERE CAST(completed_at AS DATE) >= DATE '2024-01-18'", "completions",
)
R.add(
    "W02_latest_per_key", "vehicle_prefix:s, event_id:i",
    lambda v: newest_per_key(v.pings, ["vehicle_prefix"], [F.desc("source_timestamp"), F.desc("event_id")]),
    "SELECT vehicle_prefix, event_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_prefix ORDER BY source_timestamp DESC, event_id DESC) AS rn FROM pings) x WHERE rn = 1",
    "pings",
)
