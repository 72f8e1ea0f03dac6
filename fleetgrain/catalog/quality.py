"""Registered data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.catalog.metrics import LIVE
from fleetgrain.catalog.shapes import SEG_SQL
from fleetgrain.operators import metrics, quality
from fleetgrain.operators.shapes import shape_segments

R = Registry()
c = F.col
COLUMNS = ("id_viagem", "filial", "segmento", "motivo", "data_coleta", "valor_frete", "atraso_min", "entregue_no_prazo", "origem_registo", "rota_km", "temperatura", "peso_kg", "volume_m3", "combustivel", "pedagio")
BLANK = "coalesce(trim(CAST({0} AS VARCHAR)), '') = ''"


def rows(v):
    """The delivery table as read: text columns only, the row key left out."""
    return v.deliveries.select(*COLUMNS)


def num(column: str) -> str:
    return f"TRY_CAST(replace(trim({column}), ',', '.') AS DOUBLE)"


def canon(column: str) -> str:
    return f"lower(strip_accents(regexp_replace(trim(coalesce({column}, '')), '\\s+', ' ', 'g')))"


def day(column: str) -> str:
    x = f"trim({column})"
    return f"coalesce(try_strptime({x}, '%Y-%m-%d %H:%M'), try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%d/%m/%Y %H:%M'), try_strptime({x}, '%d/%m/%Y'))"


UNPIVOT = " UNION ALL ".join(f"SELECT '{x}' AS column_name, {BLANK.format(x)} AS blank, {canon('filial')} AS g0, trim(filial) AS g FROM deliveries" for x in COLUMNS)
R.add(
    "Q01_missing_by_column", "column_name:s, blank:i, blank_pct:f", lambda v: quality.missing_by_column(rows(v)),
    f"SELECT column_name, count(*) FILTER (blank) AS blank, round(100.0 * count(*) FILTER (blank) / count(*), 3) AS blank_pct FROM ({UNPIVOT}) u GROUP BY column_name", "deliveries",
)
R.add(
    "Q02_overall_blank_pct", "overall_blank_pct:f", lambda v: quality.overall_blank_pct(rows(v)),
    f"SELECT round(100.0 * count(*) FILTER (blank) / count(*), 3) AS overall_blank_pct FROM ({UNPIVOT}) u", "deliveries",
)
R.add(
    "Q03_missing_by_group", "group_value:s, rows:i, blank_pct_all:f, column_name:s, blank_pct:f, place:i", lambda v: quality.missing_by_group(rows(v), "filial"),
    f"""WITH u AS ({UNPIVOT}), p AS (SELECT g, column_name, count(*) AS n, count(*) FILTER (blank) AS b FROM u WHERE g <> '' GROUP BY 1, 2),
t AS (SELECT *, round(100.0 * b / n, 2) AS pct, round(100.0 * sum(b) OVER (PARTITION BY g) / (n * {len(COLUMNS)}), 3) AS all_pct FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pct DESC, column_name) AS place FROM t)
SELECT g AS group_value, n AS rows, all_pct AS blank_pct_all, column_name, pct AS blank_pct, place FROM r WHERE place <= 6""",
    "deliveries",
)
R.add(
    "Q04_exact_duplicate_rows", "duplicate_rows:i", lambda v: quality.exact_duplicate_rows(rows(v).select("filial", "segmento", "motivo", "atraso_min", "entregue_no_prazo", "origem_registo")),
    "SELECT (SELECT count(*) FROM deliveries) - count(*) AS duplicate_rows FROM (SELECT DISTINCT filial, segmento, motivo, atraso_min, entregue_no_prazo, origem_registo FROM deliveries) d", "deliveries",
)
R.add(
    "Q05_duplicate_ids", "groups:i, excess:i", lambda v: quality.duplicate_ids(rows(v), "id_viagem"),
    "SELECT count(*) AS groups, coalesce(sum(n - 1), 0) AS excess FROM (SELECT trim(id_viagem), count(*) AS n FROM deliveries WHERE trim(id_viagem) <> '' GROUP BY 1 HAVING count(*) > 1) d", "deliveries",
)
R.add(
    "Q06_normalized_duplicates", "duplicate_rows:i", lambda v: quality.normalized_duplicates(rows(v).select("filial", "segmento", "motivo", "atraso_min")),
    f"SELECT (SELECT count(*) FROM deliveries) - count(*) AS duplicate_rows FROM (SELECT DISTINCT {canon('filial')}, {canon('segmento')}, {canon('motivo')}, {canon('atraso_min')} FROM deliveries) d", "deliveries",
)
R.add(
    "Q07_near_duplicates", "groups:i, excess:i", lambda v: quality.near_duplicates(rows(v), ["data_coleta", "filial", "segmento"]),
    f"SELECT count(*) AS groups, coalesce(sum(n - 1), 0) AS excess FROM (SELECT count(*) AS n FROM deliveries GROUP BY {canon('data_coleta')}, {canon('filial')}, {canon('segmento')} HAVING count(*) > 1) d", "deliveries",
)
SPELLINGS = " UNION ALL ".join(f"SELECT '{x}' AS column_name, {canon(x)} AS canonical, {x} AS spelling FROM deliveries WHERE trim({x}) <> ''" for x in ("filial", "segmento", "motivo"))
R.add(
    "Q08_category_variants", "column_name:s, canonical:s, spelling:s, n:i",
    lambda v: quality.category_variants(rows(v), ["filial", "segmento", "motivo"]).select("column_name", "canonical", F.explode("spellings").alias("spelling", "n")),
    f"WITH s AS ({SPELLINGS}), g AS (SELECT column_name, canonical, spelling, count(*) AS n FROM s GROUP BY 1, 2, 3) SELECT column_name, canonical, spelling, n FROM (SELECT *, count(*) OVER (PARTITION BY column_name, canonical) AS k FROM g) x WHERE k > 1",
    "deliveries",
)
R.add(
    "Q09_noncanonical_records", "column_name:s, noncanonical:i", lambda v: quality.noncanonical_records(rows(v), ["filial", "segmento", "motivo"]),
    f"WITH s AS ({SPELLINGS}), g AS (SELECT column_name, canonical, spelling, count(*) AS n FROM s GROUP BY 1, 2, 3), h AS (SELECT column_name, canonical, sum(n) - max(n) AS d FROM g GROUP BY 1, 2) SELECT column_name, sum(d) AS noncanonical FROM h GROUP BY 1",
    "deliveries",
)
R.add(
    "Q10_date_formats", "date_format:s, rows:i", lambda v: quality.date_formats(rows(v), "data_coleta"),
    """SELECT CASE WHEN regexp_full_match(trim(data_coleta), '\\d{4}-\\d{2}-\\d{2}') THEN 'iso' WHEN regexp_full_match(trim(data_coleta), '\\d{2}/\\d{2}/\\d{4}') THEN 'dd/mm/yyyy' ELSE 'other' END AS date_format, count(*) AS rows
 FROM deliveries WHERE trim(data_coleta) <> '' GROUP BY 1""",
    "deliveries",
)
NUMERIC = ["rota_km", "peso_kg", "valor_frete"]
INVALID = [f"SELECT '{x}:not_numeric' AS check_name, count(*) FILTER (trim({x}) <> '' AND {num(x)} IS NULL) AS rows FROM deliveries UNION ALL SELECT '{x}:negative', count(*) FILTER ({num(x)} < 0) FROM deliveries" for x in NUMERIC]
INVALID += ["SELECT 'entregue_no_prazo:outside_0_1', count(*) FILTER (trim(entregue_no_prazo) NOT IN ('0', '1')) FROM deliveries", f"SELECT 'data_coleta:invalid_date', count(*) FILTER (trim(data_coleta) <> '' AND {day('data_coleta')} IS NULL) FROM deliveries"]
R.add(
    "Q11_invalid_values", "check_name:s, rows:i", lambda v: quality.invalid_values(rows(v), NUMERIC, ["entregue_no_prazo"], ["data_coleta"]),
    " UNION ALL ".join(INVALID), "deliveries",
)
PLANNED, ACTUAL = ("saida_prevista", "chegada_prevista"), ("saida_real", "chegada_real")
R.add(
    "Q12_temporal_violations", "check_name:s, rows:i",
    lambda v: quality.temporal_violations(v.shipments, [("chegada_prevista", "saida_prevista"), ACTUAL], ("data_coleta", "saida_real")),
    f"""SELECT 'saida_prevista_before_chegada_prevista' AS check_name, count(*) FILTER ({day('saida_prevista')} < {day('chegada_prevista')}) AS rows FROM shipments
UNION ALL SELECT 'chegada_real_before_saida_real', count(*) FILTER ({day('chegada_real')} < {day('saida_real')}) FROM shipments
UNION ALL SELECT 'saida_real_before_data_coleta', count(*) FILTER (CAST({day('saida_real')} AS DATE) < CAST({day('data_coleta')} AS DATE)) FROM shipments""",
    "shipments",
)
R.add(
    "Q13_flag_mismatch", "mismatches:i", lambda v: quality.flag_mismatch(rows(v), "atraso_min", "entregue_no_prazo"),
    f"SELECT count(*) FILTER (({num('atraso_min')} <= 0) <> ({num('entregue_no_prazo')} = 1)) AS mismatches FROM deliveries", "deliveries",
)
R.add(
    "Q14_derived_delay_mismatch", "mismatches:i", lambda v: quality.derived_delay_mismatch(v.shipments, "atraso_min", "chegada_prevista", "chegada_real"),
    f"SELECT count(*) FILTER (abs(round((epoch({day('chegada_real')}) - epoch({day('chegada_prevista')})) / 60.0) - {num('atraso_min')}) > 1) AS mismatches FROM shipments", "shipments",
)
HOURS = f"(epoch({day('saida_real')}) - epoch({day('data_coleta')})) / 3600.0"
R.add(
    "Q15_lag_distribution", "median_hours:f, p95_hours:f, n:i, negative:i", lambda v: quality.lag_distribution(v.shipments, "data_coleta", "saida_real"),
    f"SELECT round(median(h), 2) AS median_hours, round(quantile_disc(h, 0.95), 2) AS p95_hours, count(h) AS n, count(*) FILTER (h < 0) AS negative FROM (SELECT {HOURS} AS h FROM shipments) x", "shipments",
)
R.add(
    "Q16_group_median_outliers", "outliers:i", lambda v: quality.group_median_outliers(rows(v), ["filial", "segmento"], "rota_km"),
    f"""WITH x AS (SELECT {canon('filial')} AS a, {canon('segmento')} AS b, {num('rota_km')} AS x FROM deliveries), m AS (SELECT a, b, median(x) AS m FROM x WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT count(*) FILTER (m > 0 AND (x < m / 4 OR x > m * 4)) AS outliers FROM x JOIN m USING (a, b)""",
    "deliveries",
)
R.add(
    "Q17_implausible", "check_name:s, rows:i",
    lambda v: quality.implausible(rows(v), quality.transport_bounds("rota_km", "peso_kg", "volume_m3", "valor_frete", "combustivel", "pedagio", "temperatura")),
    f"""SELECT 'rota_km_extreme' AS check_name, count(*) FILTER ({num('rota_km')} = 0 OR {num('rota_km')} > 5000) AS rows FROM deliveries
UNION ALL SELECT 'peso_kg_over_80t', count(*) FILTER ({num('peso_kg')} > 80000) FROM deliveries UNION ALL SELECT 'volume_m3_over_200m3', count(*) FILTER ({num('volume_m3')} > 200) FROM deliveries
UNION ALL SELECT 'combustivel_very_high', count(*) FILTER ({num('rota_km')} <> 0 AND {num('combustivel')} > greatest(20000, {num('rota_km')} * 10)) FROM deliveries
UNION ALL SELECT 'valor_frete_over_100k', count(*) FILTER ({num('valor_frete')} > 100000) FROM deliveries UNION ALL SELECT 'pedagio_over_10k', count(*) FILTER ({num('pedagio')} > 10000) FROM deliveries
UNION ALL SELECT 'temperatura_outside_-40_60', count(*) FILTER ({num('temperatura')} < -40 OR {num('temperatura')} > 60) FROM deliveries""",
    "deliveries",
)
ALL_BLANK = " + ".join(f"CAST({BLANK.format(x)} AS INTEGER)" for x in COLUMNS)
R.add(
    "Q18_quality_by_source", "source_name:s, rows:i, share_pct:f, blank_pct_all:f, iso_date_pct:f", lambda v: quality.quality_by_source(rows(v), "origem_registo", "data_coleta"),
    f"""SELECT coalesce(nullif(trim(origem_registo), ''), '<vazio>') AS source_name, count(*) AS rows, round(100.0 * count(*) / (SELECT count(*) FROM deliveries), 2) AS share_pct,
 round(100.0 * sum({ALL_BLANK}) / (count(*) * {len(COLUMNS)}), 3) AS blank_pct_all, round(100.0 * count(*) FILTER (regexp_full_match(trim(data_coleta), '\\d{{4}}-\\d{{2}}-\\d{{2}}')) / count(*), 2) AS iso_date_pct
 FROM deliveries GROUP BY 1""",
    "deliveries",
)
R.add(
    "Q19_conditional_completeness", "late_rows:i, reason_blank_when_late_pct:f, not_on_time_rows:i, reason_blank_when_not_on_time_pct:f",
    lambda v: quality.conditional_completeness(rows(v), "motivo", "atraso_min", "entregue_no_prazo"),
    f"""SELECT count(*) FILTER ({num('atraso_min')} > 0) AS late_rows, round(100.0 * count(*) FILTER ({num('atraso_min')} > 0 AND trim(motivo) = '') / count(*) FILTER ({num('atraso_min')} > 0), 2) AS reason_blank_when_late_pct,
 count(*) FILTER ({num('entregue_no_prazo')} = 0) AS not_on_time_rows, round(100.0 * count(*) FILTER ({num('entregue_no_prazo')} = 0 AND trim(motivo) = '') / count(*) FILTER ({num('entregue_no_prazo')} = 0), 2) AS reason_blank_when_not_on_time_pct FROM deliveries""",
    "deliveries",
)
R.add(
    "Q19_filled_by_segment", "segment:s, rows:i, filled_pct:f", lambda v: quality.filled_by_segment(rows(v), "segmento", "temperatura"),
    "SELECT trim(segmento) AS segment, count(*) AS rows, round(100.0 * count(*) FILTER (trim(temperatura) <> '') / count(*), 2) AS filled_pct FROM deliveries GROUP BY 1", "deliveries",
)
R.add(
    "Q20_threshold_sweep", "threshold:i, mismatches:i", lambda v: quality.threshold_sweep(rows(v), "atraso_min", "entregue_no_prazo"),
    f"SELECT t AS threshold, count(*) FILTER (({num('atraso_min')} <= t) <> ({num('entregue_no_prazo')} = 1)) AS mismatches FROM deliveries, (VALUES (0), (5), (10), (15), (30), (60)) AS x(t) GROUP BY t", "deliveries",
)
SUMMARY = ["rota_km", "peso_kg", "valor_frete", "atraso_min", "temperatura"]
R.add(
    "Q21_numeric_summary", "column_name:s, minimum:f, median:f, maximum:f, n:i", lambda v: quality.numeric_summary(rows(v), SUMMARY),
    " UNION ALL ".join(f"SELECT '{x}' AS column_name, min({num(x)}) AS minimum, median({num(x)}) AS median, max({num(x)}) AS maximum, count({num(x)}) AS n FROM deliveries" for x in SUMMARY), "deliveries",
)
R.add(
    "Q22_crosstab", "a:s, b:s, rows:i", lambda v: quality.crosstab(rows(v), "origem_registo", "filial"),
    "SELECT trim(origem_registo) AS a, trim(filial) AS b, count(*) AS rows FROM deliveries WHERE trim(filial) <> '' GROUP BY 1, 2", "deliveries",
)
R.add(
    "Q23_date_range", "date_min:d, date_max:d", lambda v: quality.date_range(rows(v), "data_coleta"),
    f"SELECT CAST(min({day('data_coleta')}) AS DATE) AS date_min, CAST(max({day('data_coleta')}) AS DATE) AS date_max FROM deliveries", "deliveries",
)
R.add(
    "Q24_check_expectations", "check_name:s, violations:i", lambda v: quality.check_expectations(v.states, quality.STATE_CHECKS),
    " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (NOT ({rule})) AS violations FROM states" for n, rule in quality.STATE_CHECKS.items()), "states",
)
R.add(
    "Q24_check_observations", "check_name:s, violations:i",
    lambda v: quality.check_expectations(
        v.assessed.withColumn("scope", F.when(c("k") % 2 == 0, "physical").otherwise("service")).withColumn("route_id", F.when(c("k") % 3 == 0, F.lit("R")))
        .withColumn("direction_id", F.when(c("k") % 3 == 0, 1)).withColumn("average_speed_kmh", c("distance_m") / c("duration_seconds")), quality.OBSERVATION_CHECKS),
    " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, count(*) FILTER (NOT ({rule})) AS violations FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'physical' ELSE 'service' END AS scope, CASE WHEN k % 3 = 0 THEN 'R' END AS route_id, CASE WHEN k % 3 = 0 THEN 1 END AS direction_id, distance_m / duration_seconds AS average_speed_kmh FROM assessed) a"
        for n, rule in quality.OBSERVATION_CHECKS.items()), "assessed",
)
R.add(
    "Q24_check_segments", "check_name:s, violations:i", lambda v: quality.check_expectations(shape_segments(v.shape_points), {**quality.SEGMENT_CHECKS, "fractions": "start_fraction >= 0 AND end_fraction > start_fraction"}),
    f"WITH {SEG_SQL} SELECT 'sequence' AS check_name, count(*) FILTER (NOT (segment_sequence >= 0)) AS violations FROM seg UNION ALL SELECT 'length', count(*) FILTER (NOT (len > 0)) FROM seg "
    "UNION ALL SELECT 'distances', count(*) FILTER (NOT (start_m >= 0 AND end_m > start_m)) FROM seg UNION ALL SELECT 'fractions', count(*) FILTER (NOT (f0 >= 0 AND f1 > f0)) FROM seg", "shape_points",
)
R.add(
    "Q24_check_live_metrics", "check_name:s, violations:i",
    lambda v: quality.check_expectations(
        metrics.live_metrics(v.assessed.withColumn("scope", F.lit("physical")).withColumn("route_id", F.lit(None).cast("string")).withColumn("direction_id", F.lit(None).cast("int"))), quality.METRIC_CHECKS),
    f"WITH {LIVE}, live AS (SELECT *, window_start + INTERVAL 5 MINUTE AS window_end, 'physical' AS scope, CAST(NULL AS VARCHAR) AS route_id, CAST(NULL AS INTEGER) AS direction_id FROM st) "
    + " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (NOT ({rule})) AS violations FROM live" for n, rule in quality.METRIC_CHECKS.items()), "assessed",
)
