"""Registered travel-time assessment and metric queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgrain.catalog.entries import Registry
from fleetgrain.functions.times import service_date
from fleetgrain.operators import metrics, samples

R = Registry()
c = F.col
DAY = date(2024, 1, 31)
LOCAL = "(completed_at - INTERVAL 3 HOUR)"
STATS = (
    "sample_count_total:i, sample_count_accepted:i, sample_count_rejected:i, accepted_weight:f, mean_seconds:f, median_seconds:f,"
    " standard_deviation_seconds:f, minimum_seconds:f, maximum_seconds:f, m2_seconds:f, reliability:f, status:s, last_completed_at:t"
)


def stats_sql(source: str, keys: str) -> str:
    """Two-pass statistics: the mean first, then squared deviations from it."""
    return f"""SELECT a.*, n - acc AS sample_count_rejected, n AS sample_count_total, acc AS sample_count_accepted,
 CASE WHEN accepted_weight > 0 THEN sqrt(m2_seconds / accepted_weight) END AS standard_deviation_seconds,
 least(1.0, accepted_weight / 5.0) * acc / n AS reliability,
 CASE WHEN n >= 3 AND (n - acc) / n >= 0.5 THEN 'anomalous' WHEN acc = 0 THEN 'insufficient'
  WHEN least(1.0, accepted_weight / 5.0) * acc / n < 0.4 THEN 'low' WHEN least(1.0, accepted_weight / 5.0) * acc / n < 0.8 THEN 'medium' ELSE 'high' END AS status
 FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (accepted) AS acc, coalesce(sum(weight) FILTER (accepted), 0.0) AS accepted_weight, max(mean_) AS mean_seconds,
  median(duration_seconds) FILTER (accepted) AS median_seconds, min(duration_seconds) FILTER (accepted) AS minimum_seconds,
  max(duration_seconds) FILTER (accepted) AS maximum_seconds, max(completed_at) AS last_completed_at,
  coalesce(sum(weight * (duration_seconds - mean_) * (duration_seconds - mean_)) FILTER (accepted), 0.0) AS m2_seconds
  FROM (SELECT *, sum(duration_seconds * weight) FILTER (accepted) OVER (PARTITION BY {keys}) / sum(weight) FILTER (accepted) OVER (PARTITION BY {keys}) AS mean_ FROM {source}) w
  GROUP BY {keys}) a"""


R.add(
    "A01_window_statistics", f"metric_key:s, day:d, {STATS}",
    lambda v: metrics.window_statistics(v.assessed.withColumn("day", service_date(c("completed_at"))), ["metric_key", "day"]),
    f"WITH src AS (SELECT *, CAST({LOCAL} AS DATE) AS day FROM assessed) {stats_sql('src', 'metric_key, day')}", "assessed",
)
LIVE = f"""src AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, completed_at) AS window_start FROM assessed),
newest AS (SELECT * FROM src QUALIFY window_start = max(window_start) OVER (PARTITION BY metric_key)),
st AS ({stats_sql('newest', 'metric_key, window_start, origin_stop_id, destination_stop_id')})"""
R.add(
    "A02_live_metrics", f"metric_key:s, window_start:t, window_end:t, origin_stop_id:s, destination_stop_id:s, {STATS}",
    lambda v: metrics.live_metrics(v.assessed),
    f"WITH {LIVE} SELECT *, window_start + INTERVAL 5 MINUTE AS window_end FROM st",
    "assessed",
)
DAILY = f"""daily AS ({stats_sql(f"(SELECT *, CAST({LOCAL} AS DATE) AS service_date, hour({LOCAL}) * 12 + minute({LOCAL}) // 5 AS slot_index, CASE isodow({LOCAL}) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS day_type FROM assessed) d", "metric_key, service_date, slot_index, day_type")})"""
R.add(
    "A03_daily_metrics", f"metric_key:s, service_date:d, slot_index:i, day_type:s, {STATS}",
    lambda v: metrics.daily_metrics(v.assessed), f"WITH {DAILY} SELECT * FROM daily", "assessed",
)


def _parts(v):
    d = metrics.daily_metrics(v.assessed)
    return d.select(
        "metric_key", "day_type", c("sample_count_accepted").alias("count"), c("accepted_weight").alias("weight_sum"),
        c("mean_seconds").alias("mean"), c("m2_seconds").alias("m2"), c("minimum_seconds").alias("minimum"), c("maximum_seconds").alias("maximum"),
    )


R.add(
    "A04_merge_moments", "metric_key:s, day_type:s, count:i, weight_sum:f, mean:f, m2:f, minimum:f, maximum:f, standard_deviation:f",
    lambda v: metrics.merge_moments(_parts(v), ["metric_key", "day_type"]),
    f"""WITH src AS (SELECT *, CASE isodow({LOCAL}) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS day_type FROM assessed),
st AS ({stats_sql('src', 'metric_key, day_type')})
SELECT metric_key, day_type, sample_count_accepted AS count, accepted_weight AS weight_sum, mean_seconds AS mean, m2_seconds AS m2,
 minimum_seconds AS minimum, maximum_seconds AS maximum, standard_deviation_seconds AS standard_deviation FROM st WHERE sample_count_accepted > 0""",
    "assessed",
)
PROFILE = f"""wm AS (SELECT *, sum(mean_seconds * accepted_weight) OVER (PARTITION BY metric_key, day_type, slot_index) / nullif(sum(accepted_weight) OVER (PARTITION BY metric_key, day_type, slot_index), 0) AS wmean
 FROM daily WHERE service_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'),
prof0 AS (SELECT metric_key, day_type, slot_index, sum(sample_count_total) AS sample_count_total, sum(sample_count_accepted) AS sample_count_accepted,
 sum(sample_count_rejected) AS sample_count_rejected, sum(accepted_weight) AS accepted_weight, max(wmean) AS mean_seconds,
 coalesce(sum(m2_seconds + accepted_weight * (mean_seconds - wmean) * (mean_seconds - wmean)) FILTER (mean_seconds IS NOT NULL), 0.0) AS m2_seconds,
 min(minimum_seconds) AS minimum_seconds, max(maximum_seconds) AS maximum_seconds, max(last_completed_at) AS last_completed_at FROM wm GROUP BY metric_key, day_type, slot_index),
profile AS (SELECT *, CASE WHEN accepted_weight > 0 THEN sqrt(m2_seconds / accepted_weight) END AS standard_deviation_seconds,
 least(1.0, accepted_weight / 5.0) * sample_count_accepted / sample_count_total AS reliability,
 DATE '2024-01-24' AS reference_start_date, DATE '2024-01-30' AS reference_end_date FROM prof0)"""
R.add(
    "A05_rolling_profile",
    "metric_key:s, day_type:s, slot_index:i, sample_count_total:i, sample_count_accepted:i, sample_count_rejected:i, accepted_weight:f, mean_seconds:f, m2_seconds:f, standard_deviation_seconds:f, minimum_seconds:f, maximum_seconds:f, reliability:f, last_completed_at:t, reference_start_date:d, reference_end_date:d",
    lambda v: metrics.rolling_profile(metrics.daily_metrics(v.assessed), DAY),
    f"WITH {DAILY}, {PROFILE} SELECT * FROM profile", "assessed",
)
R.add(
    "A20_assessment_counters", "metric_key:s, written:i, completed_high:i, completed_reduced:i, accepted:i, rejected_speed:i, rejected_mad:i, rejected_invalid:i",
    lambda v: samples.assessment_counters(v.assessed, ["metric_key"]),
    """SELECT metric_key, count(*) AS written, count(*) FILTER (confidence = 'high') AS completed_high, count(*) FILTER (confidence = 'reduced') AS completed_reduced,
 count(*) FILTER (accepted) AS accepted, count(*) FILTER (rejection_reason = 'speed_over_80') AS rejected_speed, 0 AS rejected_mad, 0 AS rejected_invalid
 FROM assessed GROUP BY metric_key""",
    "assessed",
)
R.add(
    "J09_unmaterialized_windows", "metric_key:s, completed_at:t",
    lambda v: metrics.unmaterialized_windows(v.assessed, metrics.daily_metrics(v.assessed.filter("k % 2 = 0")), "2024-01-20 12:00:00"),
    f"""WITH o AS (SELECT *, CAST({LOCAL} AS DATE) AS d, hour({LOCAL}) * 12 + minute({LOCAL}) // 5 AS s FROM assessed)
SELECT metric_key, max(completed_at) AS completed_at FROM o WHERE completed_at > TIMESTAMP '2024-01-20 11:00:00'
 AND NOT EXISTS (SELECT 1 FROM o x WHERE x.k % 2 = 0 AND x.metric_key = o.metric_key AND x.d = o.d AND x.s = o.s) GROUP BY metric_key""",
    "assessed",
)
R.add(
    "J12_metrics_for_keys", "metric_key:s, day_type:s, slot_index:i, mean_seconds:f, reliability:f",
    lambda v: metrics.metrics_for_keys(metrics.rolling_profile(metrics.daily_metrics(v.assessed), DAY), v.completions.filter("origin_stop_id = 'view'").select("metric_key"), day=DAY),
    f"""WITH {DAILY}, {PROFILE} SELECT * FROM profile WHERE sample_count_accepted > 0 AND mean_seconds IS NOT NULL
 AND metric_key IN (SELECT metric_key FROM completions WHERE origin_stop_id = 'view')""",
    "assessed",
)
R.add(
    "J12_live_for_keys", "metric_key:s, window_start:t, mean_seconds:f",
    lambda v: metrics.metrics_for_keys(metrics.live_metrics(v.assessed), v.completions.select("metric_key"), at="2024-01-30 23:00:00"),
    f"""WITH src AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, completed_at) AS window_start FROM assessed),
newest AS (SELECT * FROM src QUALIFY window_start = max(window_start) OVER (PARTITION BY metric_key)),
st AS ({stats_sql('newest', 'metric_key, window_start')})
SELECT * FROM st WHERE sample_count_accepted > 0 AND window_start <= TIMESTAMP '2024-01-30 23:00:00'""",
    "assessed",
)


def _with_references(v):
    before = Window.partitionBy("metric_key").orderBy("completed_at").rowsBetween(-20, -1)
    return v.completions.withColumn("references", F.collect_list("duration_seconds").over(before))


R.add(
    "M05_assess_sample", "event_id:i, accepted:b, weight:f, rejection_reason:s, reference_count:i, reference_median:f, reference_mad:f, modified_z:f",
    lambda v: samples.assess_sample(_with_references(v)),
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY completed_at) AS rn FROM completions),
pairs AS (SELECT a.event_id, b.duration_seconds AS ref FROM o a JOIN o b ON a.metric_key = b.metric_key AND b.rn BETWEEN a.rn - 20 AND a.rn - 1),
med AS (SELECT event_id, count(*) AS n, median(ref) AS m FROM pairs GROUP BY event_id),
mads AS (SELECT p.event_id, median(abs(ref - m)) AS mad FROM pairs p JOIN med USING (event_id) GROUP BY p.event_id),
j AS (SELECT o.*, coalesce(n, 0) AS n, m, mad, distance_m / duration_seconds * 3.6 > 80 AS fast, abs(duration_seconds - m) AS dev FROM o LEFT JOIN med USING (event_id) LEFT JOIN mads USING (event_id)),
r AS (SELECT *, NOT fast AND n >= 5 AS cmp, CASE WHEN fast THEN 'speed_over_80' WHEN n >= 5 AND CASE WHEN mad = 0 THEN dev > greatest(5.0, m * 0.1) ELSE 0.6745 * dev / mad > 3.5 END THEN 'mad_outlier' END AS reason FROM j)
SELECT event_id, reason IS NULL AS accepted, CASE WHEN reason IS NOT NULL THEN 0.0 WHEN n < 5 THEN 0.5 WHEN confidence = 'high' THEN 1.0 ELSE 0.5 END AS weight,
 reason AS rejection_reason, n AS reference_count, CASE WHEN cmp THEN m END AS reference_median, CASE WHEN cmp THEN mad END AS reference_mad, CASE WHEN cmp AND mad > 0 THEN 0.6745 * dev / mad END AS modified_z FROM r""",
    "completions",
)


def _dense(v):
    """All completions of an origin as one key, squeezed in time so references overlap."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    squeezed = F.timestamp_micros(F.unix_micros(start) + F.floor((F.unix_micros("completed_at") - F.unix_micros(start)) / 20).cast("long"))
    return v.completions.withColumn("metric_key", c("origin_stop_id")).withColumn("completed_at", squeezed)


VERDICTS = "event_id:i, metric_key:s, accepted:b, weight:f, rejection_reason:s, reference_count:i, modified_z:f"
# one step a row of each key: the row is judged by the accepted ones of its last hour
FOLD_SQL = """WITH RECURSIVE d AS (SELECT event_id, origin_stop_id AS metric_key, duration_seconds AS x, distance_m AS m, confidence, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (epoch_us(completed_at) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 20 AS us FROM completions),
o AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY us, x) AS rn FROM d),
f AS (SELECT metric_key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS confidence, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS z, CAST([] AS STRUCT(us BIGINT, x DOUBLE)[]) AS kept FROM (SELECT DISTINCT metric_key FROM o) k
UNION ALL SELECT metric_key, rn, event_id, confidence, reason, n, z, CASE WHEN reason IS NULL THEN list_append(refs, {'us': us, 'x': x}) ELSE refs END AS kept FROM (
 SELECT *, CASE WHEN NOT (isfinite(x) AND isfinite(m) AND x > 0 AND m > 0) THEN 'invalid_measurement' WHEN m / x * 3.6 > 80 THEN 'speed_over_80' WHEN n >= 5 AND CASE WHEN mad = 0 THEN abs(x - med) > greatest(5.0, med * 0.1) ELSE 0.6745 * abs(x - med) / mad > 3.5 END THEN 'mad_outlier' END AS reason,
  CASE WHEN n >= 5 AND isfinite(x) AND isfinite(m) AND x > 0 AND m > 0 AND m / x * 3.6 <= 80 AND mad > 0 THEN 0.6745 * abs(x - med) / mad END AS z FROM (
  SELECT *, list_aggregate(list_transform(refs, lambda r: abs(r.x - med)), 'median') AS mad FROM (
   SELECT *, len(refs) AS n, list_aggregate(list_transform(refs, lambda r: r.x), 'median') AS med FROM (
    SELECT o.metric_key, o.rn, o.event_id, o.us, o.x, o.m, o.confidence, list_filter(f.kept, lambda r: r.us > o.us - 3600000000) AS refs FROM f JOIN o ON o.metric_key = f.metric_key AND o.rn = f.rn + 1) a) b) c) e)
SELECT event_id, metric_key, reason IS NULL AS accepted, CASE WHEN reason IS NOT NULL THEN 0.0 WHEN n < 5 THEN 0.5 WHEN confidence = 'high' THEN 1.0 ELSE 0.5 END AS weight, reason AS rejection_reason, n AS reference_count, z AS modified_z FROM f WHERE rn > 0"""

R.add("M06_accept_sequentially", VERDICTS, lambda v: samples.accept_sequentially(_dense(v)), FOLD_SQL, "completions")
