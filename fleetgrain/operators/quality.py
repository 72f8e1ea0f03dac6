"""Data-quality profile of a text table (every column as read, untyped)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.functions.text import canonical_text, date_format_class, is_blank, locale_number, stripped
from fleetgrain.functions.times import locale_date
from fleetgrain.operators.ordered import MEDIAN, group_quantiles, nearest_rank

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
EMPTY_SOURCE = "<vazio>"
# Thresholds of the on-time rule sweep, in minutes.
SWEEP_MINUTES = (0, 5, 10, 15, 30, 60)


def _count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _pct(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits))


def _long(df: DataFrame, keys: list[str], columns: list[str], prefix: str, name: str, value: str) -> DataFrame:
    """One row per (key, column) from wide counters named prefix + column."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(prefix + c).alias(value)) for c in columns]
    )
    kept = [c for c in df.columns if c not in {prefix + x for x in columns}]
    return df.select(*kept, F.explode(pairs).alias("_p")).select(*kept, f"_p.{name}", f"_p.{value}")


def missing_by_column(df: DataFrame) -> DataFrame:
    """Blank count and percentage per column, worst first; one pass."""
    counts = df.agg(
        F.count("*").alias("rows"), *[_count(is_blank(F.col(c))).alias(f"b_{c}") for c in df.columns]
    )
    long = _long(counts, [], df.columns, "b_", "column_name", "blank")
    return long.select(
        "column_name", "blank", _pct(F.col("blank"), F.col("rows"), 3).alias("blank_pct")
    ).orderBy(F.desc("blank"), "column_name")


def overall_blank_pct(df: DataFrame) -> DataFrame:
    blanks = sum((is_blank(F.col(c)).cast("int") for c in df.columns), F.lit(0))
    return df.agg(
        _pct(F.sum(blanks), F.count("*") * len(df.columns), 3).alias("overall_blank_pct")
    )


def missing_by_group(df: DataFrame, group: str, worst: int = 6) -> DataFrame:
    """Rows, blank percentage and the worst columns per non-blank trimmed group."""
    named = df.withColumn("_g", stripped(F.col(group))).filter(~is_blank(F.col(group)))
    counts = named.groupBy(F.col("_g").alias("group_value")).agg(
        F.count("*").alias("rows"), *[_count(is_blank(F.col(c))).alias(f"b_{c}") for c in df.columns]
    )
    total = sum((F.col(f"b_{c}") for c in df.columns), F.lit(0))
    counts = counts.withColumn("blank_pct_all", _pct(total, F.col("rows") * len(df.columns), 3))
    long = _long(counts, ["group_value"], df.columns, "b_", "column_name", "blank")
    long = long.withColumn("blank_pct", _pct(F.col("blank"), F.col("rows"), 2))
    order = Window.partitionBy("group_value").orderBy(F.desc("blank_pct"), "column_name")
    return long.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= worst).drop("blank")


def exact_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def _group_excess(groups: DataFrame) -> DataFrame:
    repeated = groups.filter("n > 1")
    return repeated.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess")
    )


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    ids = df.filter(~is_blank(F.col(column))).groupBy(stripped(F.col(column)).alias("id"))
    return _group_excess(ids.agg(F.count("*").alias("n")))


def normalized_duplicates(df: DataFrame) -> DataFrame:
    return exact_duplicate_rows(df.select(*[canonical_text(F.col(c)).alias(c) for c in df.columns]))


def near_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups and excess rows sharing a normalised business signature."""
    signature = [canonical_text(F.col(c)).alias(c) for c in columns]
    return _group_excess(df.select(*signature).groupBy(*columns).agg(F.count("*").alias("n")))


def _spellings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per (column, canonical form, spelling); counted before any gathering."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("spelling")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").filter(~is_blank(F.col("spelling")))
    counted = long.groupBy("column_name", "spelling").agg(F.count("*").alias("n"))
    return counted.withColumn("canonical", canonical_text(F.col("spelling")))


def category_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spellings of canonical forms that have more than one, as a map of counts."""
    groups = _spellings(df, columns).groupBy("column_name", "canonical").agg(
        F.map_from_entries(F.collect_list(F.struct("spelling", "n"))).alias("spellings"),
        F.count("*").alias("variants"), F.sum("n").alias("rows"), F.max("n").alias("most"),
    )
    return groups.filter("variants > 1")


def noncanonical_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows not using the most frequent spelling, per column."""
    groups = _spellings(df, columns).groupBy("column_name", "canonical").agg(
        F.sum("n").alias("rows"), F.max("n").alias("most")
    )
    return groups.groupBy("column_name").agg(F.sum(F.col("rows") - F.col("most")).alias("noncanonical"))


def date_formats(df: DataFrame, column: str) -> DataFrame:
    named = df.select(date_format_class(F.col(column)).alias("date_format")).filter("date_format IS NOT NULL")
    return named.groupBy("date_format").agg(F.count("*").alias("rows"))


def invalid_values(
    df: DataFrame, numeric: list[str], binary: list[str], dates: list[str]
) -> DataFrame:
    """Counts of unparsable or impossible values per column and kind, in one pass."""
    tests: dict[str, Column] = {}
    for c in numeric:
        present, value = ~is_blank(F.col(c)), locale_number(F.col(c))
        tests[f"{c}:not_numeric"] = present & value.isNull()
        tests[f"{c}:negative"] = present & (value < 0)
    for c in binary:
        tests[f"{c}:outside_0_1"] = ~is_blank(F.col(c)) & ~stripped(F.col(c)).isin("0", "1")
    for c in dates:
        tests[f"{c}:invalid_date"] = ~is_blank(F.col(c)) & locale_date(F.col(c)).isNull()
    return _violations(df, tests, "check_name", "rows")


def _violations(df: DataFrame, tests: dict[str, Column], name: str, value: str) -> DataFrame:
    keys = [f"t{i}" for i in range(len(tests))]
    counts = df.agg(*[_count(t).alias(k) for k, t in zip(keys, tests.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias(name), F.col(k).alias(value)) for k, n in zip(keys, tests)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def temporal_violations(df: DataFrame, pairs: list[tuple[str, str]], collected: tuple[str, str]) -> DataFrame:
    """Ends before starts, and departures on a day before the collection."""
    tests = {
        f"{end}_before_{start}": locale_date(F.col(end)) < locale_date(F.col(start)) for start, end in pairs
    }
    taken, left = collected
    tests[f"{left}_before_{taken}"] = F.to_date(locale_date(F.col(left))) < F.to_date(locale_date(F.col(taken)))
    return _violations(df, tests, "check_name", "rows")


def _flag_differs(delay: Column, flag: Column, minutes: Column) -> Column:
    return (delay <= minutes) != (flag == 1)


def flag_mismatch(df: DataFrame, delay: str, flag: str) -> DataFrame:
    d, f = locale_number(F.col(delay)), locale_number(F.col(flag))
    return df.agg(_count(_flag_differs(d, f, F.lit(0))).alias("mismatches"))


def threshold_sweep(df: DataFrame, delay: str, flag: str, minutes: tuple[int, ...] = SWEEP_MINUTES) -> DataFrame:
    """Mismatches per threshold; an unreadable flag counts as not on time."""
    d = locale_number(F.col(delay))
    on_time = F.coalesce(locale_number(F.col(flag)) == 1, F.lit(False))
    counts = df.agg(*[_count((d <= m) != on_time).alias(f"t_{m}") for m in minutes])
    pairs = F.array(*[F.struct(F.lit(m).alias("threshold"), F.col(f"t_{m}").alias("mismatches")) for m in minutes])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def derived_delay_mismatch(df: DataFrame, delay: str, planned: str, actual: str) -> DataFrame:
    """Stated delay more than a minute from the one the timestamps give."""
    minutes = F.bround(
        (F.unix_micros(locale_date(F.col(actual)).cast("timestamp")) - F.unix_micros(locale_date(F.col(planned)).cast("timestamp")))
        / 60_000_000.0
    )
    return df.agg(_count(F.abs(minutes - locale_number(F.col(delay))) > 1).alias("mismatches"))


def lag_distribution(df: DataFrame, start: str, end: str) -> DataFrame:
    """Median, nearest-rank 95th percentile and negatives of hours between two dates."""
    hours = (
        F.unix_micros(locale_date(F.col(end)).cast("timestamp")) - F.unix_micros(locale_date(F.col(start)).cast("timestamp"))
    ) / 3_600_000_000.0
    lags = df.select(hours.alias("hours"))
    spread = group_quantiles(lags, [], "hours", {"median": MEDIAN, "p95": nearest_rank(95)})
    negative = lags.agg(_count(F.col("hours") < 0))
    return spread.select(
        F.round("median", 2).alias("median_hours"), F.round("p95", 2).alias("p95_hours"), "n"
    ).withColumn("negative", negative.scalar())


def group_median_outliers(
    df: DataFrame, keys: list[str], value: str, at_least: int = 5, factor: float = 4.0
) -> DataFrame:
    """Rows under a quarter or over four times the median of their normalised group."""
    named = df.select(
        *[canonical_text(F.col(k)).alias(k) for k in keys], locale_number(F.col(value)).alias("x")
    ).filter("x IS NOT NULL")
    medians = group_quantiles(named, keys, "x", {"median": MEDIAN}).filter(
        (F.col("n") >= at_least) & (F.col("median") > 0)
    )
    judged = named.join(medians, keys)
    return judged.agg(
        _count((F.col("x") < F.col("median") / factor) | (F.col("x") > F.col("median") * factor)).alias("outliers")
    )


def implausible(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Counts of values beyond fixed physical or business bounds."""
    return _violations(df, tests, "check_name", "rows")


def transport_bounds(km: str, weight: str, volume: str, freight: str, fuel: str, toll: str, temp: str) -> dict[str, Column]:
    """Fixed bounds of the delivery table."""
    n = {name: locale_number(F.col(name)) for name in (km, weight, volume, freight, fuel, toll, temp)}
    return {
        f"{km}_extreme": (n[km] == 0) | (n[km] > 5000),
        f"{weight}_over_80t": n[weight] > 80000,
        f"{volume}_over_200m3": n[volume] > 200,
        f"{fuel}_very_high": (n[km] != 0) & (n[fuel] > F.greatest(F.lit(20000.0), n[km] * 10)),
        f"{freight}_over_100k": n[freight] > 100000,
        f"{toll}_over_10k": n[toll] > 10000,
        f"{temp}_outside_-40_60": (n[temp] < -40) | (n[temp] > 60),
    }


def quality_by_source(df: DataFrame, source: str, date_column: str) -> DataFrame:
    """Rows, share, blank and ISO-date percentage per source; blank is its own source."""
    name = F.coalesce(F.nullif(stripped(F.col(source)), F.lit("")), F.lit(EMPTY_SOURCE))
    blanks = sum((is_blank(F.col(c)).cast("int") for c in df.columns), F.lit(0))
    groups = df.groupBy(name.alias("source_name")).agg(
        F.count("*").alias("rows"), F.sum(blanks).alias("blanks"),
        _count(stripped(F.col(date_column)).rlike(ISO_DATE)).alias("iso"),
    )
    total = groups.agg(F.sum("rows"))
    return groups.select(
        "source_name", "rows", _pct(F.col("rows"), total.scalar(), 2).alias("share_pct"),
        _pct(F.col("blanks"), F.col("rows") * len(df.columns), 3).alias("blank_pct_all"),
        _pct(F.col("iso"), F.col("rows"), 2).alias("iso_date_pct"),
    )


def conditional_completeness(df: DataFrame, reason: str, delay: str, flag: str) -> DataFrame:
    """Blank reasons among late rows and among rows flagged not on time."""
    late = F.coalesce(locale_number(F.col(delay)) > 0, F.lit(False))
    missed = F.coalesce(locale_number(F.col(flag)) == 0, F.lit(False))
    blank = is_blank(F.col(reason))
    counts = df.agg(
        F.count_if(late).alias("late_rows"), F.count_if(late & blank).alias("_late_blank"),
        F.count_if(missed).alias("not_on_time_rows"), F.count_if(missed & blank).alias("_missed_blank"),
    )
    return counts.select(
        "late_rows", _pct(F.col("_late_blank"), F.col("late_rows"), 2).alias("reason_blank_when_late_pct"),
        "not_on_time_rows",
        _pct(F.col("_missed_blank"), F.col("not_on_time_rows"), 2).alias("reason_blank_when_not_on_time_pct"),
    )


def filled_by_segment(df: DataFrame, segment: str, column: str) -> DataFrame:
    """Share of rows with a value, per trimmed segment."""
    return df.groupBy(stripped(F.col(segment)).alias("segment")).agg(
        F.count("*").alias("rows"),
        _pct(_count(~is_blank(F.col(column))), F.count("*"), 2).alias("filled_pct"),
    )


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, median and maximum per numeric column, all columns in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), locale_number(F.col(c)).alias("x")) for c in columns]
    )
    long = df.select(F.explode(pairs).alias("p")).select("p.*").filter("x IS NOT NULL")
    ends = long.groupBy("column_name").agg(F.min("x").alias("minimum"), F.max("x").alias("maximum"))
    medians = group_quantiles(long, ["column_name"], "x", {"median": MEDIAN})
    return ends.join(medians, "column_name")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per trimmed pair in long form; rows with a blank `b` are left out."""
    named = df.filter(~is_blank(F.col(b)))
    return named.groupBy(stripped(F.col(a)).alias("a"), stripped(F.col(b)).alias("b")).agg(
        F.count("*").alias("rows")
    )


def date_range(df: DataFrame, column: str) -> DataFrame:
    d = F.to_date(locale_date(F.col(column)))
    return df.agg(F.min(d).alias("date_min"), F.max(d).alias("date_max"))


def check_expectations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Violations per named SQL rule; a rule that is null passes, as a check would."""
    tests = {name: ~F.expr(rule) for name, rule in checks.items()}
    return _violations(df, tests, "check_name", "violations")


# Integrity rules of the tables.
_SCOPE_CHECKS = {
    "scope_known": "scope IN ('physical', 'service')",
    "scope_dimensions": "(scope = 'physical' AND route_id IS NULL AND direction_id IS NULL)"
    " OR (scope = 'service' AND route_id IS NOT NULL AND direction_id IS NOT NULL)",
}
STATE_CHECKS = {
    "latitude": "latitude BETWEEN -90 AND 90",
    "longitude": "longitude BETWEEN -180 AND 180",
    "speed": "speed_kmh >= 0",
    "shape_position": "shape_position BETWEEN 0 AND 1",
    "shape_distance": "distance_to_shape_m >= 0",
    "shape_progress": "shape_progress_m >= 0",
    "projection_quality": "projection_quality IN ('valid', 'reduced', 'fallback_required')",
    "sample_count": "position_sample_count BETWEEN 1 AND 3",
    "map_match_status": "map_match_status IN ('collecting', 'resolved', 'ambiguous', 'fallback_required')",
}
OBSERVATION_CHECKS = {
    **_SCOPE_CHECKS,
    "measurements": "duration_seconds > 0 AND distance_m > 0 AND average_speed_kmh > 0",
    "confidence": "confidence IN ('high', 'reduced')",
    "assessment": "(accepted AND weight > 0 AND weight <= 1 AND rejection_reason IS NULL)"
    " OR (NOT accepted AND weight = 0 AND rejection_reason IS NOT NULL)",
    "rejection_reason": "rejection_reason IN ('speed_over_80', 'mad_outlier', 'invalid_measurement')",
}
METRIC_CHECKS = {
    **_SCOPE_CHECKS,
    "window": "window_end = window_start + INTERVAL 5 MINUTES",
    "sample_counts": "sample_count_total = sample_count_accepted + sample_count_rejected",
    "has_samples": "sample_count_total > 0",
    "accepted_weight": "accepted_weight >= 0",
    "reliability": "reliability BETWEEN 0 AND 1",
    "status": "status IN ('insufficient', 'low', 'medium', 'high', 'anomalous')",
}
SEGMENT_CHECKS = {
    "sequence": "segment_sequence >= 0",
    "length": "segment_length_m > 0",
    "distances": "start_distance_m >= 0 AND end_distance_m > start_distance_m",
    "fractions": "start_fraction BETWEEN 0 AND 1 AND end_fraction BETWEEN 0 AND 1"
    " AND end_fraction > start_fraction",
}
