"""Future-time estimates: the cursor moves along and live metrics age."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgrain.functions.identity import metric_key
from fleetgrain.operators.eta import eta_current_time, eta_future_time, reachable_candidates, resolve_remaining

AT = "2026-08-28 13:00:00"
CATALOG = (
    "metric_key string, source string, day_type string, service_date date, slot_index int, value_seconds double,"
    " reliability double, sample_count bigint, window_end timestamp"
)


def setup(spark):
    segments = spark.createDataFrame(
        [("V", "T", "R", 1, "A", "B", 1, 0.25, 300.0), ("V", "T", "R", 1, "B", "C", 2, 1.0, None), ("V", "T", "R", 1, "C", "D", 3, 1.0, None)],
        "vehicle_prefix string, trip_id string, route_id string, direction_id int, origin_stop_id string, destination_stop_id string,"
        " origin_stop_sequence int, remaining_fraction double, planned_duration_seconds double",
    )
    keys = segments.select(
        "origin_stop_sequence",
        metric_key(F.lit("physical"), F.col("origin_stop_id"), F.col("destination_stop_id"), F.lit(None), F.lit(None)).alias("k"),
    ).collect()
    key = {r["origin_stop_sequence"]: r["k"] for r in keys}
    rows = [
        # live until 12:30 + 1 h: usable at 13:00 but not when reached 40 minutes later
        (key[1], "live", None, None, None, 9600.0, 0.9, 4, "2026-08-28 12:30:00"),
        (key[2], "live", None, None, None, 100.0, 0.8, 4, "2026-08-28 12:30:00"),
        # local slot 10:40 is index 128, slot 10:00 is 120
        (key[2], "historical", "weekday", None, 128, 200.0, 0.5, 3, None),
        (key[2], "historical", "weekday", None, 120, 700.0, 0.5, 3, None),
    ]
    catalog = spark.createDataFrame(rows, CATALOG.replace("window_end timestamp", "window_end string")).withColumn(
        "window_end", F.col("window_end").cast("timestamp")
    )
    return segments, catalog


def test_current_time_takes_everything_now(spark):
    segments, catalog = setup(spark)
    row = eta_current_time(resolve_remaining(segments, catalog, AT)).filter("scope = 'physical'").first()
    assert (row["segments_covered"], row["segments_total"], row["complete"]) == (2, 3, False)
    assert (row["count_live"], row["next_stop_seconds"]) == (2, 2400.0)
    assert (row["missing_origin_stop_id"], row["missing_destination_stop_id"]) == ("C", "D")


def test_future_time_ages_live_and_moves_slots(spark):
    segments, catalog = setup(spark)
    row = eta_future_time(reachable_candidates(segments, catalog, AT)).filter("scope = 'physical'").first()
    assert row["next_stop_seconds"] == 2400.0
    # reached at 13:40 UTC: live too old, the 10:40 slot answers
    assert (row["count_live"], row["count_historical"]) == (1, 1)
    assert row["value_seconds"] is None and row["missing_origin_stop_id"] == "C"
    assert round(row["reliability"], 6) == round((2400 * 0.9 + 200 * 0.5) / 2600, 6)
