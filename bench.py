"""Time the headline queries and print one JSON line; a query that fails is named in it."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetgrain.catalog.index import all_entries  # noqa: E402
from fleetgrain.session import build_session  # noqa: E402

HEADLINE = (
    "P39_state_columns", "A03_daily_metrics", "A05_rolling_profile", "M05_assess_sample", "M06_accept_sequentially",
    "J01_exact_trip_match", "W04_position_window", "W06_low_speed_since", "J10_planned_traversals",
    "A06_planned_slot_means", "W12_completed_segments", "G06_shape_segments", "G09_nearby_segments",
    "M01_match_three_samples", "E04_catalog_resolve", "E05_eta_current_time", "E06_eta_future_time",
    "E13_segment_speed_map", "X04_assign_per_terminal", "J21_fleet_rows", "Q01_missing_by_column",
    "Q21_numeric_summary", "T06_materialize_windows", "T07_correlate_stream", "K02_travel_time_replay", "K03_snapshot_job",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = {e.name: e for e in all_entries()}
    spark.read.parquet(f"{folder}/orders.parquet").count()
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        try:
            entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:  # noqa: BLE001 - the figures of the others are still wanted
            failed[name] = f"{type(error).__name__}: {str(error)[:300]}"
            continue
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "failed": failed, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
