"""Vehicle positions: duplicates, order, three-sample windows, low speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrain.functions.times import elapsed_seconds
from fleetgrain.operators.ordered import hour_chunk, last_until, max_before, two_previous

VEHICLE = ["vehicle_prefix"]
MAX_GAP_SECONDS = 300
SAMPLE_FIELDS = [
    "event_at", "source_timestamp", "latitude", "longitude", "feed_id", "trip_id", "shape_id", "speed_kmh",
]


def event_time() -> Column:
    """Source time, else the time of receipt."""
    return F.coalesce(F.col("source_timestamp"), F.col("received_at"))


def last_record_wins(batch: DataFrame, batch_keys: list[str]) -> DataFrame:
    """One row per vehicle and payload: the last array position, with the count dropped."""
    rest = [c for c in batch.columns if c not in (*batch_keys, "vehicle_prefix")]
    last = batch.groupBy(*batch_keys, "vehicle_prefix").agg(
        F.max_by(F.struct(*rest), "pos").alias("r"), (F.count("*") - 1).alias("duplicate_count")
    )
    return last.select(*batch_keys, "vehicle_prefix", "r.*", "duplicate_count")


def drop_out_of_order(pings: DataFrame, arrival: list[str]) -> DataFrame:
    """Keep rows strictly newer than everything that arrived before them.

    `arrival` orders the rows of a vehicle; its first column is a timestamp
    or number that also cuts a long history into chunks.
    """
    first = arrival[0]
    chunk = (
        hour_chunk(F.col(first))
        if pings.schema[first].dataType.typeName() == "timestamp"
        else F.floor(F.col(first) / 4096)
    )
    stamped = pings.withColumn("event_at", event_time()).withColumn("_chunk", chunk)
    seen = max_before(
        stamped, VEHICLE, "_chunk", [F.col(c) for c in arrival], F.col("event_at"), "_seen"
    )
    return seen.filter(F.col("_seen").isNull() | (F.col("event_at") > F.col("_seen"))).drop("_chunk", "_seen")


def _resets(previous: str, here: dict[str, Column]) -> Column:
    """A new window starts: nothing before, trip or shape changed, or a long gap."""
    old = F.col(previous)
    return (
        old.isNull()
        | ~here["trip_id"].eqNullSafe(old["trip_id"])
        | ~here["shape_id"].eqNullSafe(old["shape_id"])
        | (elapsed_seconds(here["event_at"], old["event_at"]) > MAX_GAP_SECONDS)
    )


def by_hour(rows: DataFrame) -> DataFrame:
    """Adds `_chunk`, the hour of a row; steps that are given it need no shuffle of their own."""
    return rows if "_chunk" in rows.columns else rows.withColumn("_chunk", hour_chunk(F.col("event_at")))


def position_window(accepted: DataFrame) -> DataFrame:
    """Adds the two previous samples, the capped count and the reset flag.

    The window is at most three samples deep, so two lagged rows decide all;
    no running session number is needed. A `_chunk` that is given stays.
    """
    fields = [c for c in SAMPLE_FIELDS if c in accepted.columns]
    chunked = by_hour(accepted)
    added = [c for c in chunked.columns if c not in accepted.columns]
    lagged = two_previous(chunked, VEHICLE, "_chunk", ["event_at"], fields)
    names = ("trip_id", "shape_id", "event_at")
    here = {n: F.col(n) for n in names}
    before = {n: F.col(f"prev_1.{n}") for n in names}
    reset = _resets("prev_1", here)
    reset_before = _resets("prev_2", before)
    return (
        lagged.withColumn("window_reset", reset)
        .withColumn("_reset_1", reset_before)
        .withColumn(
            "position_sample_count",
            F.when(F.col("window_reset"), 1).when(F.col("_reset_1"), 2).otherwise(3),
        )
        .withColumn("previous_speed_kmh", F.col("prev_1.speed_kmh"))
        .withColumn(
            "previous_state_2",
            F.when(~F.col("window_reset") & ~F.col("_reset_1"), F.col("prev_2")),
        )
        .withColumn("previous_state_1", F.when(~F.col("window_reset"), F.col("prev_1")))
        .drop("prev_1", "prev_2", "_reset_1", *added)
    )


def low_speed_since(windowed: DataFrame) -> DataFrame:
    """Adds the start of the current run below 1 km/h; a reset starts a new run. A `_chunk` that is given stays."""
    low = F.coalesce(F.col("speed_kmh") < 1, F.lit(False))
    low_before = F.coalesce(F.col("previous_speed_kmh") < 1, F.lit(False))
    starts = F.when(low & (F.col("window_reset") | ~low_before), F.col("event_at"))
    chunked = by_hour(windowed)
    added = [c for c in chunked.columns if c not in windowed.columns]
    run = last_until(chunked, VEHICLE, "_chunk", ["event_at"], starts, "_run")
    return run.withColumn("low_speed_since", F.when(low, F.col("_run"))).drop("_run", *added)


def sample_rows(states: DataFrame) -> DataFrame:
    """Current and two previous samples as rows; samples with missing parts skipped."""

    def sample(index: int, ts: Column, lat: Column, lon: Column) -> Column:
        return F.struct(
            F.lit(index).alias("sample_index"), ts.alias("sample_timestamp"),
            lat.alias("latitude"), lon.alias("longitude"),
        )

    def previous(index: int) -> Column:
        state = F.col(f"previous_state_{index}")
        return sample(index, state["source_timestamp"], state["latitude"], state["longitude"])

    current = sample(0, F.col("source_timestamp"), F.col("latitude"), F.col("longitude"))
    kept = [c for c in states.columns if c in ("vehicle_prefix", "event_at", "feed_id", "shape_id", "event_id")]
    rows = states.select(*kept, F.explode(F.array(current, previous(1), previous(2))).alias("s"))
    return rows.select(*kept, "s.*").filter(
        "latitude IS NOT NULL AND longitude IS NOT NULL AND sample_timestamp IS NOT NULL"
    )


def batch_counters(rows: DataFrame) -> DataFrame:
    """Counters of a parsed feed in one aggregation per payload."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    usable = ~F.col("rejected")
    per_vehicle = rows.groupBy("batch_id", "vehicle_prefix").agg(
        F.count("*").alias("received"),
        flag(F.col("rejected")).alias("rejected"),
        flag(usable).alias("kept"),
        flag(usable & ~F.col("location_valid")).alias("invalid_location"),
        flag(usable & F.col("timestamp_text").isNotNull() & F.col("source_timestamp").isNull()).alias(
            "invalid_timestamp"
        ),
    )
    # two levels: a repeated prefix is counted where its vehicle is, then summed
    return per_vehicle.groupBy("batch_id").agg(
        F.sum("received").alias("received"),
        F.sum("rejected").alias("rejected"),
        F.sum(F.greatest(F.col("kept") - 1, F.lit(0))).alias("duplicate_prefixes"),
        F.sum("invalid_location").alias("invalid_locations"),
        F.sum("invalid_timestamp").alias("invalid_timestamps"),
    )
