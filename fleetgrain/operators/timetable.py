"""Timetable operators: calendars, stop pairs, planned durations, patterns."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.functions.status import USABLE
from fleetgrain.functions.text import normalize_line
from fleetgrain.functions.times import (
    at_lit,
    clock_text,
    date_lit,
    fallback_slots,
    runs_on,
)
from fleetgrain.session import materialize, small_side

TRIP = ["feed_id", "trip_id"]
PAIR = ["origin_stop_id", "destination_stop_id"]
DAY_SECONDS = 86_400


def latest_feed(feeds: DataFrame) -> DataFrame:
    """The newest feed by retrieval time; always a single row."""
    return feeds.agg(F.max_by("feed_id", F.struct("retrieved_at", "feed_id")).alias("feed_id"))


def of_latest_feed(df: DataFrame, feeds: DataFrame) -> DataFrame:
    return df.join(F.broadcast(latest_feed(feeds)), "feed_id", "left_semi")


def _is_active(day: Column) -> Column:
    regular = (F.col("start_date") <= day) & (F.col("end_date") >= day) & runs_on(day)
    return F.coalesce(
        (F.col("exception_type") == 1) | (F.col("exception_type").isNull() & regular), F.lit(False)
    )


def service_days(services: DataFrame, exceptions: DataFrame, dates: list[date | str]) -> DataFrame:
    """Service ids active on each of a short list of dates."""
    days = F.array(*[date_lit(d) for d in dates])
    dated = services.withColumn("service_date", F.explode(days))
    return (
        dated.join(exceptions, ["feed_id", "service_id", "service_date"], "left")
        .filter(_is_active(F.col("service_date")))
        .select("feed_id", "service_id", "service_date")
    )


def active_trips(
    trips: DataFrame, routes: DataFrame, services: DataFrame, exceptions: DataFrame, day: date | str
) -> DataFrame:
    """Trips running on a date that can be matched: line, direction and start known."""
    running = service_days(services, exceptions, [day]).select("feed_id", "service_id")
    line = normalize_line(F.col("short_name"))
    return (
        trips.join(running, ["feed_id", "service_id"], "left_semi")
        .join(routes.select("feed_id", "route_id", "short_name"), ["feed_id", "route_id"])
        .withColumn("line", line)
        .filter("line IS NOT NULL AND direction_id IS NOT NULL AND start_seconds IS NOT NULL")
        .select(
            *TRIP, "route_id", "shape_id", "direction_id", "line",
            F.col("direction_id").cast("string").alias("direction"),
            clock_text(F.col("start_seconds")).alias("planned_time"),
            "start_seconds",
        )
    )


def trip_start_seconds(stop_times: DataFrame) -> DataFrame:
    return stop_times.groupBy(*TRIP).agg(
        F.min_by("departure_seconds", "stop_sequence").alias("start_seconds")
    )


def previous_stop_sequence(stop_times: DataFrame) -> DataFrame:
    order = Window.partitionBy(*TRIP).orderBy("stop_sequence")
    return stop_times.withColumn("previous_stop_sequence", F.lag("stop_sequence").over(order))


_STOP_FIELDS = (
    "stop_id", "stop_sequence", "arrival_seconds", "departure_seconds",
    "shape_progress_m", "shape_position", "quality",
)


def next_stop_pairs(stop_times: DataFrame) -> DataFrame:
    """Each stop with the next larger sequence of its trip.

    One window over the trip; the destination travels as a struct so the
    timetable is shuffled and sorted once.
    """
    order = Window.partitionBy(*TRIP).orderBy("stop_sequence")
    fields = [c for c in _STOP_FIELDS if c in stop_times.columns]
    paired = stop_times.select(
        *TRIP,
        *[F.col(c).alias(f"origin_{c}") for c in fields],
        F.lead(F.struct(*fields)).over(order).alias("d"),
    ).filter("d IS NOT NULL")
    return paired.select(
        *TRIP,
        *[f"origin_{c}" for c in fields],
        *[F.col(f"d.{c}").alias(f"destination_{c}") for c in fields],
    )


def _duration() -> Column:
    return F.col("destination_arrival_seconds") - F.col("origin_departure_seconds")


def adjacent_stop_pairs(stop_times: DataFrame) -> DataFrame:
    """Pairs whose sequences differ by exactly one and that take time.

    With unique sequences per trip the next larger one is the +1 one whenever
    that exists, so a window and a filter replace the self join.
    """
    return (
        next_stop_pairs(stop_times)
        .filter("destination_stop_sequence = origin_stop_sequence + 1")
        .withColumn("duration_seconds", _duration())
        .filter("duration_seconds > 0")
    )


def planned_traversals(
    pairs: DataFrame, stop_times: DataFrame, trips: DataFrame, services: DataFrame,
    exceptions: DataFrame, dates: list[date | str],
) -> DataFrame:
    """Scheduled traversals of requested pairs with departure date and slot.

    Runs are dealt by their pair before the dates multiply them: what follows groups by the
    pair and more, so neither the dated rows nor their sums are shuffled again.
    """
    days = small_side(materialize(service_days(services, exceptions, dates)), 64)
    asked = small_side(materialize(pairs.select(*PAIR).distinct()), 64)
    departure = F.col("origin_departure_seconds")
    return (
        adjacent_stop_pairs(stop_times)
        .join(asked, PAIR, "left_semi")
        .join(trips.select(*TRIP, "route_id", "direction_id", "service_id"), TRIP)
        .select("feed_id", *PAIR, "route_id", "direction_id", "service_id", departure, "duration_seconds")
        .repartition(*PAIR)
        .join(days, ["feed_id", "service_id"])
        .select(
            *PAIR, "route_id", "direction_id",
            F.date_add("service_date", F.floor(departure / DAY_SECONDS).cast("int")).alias("departure_date"),
            F.floor(F.pmod(departure, F.lit(DAY_SECONDS)) / 300).cast("int").alias("slot_index"),
            "duration_seconds",
        )
    )


SLOT_KEYS = ["scope", *PAIR, "route_id", "direction_id", "departure_date", "slot_index"]


def planned_slot_means(traversals: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Mean and count per slot for both scopes in one aggregation.

    The service level is aggregated first; the physical level re-aggregates
    those sums instead of the traversals.
    """
    level = [*PAIR, "route_id", "direction_id", "departure_date", "slot_index"]
    service = traversals.groupBy(*level).agg(
        F.sum("duration_seconds").alias("total"), F.count("*").alias("trip_count")
    )
    physical = service.groupBy(*PAIR, "departure_date", "slot_index").agg(
        F.sum("total").alias("total"), F.sum("trip_count").alias("trip_count")
    )
    asked = service
    if requests is not None:
        wanted = [*PAIR, "route_id", "direction_id"]
        given = small_side(materialize(requests.select(*wanted).dropna().distinct()), 96)
        # null-safe, so that both levels read the same rows of one shuffle: no filter goes below it
        same = reduce(and_, [service[c].eqNullSafe(given[c]) for c in wanted])
        asked = service.join(given, same, "left_semi")
    both = asked.withColumn("scope", F.lit("service")).unionByName(
        physical.withColumn("scope", F.lit("physical"))
        .withColumn("route_id", F.lit(None).cast(service.schema["route_id"].dataType))
        .withColumn("direction_id", F.lit(None).cast(service.schema["direction_id"].dataType))
    )
    return both.select(
        *SLOT_KEYS, (F.col("total") / F.col("trip_count")).alias("mean_seconds"), "trip_count"
    )


def requested_windows(requests: DataFrame, at: Column | str) -> DataFrame:
    """26 (service date, slot start, offset) windows per request row.

    The second window of each offset is the day before at +86 400 s.
    """
    slots = F.transform(
        fallback_slots(at_lit(at)),
        lambda s: F.array(
            F.struct(
                s["rank"].alias("rank"), s["offset_minutes"].alias("offset_minutes"),
                s["local_date"].alias("service_date"),
                (s["slot_index"] * 300).alias("slot_start"),
            ),
            F.struct(
                s["rank"].alias("rank"), s["offset_minutes"].alias("offset_minutes"),
                F.date_sub(s["local_date"], 1).alias("service_date"),
                (s["slot_index"] * 300 + DAY_SECONDS).alias("slot_start"),
            ),
        ),
    )
    return requests.select("*", F.explode(F.flatten(slots)).alias("w")).select(
        *requests.columns, "w.rank", "w.offset_minutes", "w.service_date", "w.slot_start"
    )


def planned_in_windows(
    pairs: DataFrame, stop_times: DataFrame, trips: DataFrame, services: DataFrame,
    exceptions: DataFrame, at: Column | str, dates: list[date | str],
) -> DataFrame:
    """Planned runs of requested pairs departing inside a fallback window.

    A window is exactly one five-minute slot, so the range predicate becomes
    an equality on the slot start. Pairs go to the next larger sequence here.
    `dates` lists the local dates the windows can fall on.
    """
    windows = requested_windows(pairs.select(*PAIR).distinct(), at)
    days = service_days(services, exceptions, dates)
    runs = (
        next_stop_pairs(stop_times)
        .withColumn("duration_seconds", _duration())
        .filter("duration_seconds > 0")
        .withColumn("slot_start", (F.floor(F.col("origin_departure_seconds") / 300) * 300).cast("int"))
    )
    return (
        runs.join(windows, [*PAIR, "slot_start"])
        .join(trips.select(*TRIP, "route_id", "direction_id", "service_id"), TRIP)
        .join(days, ["feed_id", "service_id", "service_date"], "left_semi")
        .select(*PAIR, "route_id", "direction_id", "rank", "offset_minutes", "duration_seconds")
    )


def first_offset_mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the first offset, in fallback order, that has rows."""
    per_offset = rows.groupBy(*keys, "rank", "offset_minutes").agg(
        F.avg("duration_seconds").alias("mean_seconds"), F.count("*").alias("sample_count")
    )
    first = per_offset.groupBy(*keys).agg(
        F.min_by(F.struct("offset_minutes", "mean_seconds", "sample_count"), "rank").alias("f")
    )
    return first.select(*keys, "f.offset_minutes", "f.mean_seconds", "f.sample_count")


def planned_segments(stop_times: DataFrame, trips: DataFrame, totals: DataFrame) -> DataFrame:
    """Usable consecutive pairs of a trip; a wrapped terminal takes the shape total."""
    order = Window.partitionBy(*TRIP).orderBy("stop_sequence")
    fields = ["stop_id", "stop_sequence", "arrival_seconds", "shape_progress_m", "quality"]
    paired = stop_times.select(
        *TRIP, *fields, "departure_seconds",
        F.lead(F.struct(*fields)).over(order).alias("d"),
        F.lead("stop_sequence", 2).over(order).isNull().alias("is_last"),
    ).filter("d IS NOT NULL")
    shaped = paired.join(trips.select(*TRIP, "shape_id"), TRIP).join(
        totals, ["feed_id", "shape_id"], "left"
    )
    here, there, total = F.col("shape_progress_m"), F.col("d.shape_progress_m"), F.col("shape_total_m")
    wraps = F.coalesce(F.col("is_last") & (there <= here) & (total > here), F.lit(False))
    usable = F.col("quality").isin(*USABLE) & F.col("d.quality").isin(*USABLE)
    return (
        shaped.withColumn("wrap", wraps)
        .withColumn("destination_progress_m", F.when(F.col("wrap"), total).otherwise(there))
        .withColumn("duration_seconds", F.col("d.arrival_seconds") - F.col("departure_seconds"))
        .filter(
            ((F.col("stop_id") != F.col("d.stop_id")) | F.col("wrap"))
            & (F.col("destination_progress_m") > here)
            & (F.col("duration_seconds") > 0)
            & usable
        )
        .select(
            *TRIP,
            F.col("stop_id").alias("origin_stop_id"),
            F.col("d.stop_id").alias("destination_stop_id"),
            F.col("stop_sequence").alias("origin_stop_sequence"),
            F.col("d.stop_sequence").alias("destination_stop_sequence"),
            here.alias("origin_progress_m"),
            "destination_progress_m",
            F.col("duration_seconds").cast("double").alias("duration_seconds"),
        )
    )


def index_counts(active: DataFrame, segments: DataFrame) -> DataFrame:
    """Active trips and their planned segments, from one pass over each side."""
    per_trip = segments.groupBy(*TRIP).agg(F.count("*").alias("n"))
    return (
        active.select(*TRIP)
        .join(per_trip, TRIP, "left")
        .agg(
            F.count("*").alias("active_trips"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("planned_segments"),
        )
    )


def stop_patterns(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Trip to ordered stop-id array with a content id per distinct pattern.

    The id is a hash of shape and stops, so numbering the patterns needs no
    global sort; `pattern_numbers` ranks them where an ordinal is wanted.
    """
    ordered = stop_times.groupBy(*TRIP).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id"))),
            lambda s: s["stop_id"],
        ).alias("stop_ids")
    )
    return (
        trips.filter("shape_id IS NOT NULL")
        .select(*TRIP, "shape_id")
        .join(ordered, TRIP)
        .withColumn(
            "pattern_id",
            F.sha2(F.to_json(F.struct("feed_id", "shape_id", "stop_ids")), 256),
        )
    )


def distinct_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern_id").agg(
        F.first("feed_id").alias("feed_id"),
        F.first("shape_id").alias("shape_id"),
        F.first("stop_ids").alias("stop_ids"),
        F.count("*").alias("trip_count"),
    )


def pattern_members(patterns: DataFrame, distinct: DataFrame) -> DataFrame:
    """Trip to pattern by shape and stop array; the content id carries both."""
    return patterns.select(*TRIP, "pattern_id").join(
        distinct.select("pattern_id"), "pattern_id", "left_semi"
    )


ASSIGNED = ("shape_position", "shape_progress_m", "distance_to_shape_m", "quality")


def assign_pattern_stops(
    stop_times: DataFrame, members: DataFrame, assignments: DataFrame
) -> DataFrame:
    """Overwrite the four projection columns from the trip's pattern.

    A pattern's assignments travel to its trips as one map by stop ordinal, so stops are
    shuffled by trip only and never carry the pattern's id.
    """
    order = Window.partitionBy(*TRIP).orderBy("stop_sequence")
    kept = [c for c in stop_times.columns if c not in ASSIGNED]
    numbered = stop_times.withColumn("stop_ordinal", F.row_number().over(order))
    fresh = assignments.groupBy("pattern_id").agg(
        F.map_from_entries(F.collect_list(F.struct("stop_ordinal", F.struct(*ASSIGNED).alias("new")))).alias("_new")
    )
    placed = members.join(fresh, "pattern_id").select(*TRIP, "_new")
    joined = numbered.join(placed, TRIP, "left").withColumn("new", F.try_element_at("_new", F.col("stop_ordinal")))

    def value(name: str) -> Column:
        old = F.col(name) if name in stop_times.columns else F.lit(None)
        return F.when(F.col("new").isNotNull(), F.col(f"new.{name}")).otherwise(old).alias(name)

    return joined.select(*kept, *[value(c) for c in ASSIGNED])


def trip_geometry(
    trips: DataFrame, routes: DataFrame, feeds: DataFrame, lines: DataFrame,
    stop_times: DataFrame, stops: DataFrame,
) -> DataFrame:
    """Per trip id of the newest feed holding it: route, line and ordered stops.

    Restrict `trips` to the ids wanted; the newest feed is chosen before the
    wide joins so older versions are never expanded. Lines come last, so their
    points are shuffled once per shape and never per trip.
    """
    drawn = lines.select("feed_id", "shape_id").distinct()
    versions = small_side(materialize(feeds.select("feed_id", "retrieved_at")), 64)
    named = small_side(materialize(routes.select("feed_id", "route_id", "short_name")), 96)
    places = small_side(materialize(stops.select("feed_id", "stop_id", "name", "latitude", "longitude")), 128)
    chosen = (
        trips.join(versions, "feed_id")
        .join(named, ["feed_id", "route_id"])
        .join(drawn, ["feed_id", "shape_id"])
        .groupBy("trip_id")
        .agg(
            F.max_by(
                F.struct("feed_id", "route_id", "short_name", "direction_id", "shape_id"),
                "retrieved_at",
            ).alias("t")
        )
        .select("trip_id", "t.*")
    )
    stop = F.struct(
        "stop_sequence", "stop_id", "name", "latitude", "longitude",
        "shape_progress_m", "arrival_seconds", "departure_seconds", "quality",
    )
    ordered = (
        stop_times.join(places, ["feed_id", "stop_id"])
        .groupBy(*TRIP)
        .agg(F.sort_array(F.collect_list(stop)).alias("stops"))
    )
    placed = chosen.join(ordered, TRIP, "left").join(lines.select("feed_id", "shape_id", "points"), ["feed_id", "shape_id"])
    fields = ("trip_id", "feed_id", "route_id", "short_name", "direction_id", "shape_id", "points", "stops")
    return placed.select(*fields)


