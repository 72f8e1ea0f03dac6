"""Composed jobs: timetable load, travel-time replay, snapshots, fleet map."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrain.operators import crossings, estimates, eta, fleet, matching, metrics, positions, samples, shapes, timetable
from fleetgrain.operators.correlation import exact_trip_match, trip_candidates
from fleetgrain.operators.ordered import running_sum
from fleetgrain.operators.shapes import SHAPE
from fleetgrain.operators.timetable import TRIP
from fleetgrain.session import in_slices, materialize, settled, slices_of, small_side, without_steps
from fleetgrain.sources.loads import AlreadyPublished
from fleetgrain.sources.tables import overwrite_upsert, read_current
from fleetgrain.sources.timetable import append_feed_tables, new_feed_versions, read_gtfs


def fleet_map(
    states: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame, segments: DataFrame, at: Column | str
) -> DataFrame:
    """Projected and raw positions in one view, with the number of monitored vehicles."""
    projected = fleet.projected_positions(states, trips, routes, stops, segments, at).withColumn(
        "position_source", F.lit("projected")
    ).withColumn("operational_class", F.lit("projected"))
    raw = fleet.raw_positions(states, at).withColumn("position_source", F.lit("raw"))
    monitored = fleet.recent_signals(states, at).agg(F.count("*"))
    both = projected.unionByName(raw, allowMissingColumns=True)
    return both.withColumn("monitored", monitored.scalar())


def project_timetable(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds lines, shape segments and stop positions to the tables of a version.

    Stops are placed once per distinct (shape, stop list) and then spread to
    the trips that share it. Fails before anything is written when a pattern
    has no monotone placement. Segments and placed stop times are stored, as they are read
    several times; the steps on the way to them are removed.
    """
    spark = tables["shape_points"].sparkSession
    segments = materialize(shapes.shape_segments(tables["shape_points"]))
    placed = settled(spark, lambda: _placed_stop_times(tables, segments))
    return {
        **tables, "shapes": shapes.assemble_lines(tables["shape_points"]), "shape_segments": segments,
        "stop_times": placed,
    }


def _placed_stop_times(tables: dict[str, DataFrame], segments: DataFrame) -> DataFrame:
    spark = segments.sparkSession
    stop_times = materialize(tables["stop_times"])
    patterns = materialize(timetable.stop_patterns(tables["trips"], stop_times))
    distinct = materialize(timetable.distinct_patterns(patterns))
    stops = matching.pattern_stops(distinct, tables["stops"])
    paths = in_slices(
        spark, slices_of(segments), lambda mine: matching.monotone_with_fallback(stops.where(mine(*SHAPE)), segments.where(mine(*SHAPE)))
    )
    if not paths.filter("path IS NULL").isEmpty():
        raise ValueError("timetable has a stop pattern without monotone projection")
    members, assignments = timetable.pattern_members(patterns, distinct), matching.path_assignments(paths)
    return in_slices(
        spark, slices_of(stop_times),
        lambda mine: timetable.assign_pattern_stops(stop_times.where(mine(*TRIP)), members.where(mine(*TRIP)), assignments),
    )


def _content_of(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of an archive, or of a folder as one version.

    A folder's content is, per member, the number of its lines and the sum of their
    hashes: members may be files or folders of part files of any size, and neither the
    folder's place nor the order of the parts changes it.
    """
    if path.endswith(".zip"):
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+\.txt)(?:/[^/]*)?$", 1).alias("member"), F.sha2("value", 256).alias("h")
    )
    number = F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")
    sums = lines.groupBy("member").agg(F.count("*").alias("n"), F.sum(number).alias("s")).select(F.concat_ws(":", "member", "n", "s").alias("part"))
    # one row per member file of the format
    whole = sums.agg(F.array_join(F.sort_array(F.collect_list("part")), " ").cast("binary").alias("content"))
    return whole.withColumn("source", F.lit(path))


def timetable_job(
    spark: SparkSession, path: str, feed_id: str, target: str, feeds: DataFrame, retrieved_at: str
) -> dict[str, int]:
    """Load one timetable version unless its content is known.

    Returns row counts per table, empty for known content. All tables and the row of the
    version itself are one load under the name of the content, so a failure at any point
    leaves nothing visible, a retry brings each row once, and of two jobs with the same
    content one publishes. Steps are gone when it ends, those that are tables once they are written.
    """
    files = _content_of(spark, path)
    version = new_feed_versions(files, feeds).select("content_hash").first()
    if version is None:
        return {}
    feed = spark.createDataFrame(
        [(feed_id, version["content_hash"], retrieved_at)], "feed_id string, content_hash string, retrieved_at string"
    ).withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
    with without_steps(spark):
        tables = project_timetable(read_gtfs(spark, path, feed_id))
        try:
            return append_feed_tables({**tables, "feeds": feed}, target, version["content_hash"], spent=True)
        except AlreadyPublished:
            return {}


def correlated_windows(pings: DataFrame, active: DataFrame) -> DataFrame:
    """Newest-only pings correlated to trips, with their three-sample windows, by session.

    Rows are dealt by vehicle and hour once for the windows, low speed and sessions, and not
    at all for the match while its keys are few.
    """
    matched = exact_trip_match(pings, active, small_side(materialize(trip_candidates(active)), 192))
    accepted = materialize(positions.drop_out_of_order(matched, ["received_at", "pos"]))
    return in_slices(
        pings.sparkSession, slices_of(accepted),
        lambda mine: sessions(
            positions.low_speed_since(positions.position_window(positions.by_hour(accepted.where(mine(*positions.VEHICLE)))))
        ).drop("_chunk"),
    )


def match_windows(states: DataFrame, segments: DataFrame) -> DataFrame:
    """Map-matched states: projection and previous progress from the chosen path.

    Paths and nearest points are stored first, so that the shuffles of shapes are gone when whole states
    are joined.
    """
    keys = ["vehicle_prefix", "event_at"]
    eligible = states.filter("correlation_status = 'matched'")
    rows = positions.sample_rows(eligible)
    near = shapes.nearby_segments(rows, segments, [*keys, "sample_index"])
    matches = matching.match_three_samples(matching.sample_windows(near, keys)).select(*keys, "match_status", "path")
    return coarse_positions(matching.resolve_positions(states, materialize(matches), keys), segments, keys)


def matched_states(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """`match_windows` of stored windows, stored, in slices by shape; those on no shape are dealt by vehicle."""

    def slice_(mine: Callable[..., Column]) -> DataFrame:
        own = F.when(F.col("shape_id").isNull(), mine(*positions.VEHICLE)).otherwise(mine(*SHAPE))
        return match_windows(windows.where(own), segments.where(mine(*SHAPE)))

    return in_slices(windows.sparkSession, slices_of(windows), slice_)


def coarse_positions(states: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Vehicles on a trip that no path resolves, placed at the nearest point of their shape.

    The status says why there is no path: too far from the shape, too few samples, or
    several ways to read them. One that the matching has given stays.
    """
    open_ = states.filter(
        "correlation_status = 'matched' AND map_match_status <> 'resolved' AND latitude IS NOT NULL AND longitude IS NOT NULL"
    )
    placed = materialize(shapes.project_on_shape(open_, segments, keys))
    fields = [c for c in placed.columns if c not in keys]
    joined = states.join(placed.select(*keys, F.struct(*fields).alias("_coarse")), keys, "left")
    found = F.col("_coarse").isNotNull()
    status = (
        F.when(F.col("map_match_status") != "collecting", F.col("map_match_status"))
        .when(F.col("_coarse.projection_quality") == "fallback_required", "fallback_required")
        .when(F.col("position_sample_count") < 3, "collecting")
        .otherwise("ambiguous")
    )
    values = {c: F.when(found, F.col(f"_coarse.{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns({**values, "map_match_status": F.when(found, status).otherwise(F.col("map_match_status"))}).drop("_coarse")


def current_vehicles(states: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The newest state of every vehicle; resolved ones with the stop pair they are between."""
    rest = [c for c in states.columns if c != "vehicle_prefix"]
    newest = states.groupBy("vehicle_prefix").agg(F.max_by(F.struct(*rest), "event_at").alias("r")).select("vehicle_prefix", "r.*")
    return newest.join(crossings.locate_current_segment(newest, stop_times), "vehicle_prefix", "left")


def resolved_moves(states: DataFrame) -> DataFrame:
    """Consecutive resolved samples of a vehicle as moves along its trip."""
    previous = F.col("previous_state_1")
    return states.filter("map_match_status = 'resolved' AND previous_1_progress_m IS NOT NULL").select(
        "vehicle_prefix", "session_id", "feed_id", "trip_id", "route_id",
        previous["event_at"].alias("previous_timestamp"), F.col("event_at").alias("current_timestamp"),
        F.col("previous_1_progress_m").alias("previous_progress_m"),
        F.col("shape_progress_m").alias("current_progress_m"),
    )


def sessions(states: DataFrame) -> DataFrame:
    """Numbers the runs between window resets; a boundary never spans two of them. A `_chunk` that is given stays."""
    chunked = positions.by_hour(states)
    added = [c for c in chunked.columns if c not in states.columns]
    started = F.col("window_reset").cast("int")
    return running_sum(chunked, ["vehicle_prefix"], "_chunk", ["event_at"], started, "session_id").drop(*added)


def travel_time_replay(pings: DataFrame, tables: dict[str, DataFrame], active: DataFrame) -> dict[str, DataFrame]:
    """The whole chain over a history of pings: states, observations and metrics.

    Shuffles follow the data: by vehicle up to the crossings, by metric key
    after them. Each stage is read more than once by the next, so it is
    stored; a lost executor repeats one stage, not the chain. What only leads to
    a returned stage is removed once that is stored.
    """
    spark = pings.sparkSession
    states = settled(spark, lambda: matched_states(settled(spark, lambda: correlated_windows(pings, active)), tables["shape_segments"]))
    crossed = crossings.interpolate_crossings(resolved_moves(states), crossings.trip_boundaries(tables["stop_times"]))
    completed = crossings.completed_segments(crossed).join(
        tables["trips"].select("feed_id", "trip_id", "direction_id"), ["feed_id", "trip_id"]
    ).withColumnRenamed("feed_id", "source_feed_id")
    completed = materialize(completed)
    observed = samples.metric_identities(completed)
    assessed = settled(spark, lambda: samples.accept_sequentially(observed))
    return {
        "states": states, "current": current_vehicles(states, tables["stop_times"]), "completed": completed, "observations": assessed,
        "live": metrics.live_metrics(assessed), "daily": metrics.daily_metrics(assessed),
    }


def catalog_dates(day: date) -> list[date]:
    return [day + timedelta(days=d) for d in (-1, 0, 1, 2)]


def fleet_catalog(
    states: DataFrame, tables: dict[str, DataFrame], live: DataFrame, profiles: DataFrame, at: str, day: date
) -> tuple[DataFrame, DataFrame]:
    """Remaining segments of all fresh vehicles and the candidates for them."""
    able = eta.eligible_for_eta(states, at).filter("eta_reason IS NULL").drop("eta_reason")
    # both are read many times below; stored once, they also cut the lineage
    segments = materialize(eta.remaining_segments(able, tables["stop_times"]))
    catalog = estimates.estimate_catalog(
        segments, live, profiles, tables["stop_times"], tables["trips"], tables["services"],
        tables["service_exceptions"], at, day, catalog_dates(day),
    )
    return segments, estimates.stored_catalog(catalog)


def snapshot_job(
    spark: SparkSession, states: DataFrame, tables: dict[str, DataFrame], live: DataFrame, profiles: DataFrame,
    path: str, at: str, day: date, force: bool = False,
) -> dict[str, bool]:
    """Enriched snapshots when their window is due, then planned ones for the rest.

    Both writes go through the upsert, so a rerun after a failure repeats
    them without harm.
    """
    current = read_current(spark, path)
    due = force or current is None or estimates.due_windows(current, at).first()["due"]
    if due:
        segments, catalog = fleet_catalog(states, tables, live, profiles, at, day)
        etas = eta.vehicle_eta(states, tables["stop_times"], catalog, at, segments)
        overwrite_upsert(spark, path, eta.as_snapshots(etas, states, at, "enriched"), ["vehicle_prefix"])
        current = read_current(spark, path)
    totals = shapes.shape_totals(tables["shape_segments"])
    planned = timetable.planned_segments(tables["stop_times"], tables["trips"], totals)
    baseline = eta.planned_eta_snapshot(states, current, planned, eta.trip_terminals(tables["stop_times"]), at)
    overwrite_upsert(spark, path, baseline, ["vehicle_prefix"])
    return {"enriched": bool(due), "planned": True}
