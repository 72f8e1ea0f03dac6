"""Map matching over three samples and monotone stop placement.

Candidate lists are the shape segments within 50 m of one sample, so the
arrays here are short whatever the size of the fleet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrain.functions import geo
from fleetgrain.functions.status import REDUCED_DISTANCE_M, projection_quality
from fleetgrain.functions.times import elapsed_seconds
from fleetgrain.operators.shapes import PLACED, SHAPE, candidates_of, packed_shapes
from fleetgrain.session import materialize, small_side

# Limits of the three-sample match.
MAX_GAP_SECONDS = 300
MIN_MOVEMENT_M = 20.0
MAX_ANGLE_DEGREES = 60.0
MAX_REVERSE_M = 15.0


def sample_windows(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate rows per sample packed into one window per key, oldest first.

    Rows are dealt by key first, which serves both packings.
    """
    sample_keys = [*keys, "sample_index", "sample_timestamp", "latitude", "longitude"]
    per_sample = samples.select(*sample_keys, "candidate").repartition(*keys).groupBy(*sample_keys).agg(
        F.array_sort(
            F.collect_list("candidate"),
            lambda a, b: F.when(a["progress_m"] < b["progress_m"], -1)
            .when(a["progress_m"] > b["progress_m"], 1)
            .otherwise(a["segment_sequence"] - b["segment_sequence"]),
        ).alias("candidates")
    )
    sample = F.struct(
        (-F.col("sample_index")).alias("order"), "sample_timestamp", "latitude", "longitude", "candidates"
    )
    return per_sample.groupBy(*keys).agg(F.sort_array(F.collect_list(sample)).alias("samples"))


def _extend(paths: Column, candidates: Column, bearing: Column) -> Column:
    """Best continuation per candidate: least distance so far, first on ties."""
    numbered = F.transform(paths, lambda p, i: F.struct(p["cost"].alias("cost"), i.alias("i"), p.alias("p")))

    def continued(candidate: Column) -> Column:
        reachable = F.filter(
            numbered,
            lambda n: candidate["progress_m"]
            >= F.element_at(n["p"]["steps"], -1)["progress_m"] - MAX_REVERSE_M,
        )
        best = F.array_min(reachable)["p"]
        return F.when(
            F.size(reachable) > 0,
            F.struct(
                (best["cost"] + candidate["distance_to_shape_m"]).alias("cost"),
                (best["angle"] + geo.angular_difference(candidate["bearing_degrees"], bearing)).alias("angle"),
                F.concat(best["steps"], F.array(candidate)).alias("steps"),
            ),
        )

    return F.filter(F.transform(candidates, continued), lambda p: p.isNotNull())


def match_three_samples(windows: DataFrame) -> DataFrame:
    """Adds `match_status` and, if resolved, the chosen `path` of three candidates."""
    count = F.size("samples")
    last3 = F.slice("samples", F.greatest(count - 2, F.lit(1)), 3)
    df = windows.withColumn("w", last3)

    def s(index: int) -> Column:
        return F.get(F.col("w"), F.lit(index))

    def gap(a: Column, b: Column) -> Column:
        return elapsed_seconds(b["sample_timestamp"], a["sample_timestamp"])

    bad_gap = F.lit(False)
    for first, second in ((0, 1), (1, 2)):
        seconds = gap(s(first), s(second))
        bad_gap = bad_gap | (seconds <= 0) | (seconds > MAX_GAP_SECONDS)
    ends = (s(0)["latitude"], s(0)["longitude"], s(2)["latitude"], s(2)["longitude"])
    df = (
        df.withColumn("bearing", F.when(count >= 3, geo.bearing_deg(*ends)))
        .withColumn(
            "waiting", F.coalesce(bad_gap | (geo.haversine_m(*ends) < MIN_MOVEMENT_M), F.lit(True))
        )
        .withColumn(
            "eligible",
            F.transform(
                "w",
                lambda sample: F.filter(
                    sample["candidates"],
                    lambda c: (c["distance_to_shape_m"] <= REDUCED_DISTANCE_M)
                    & (
                        geo.angular_difference(c["bearing_degrees"], F.col("bearing"))
                        <= MAX_ANGLE_DEGREES
                    ),
                ),
            ),
        )
    )
    bearing = F.col("bearing")
    opening = F.transform(
        F.get("eligible", F.lit(0)),
        lambda c: F.struct(
            c["distance_to_shape_m"].alias("cost"),
            geo.angular_difference(c["bearing_degrees"], bearing).alias("angle"),
            F.array(c).alias("steps"),
        ),
    )
    df = df.withColumn("paths", opening)
    for depth in (1, 2):
        df = df.withColumn("paths", _extend(F.col("paths"), F.get("eligible", F.lit(depth)), bearing))
    ends_at = F.array_sort(F.transform("paths", lambda p: F.element_at(p["steps"], -1)["progress_m"]))
    split = F.exists(
        F.zip_with(
            F.slice(ends_at, 1, F.greatest(F.size(ends_at) - 1, F.lit(0))),
            F.slice(ends_at, 2, F.greatest(F.size(ends_at) - 1, F.lit(0))),
            lambda a, b: b - a,
        ),
        lambda d: d > MAX_REVERSE_M,
    )
    empty = F.exists("eligible", lambda e: F.size(e) == 0) | (F.size("paths") == 0)
    status = (
        F.when(F.size(F.element_at("samples", -1)["candidates"]) == 0, "fallback_required")
        .when((count < 3) | F.col("waiting"), "collecting")
        .when(empty, "ambiguous")
        .when(split, "ambiguous")
        .otherwise("resolved")
    )
    chosen = F.array_min(
        F.transform(
            "paths",
            lambda p: F.struct(
                p["cost"].alias("cost"), p["angle"].alias("angle"),
                F.element_at(p["steps"], -1)["progress_m"].alias("progress"), p["steps"].alias("steps"),
            ),
        )
    )["steps"]
    return df.withColumn("match_status", status).select(
        *windows.columns, "match_status", F.when(F.col("match_status") == "resolved", chosen).alias("path")
    )


def resolve_positions(states: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Overwrite projection and both previous samples from the chosen path."""
    chosen = matches.select(*keys, "match_status", "path")
    joined = states.join(chosen, keys, "left")
    resolved = F.col("path").isNotNull()
    here = F.element_at("path", -1)
    new = {
        "map_match_status": F.coalesce(
            "match_status", F.col("map_match_status") if "map_match_status" in states.columns else F.lit("collecting")
        ),
        "shape_position": here["shape_position"],
        "shape_progress_m": here["progress_m"],
        "distance_to_shape_m": here["distance_to_shape_m"],
        "projected_latitude": here["projected_latitude"],
        "projected_longitude": here["projected_longitude"],
        "projection_quality": projection_quality(here["distance_to_shape_m"]),
    }
    out = joined
    for name, value in new.items():
        if name == "map_match_status":
            out = out.withColumn(name, value)
        else:
            old = F.col(name) if name in states.columns else F.lit(None)
            out = out.withColumn(name, F.when(resolved, value).otherwise(old))
    for index, back in ((1, -2), (2, -3)):
        step = F.try_element_at("path", F.lit(back))
        out = out.withColumn(
            f"previous_{index}_progress_m", F.when(resolved, step["progress_m"])
        ).withColumn(f"previous_{index}_shape_position", F.when(resolved, step["shape_position"]))
    return out.drop("match_status", "path")


CANDIDATE = ("segment_sequence", "progress_m", "shape_position", "distance_to_shape_m")


def monotone_path(windows: Column) -> Column:
    """Non-decreasing choice of one candidate per stop with least total distance.

    `windows` is an array per stop of candidate structs. Only the cheapest
    predecessor per candidate is kept, ties by its progress. Null when a stop
    has no candidate or no choice is monotone.
    """
    opening = F.transform(
        F.get(windows, F.lit(0)),
        lambda c: F.struct(
            c["distance_to_shape_m"].alias("cost"), c["progress_m"].alias("progress"), F.array(c).alias("path")
        ),
    )

    def advance(paths: Column, candidates: Column) -> Column:
        def continued(c: Column) -> Column:
            best = F.array_min(F.filter(paths, lambda p: c["progress_m"] >= p["progress"]))
            return F.when(
                best.isNotNull(),
                F.struct(
                    (best["cost"] + c["distance_to_shape_m"]).alias("cost"),
                    c["progress_m"].alias("progress"),
                    F.concat(best["path"], F.array(c)).alias("path"),
                ),
            )

        return F.filter(F.transform(candidates, continued), lambda p: p.isNotNull())

    rest = F.slice(windows, 2, F.greatest(F.size(windows) - 1, F.lit(0)))
    final = F.aggregate(rest, opening, advance)
    return F.when(F.size(windows) > 0, F.array_min(final)["path"])


def pattern_stops(distinct_patterns: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per pattern and stop ordinal with the stop's position."""
    exploded = distinct_patterns.select(
        "pattern_id", "feed_id", "shape_id", F.posexplode("stop_ids").alias("p", "stop_id")
    ).withColumn("stop_ordinal", F.col("p") + 1)
    places = small_side(materialize(stops.select("feed_id", "stop_id", "latitude", "longitude")), 80)
    return exploded.join(places, ["feed_id", "stop_id"], "left").drop("p")


_SEGMENT = (
    "segment_sequence", "start_lat", "start_lon", "end_lat", "end_lon", "start_distance_m",
    "segment_length_m", "start_fraction", "end_fraction",
)
_PATH = "array<struct<progress_m:double,segment_sequence:int,shape_position:double,distance_to_shape_m:double>>"


def _place_on_any_segment(stops: np.ndarray, seg: dict[str, np.ndarray]) -> list[dict] | None:
    """Least-distance monotone path when every segment is a candidate for every stop.

    Predecessors are scanned as a running minimum over candidates ordered by
    progress, so a stop costs C log C instead of C squared.
    """
    dx, dy = seg["end_lon"] - seg["start_lon"], seg["end_lat"] - seg["start_lat"]
    squared = dx * dx + dy * dy
    steps: list[tuple] = []
    for lat, lon in stops:
        t = np.clip(((lon - seg["start_lon"]) * dx + (lat - seg["start_lat"]) * dy) / squared, 0.0, 1.0)
        near_lat, near_lon = seg["start_lat"] + t * dy, seg["start_lon"] + t * dx
        p1, p2 = np.radians(lat), np.radians(near_lat)
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(near_lon - lon) / 2) ** 2
        distance = 2 * geo.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))
        progress = seg["start_distance_m"] + t * seg["segment_length_m"]
        cost, back = distance, np.full(len(t), -1)
        if steps:
            _, _, before, total, _ = steps[-1]
            order = np.lexsort((total, before))
            best = np.minimum.accumulate(total[order])
            first = np.maximum.accumulate(
                np.where(np.r_[True, total[order][1:] < best[:-1]], np.arange(len(order)), 0)
            )
            at = np.searchsorted(before[order], progress, side="right") - 1
            cost = np.where(at >= 0, distance + best[np.maximum(at, 0)], np.inf)
            back = np.where(at >= 0, order[first[np.maximum(at, 0)]], -1)
        steps.append((t, distance, progress, cost, back))
    last = steps[-1]
    chosen = int(np.lexsort((last[2], last[3]))[0])
    if not np.isfinite(last[3][chosen]):
        return None
    path = []
    for t, distance, progress, _, back in reversed(steps):
        share = seg["end_fraction"][chosen] - seg["start_fraction"][chosen]
        path.append(
            {
                "progress_m": float(progress[chosen]),
                "segment_sequence": int(seg["segment_sequence"][chosen]),
                "shape_position": float(seg["start_fraction"][chosen] + t[chosen] * share),
                "distance_to_shape_m": float(distance[chosen]),
            }
        )
        chosen = int(back[chosen])
    return path[::-1]


def _place_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        paths = []
        for row in frame.itertuples(index=False):
            stops = np.array([row.latitudes, row.longitudes], dtype=float).T
            placeable = row.segment_sequence is not None and not np.isnan(stops).any()
            segment = {c: np.asarray(getattr(row, c)) for c in _SEGMENT} if placeable else {}
            paths.append(_place_on_any_segment(stops, segment) if placeable else None)
        yield pd.DataFrame({"pattern_id": frame["pattern_id"], "path": paths})


def _fallback_paths(walks: DataFrame, segments: DataFrame) -> DataFrame:
    """Paths of failed walks over all segments of their shapes as arrays."""
    packed = segments.groupBy(*SHAPE).agg(
        F.sort_array(F.collect_list(F.struct(*_SEGMENT))).alias("g")
    )
    rows = walks.join(packed, SHAPE, "left").select(
        "pattern_id",
        F.col("walk.latitude").alias("latitudes"),
        F.col("walk.longitude").alias("longitudes"),
        *[F.col(f"g.{c}").alias(c) for c in _SEGMENT],
    )
    return rows.mapInPandas(_place_frames, f"pattern_id string, path {_PATH}")


def monotone_with_fallback(stops: DataFrame, segments: DataFrame) -> DataFrame:
    """Paths per pattern; patterns without one retry over every shape segment.

    A pattern walks along its shape as one row: its stops find their candidates in the
    shape they meet, so candidates are never rows of their own. Stops without candidates
    keep an empty window, which makes the path null.

    Result: pattern_id, path (null means no monotone placement), used_fallback.
    """
    ordered = F.sort_array(F.collect_list(F.struct("stop_ordinal", "latitude", "longitude")))
    walks = stops.groupBy("pattern_id", *SHAPE).agg(ordered.alias("walk"))
    order = ("progress_m", *[x for x in CANDIDATE if x != "progress_m"])

    def window(stop: Column) -> Column:
        found = candidates_of(stop["latitude"], stop["longitude"], F.col("runs"))
        slim = F.transform(found, lambda c: F.struct(*[c[x].alias(x) for x in order]))
        return F.coalesce(F.sort_array(slim), F.array().cast(_PATH))

    met = walks.join(packed_shapes(segments, PLACED).hint("merge"), SHAPE, "left")
    windows = met.withColumn("windows", F.transform("walk", window).cast(f"array<{_PATH}>"))
    path = windows.withColumn("path", monotone_path(F.col("windows")).cast(_PATH))
    first = materialize(path.select("pattern_id", *SHAPE, "path", F.when(F.col("path").isNull(), F.col("walk")).alias("walk")))
    done = first.filter("path IS NOT NULL").select("pattern_id", "path", F.lit(False).alias("used_fallback"))
    second = _fallback_paths(first.filter("path IS NULL"), segments).withColumn("used_fallback", F.lit(True))
    return done.unionByName(second)


def path_assignments(paths: DataFrame) -> DataFrame:
    """Chosen candidates as rows of the four projection columns per stop ordinal."""
    return paths.select("pattern_id", F.posexplode("path").alias("p", "c")).select(
        "pattern_id",
        (F.col("p") + 1).alias("stop_ordinal"),
        F.col("c.shape_position").alias("shape_position"),
        F.col("c.progress_m").alias("shape_progress_m"),
        F.col("c.distance_to_shape_m").alias("distance_to_shape_m"),
        projection_quality(F.col("c.distance_to_shape_m")).alias("quality"),
    )
