"""Shape geometry: lines, segments and projection of points on shapes.

A point meets its shape once, as one row of runs of consecutive segments, each run
with a box around it. It looks into the runs whose box is near and never at every
segment of its shape, and no pair of a point and a segment is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.functions import geo
from fleetgrain.functions.binding import let
from fleetgrain.functions.status import REDUCED_DISTANCE_M, projection_quality

SHAPE = ["feed_id", "shape_id"]
BOX_DEGREES = 0.001
CHUNK = 64


def assemble_lines(points: DataFrame) -> DataFrame:
    """One ordered line per shape; shapes need at least two points."""
    vertex = F.struct("sequence", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    lines = points.groupBy(*SHAPE).agg(
        F.sort_array(F.collect_list(vertex)).alias("v"), F.count("*").alias("point_count")
    )
    return lines.filter("point_count >= 2").select(
        *SHAPE,
        F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"),
        "point_count",
    )


def shape_segments(points: DataFrame) -> DataFrame:
    """Consecutive distinct points with lengths, running distance and fractions."""
    order = Window.partitionBy(*SHAPE).orderBy("sequence")
    before = Window.partitionBy(*SHAPE).orderBy("segment_sequence").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*SHAPE)
    pairs = points.select(
        *SHAPE,
        F.col("sequence").alias("segment_sequence"),
        F.col("latitude").alias("start_lat"),
        F.col("longitude").alias("start_lon"),
        F.lead("latitude").over(order).alias("end_lat"),
        F.lead("longitude").over(order).alias("end_lon"),
    ).filter(
        F.col("end_lat").isNotNull()
        & F.col("end_lon").isNotNull()
        & ~((F.col("start_lat") == F.col("end_lat")) & (F.col("start_lon") == F.col("end_lon")))
    )
    ends = (F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"))
    measured = pairs.select(
        "*",
        geo.haversine_m(*ends).alias("segment_length_m"),
        geo.planar_distance(*ends).alias("planar_length"),
        geo.planar_azimuth(*ends).alias("bearing_degrees"),
    )
    placed = measured.select(
        "*",
        F.coalesce(F.sum("segment_length_m").over(before), F.lit(0.0)).alias("start_distance_m"),
        F.sum("segment_length_m").over(whole).alias("total_m"),
        F.coalesce(F.sum("planar_length").over(before), F.lit(0.0)).alias("planar_start"),
        F.sum("planar_length").over(whole).alias("planar_total"),
    ).filter("total_m > 0")
    end_m = F.col("start_distance_m") + F.col("segment_length_m")
    return placed.select(
        *SHAPE,
        "segment_sequence", "start_lat", "start_lon", "end_lat", "end_lon",
        "segment_length_m", "start_distance_m",
        end_m.alias("end_distance_m"),
        (F.col("start_distance_m") / F.col("total_m")).alias("start_fraction"),
        (end_m / F.col("total_m")).alias("end_fraction"),
        "bearing_degrees",
        (F.col("planar_start") / F.col("planar_total")).alias("planar_start_fraction"),
        ((F.col("planar_start") + F.col("planar_length")) / F.col("planar_total")).alias(
            "planar_end_fraction"
        ),
        "total_m",
    )


def shape_totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*SHAPE).agg(F.max("end_distance_m").alias("shape_total_m"))


PLACED = (
    "segment_sequence", "start_lat", "start_lon", "end_lat", "end_lon", "start_distance_m",
    "segment_length_m", "start_fraction", "end_fraction", "bearing_degrees",
)
_PLANAR = ("planar_start_fraction", "planar_end_fraction", "total_m")


def packed_shapes(segments: DataFrame, fields: Sequence[str] = (*PLACED, *_PLANAR)) -> DataFrame:
    """One row per shape: runs of consecutive segments, each with its box and a vertex.

    Segments are shuffled once at most, not at all where they lie by shape already: they
    are gathered by shape and cut into runs there. `fields` begin with the sequence.
    """

    def run(part: Column, i: Column) -> Column:
        def least(a: str, b: str) -> Column:
            return F.array_min(F.transform(part, lambda s: F.least(s[a], s[b])))

        def greatest(a: str, b: str) -> Column:
            return F.array_max(F.transform(part, lambda s: F.greatest(s[a], s[b])))

        first = F.element_at(part, 1)
        return F.struct(
            i.alias("run"), least("start_lon", "end_lon").alias("west"), greatest("start_lon", "end_lon").alias("east"),
            least("start_lat", "end_lat").alias("south"), greatest("start_lat", "end_lat").alias("north"),
            F.struct(first["start_lat"].alias("start_lat"), first["start_lon"].alias("start_lon")).alias("vertex"),
            part.alias("segments"),
        )

    gathered = segments.groupBy(*SHAPE).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_all"))
    number = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / CHUNK).cast("int"))
    runs = F.transform(number, lambda i: let(F.slice("_all", i * CHUNK + 1, CHUNK), lambda part: run(part, i)))
    return gathered.select(*SHAPE, runs.alias("runs"))


def _on_shape(points: DataFrame, packed: DataFrame, how: str) -> DataFrame:
    """Points with the runs of their shape.

    Points outnumber shapes, and a side may look small that steps have multiplied, so
    neither is sent whole to everyone.
    """
    return points.join(packed.hint("merge"), SHAPE, how)


def _in_boxes(lat: Column, lon: Column, runs: Column) -> Column:
    """Segments whose padded box holds the point, found by way of the boxes of runs."""
    m = BOX_DEGREES

    def of_run(r: Column) -> Column:
        return (lon >= r["west"] - m) & (lon <= r["east"] + m) & (lat >= r["south"] - m) & (lat <= r["north"] + m)

    def of_segment(s: Column) -> Column:
        return (
            (lon >= F.least(s["start_lon"], s["end_lon"]) - m)
            & (lon <= F.greatest(s["start_lon"], s["end_lon"]) + m)
            & (lat >= F.least(s["start_lat"], s["end_lat"]) - m)
            & (lat <= F.greatest(s["start_lat"], s["end_lat"]) + m)
        )

    return F.flatten(F.transform(F.filter(runs, of_run), lambda r: F.filter(r["segments"], of_segment)))


def _in_reach(lat: Column, lon: Column, runs: Column) -> Column:
    """Segments that can be the nearest: of runs no farther than the nearest known vertex."""

    def lower(r: Column) -> Column:
        dx = F.greatest(F.lit(0.0), r["west"] - lon, lon - r["east"])
        dy = F.greatest(F.lit(0.0), r["south"] - lat, lat - r["north"])
        return F.sqrt(dx * dx + dy * dy)

    upper = F.array_min(
        F.transform(runs, lambda r: geo.planar_distance(lat, lon, r["vertex"]["start_lat"], r["vertex"]["start_lon"]))
    )
    return let(upper, lambda reach: F.flatten(F.transform(F.filter(runs, lambda r: lower(r) <= reach), lambda r: r["segments"])))


def _measured(lat: Column, lon: Column, segments: Column, planar: bool = True) -> Column:
    """Projections by planar distance, then by segment order."""

    def one(s: Column) -> Column:
        def placed(candidate: Column) -> Column:
            distance = geo.planar_distance(lat, lon, candidate["projected_latitude"], candidate["projected_longitude"])
            along = (
                (s["planar_start_fraction"] + candidate["segment_fraction"] * (s["planar_end_fraction"] - s["planar_start_fraction"])).alias("planar_position"),
                s["total_m"].alias("total_m"),
            )
            return F.struct(
                distance.alias("planar_distance"), s["segment_sequence"].alias("segment_sequence"),
                candidate.alias("candidate"), *(along if planar else ()),
            )

        return let(geo.project_on_segment(lat, lon, s), placed)

    return F.transform(segments, one)


def nearby_segments(
    points: DataFrame, segments: DataFrame, keys: list[str], max_m: float = REDUCED_DISTANCE_M
) -> DataFrame:
    """Candidates within `max_m` on the point's own shape; unmatched points stay.

    A point meets its shape once and finds its segments in that row, so only the points
    are shuffled.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    near = _in_boxes(lat, lon, F.col("runs"))
    found = F.filter(
        F.transform(near, lambda s: geo.project_on_segment(lat, lon, s)), lambda c: c["distance_to_shape_m"] <= max_m
    )
    met = _on_shape(points, packed_shapes(segments, PLACED), "left")
    return met.select(*[F.col(c) for c in points.columns], F.explode_outer(found).alias("candidate"))


def _located(points: DataFrame) -> DataFrame:
    return points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def nearest_segment(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest segment of the point's shape, however far it is.

    The padded boxes answer every point within their padding exactly; only for points
    farther away are the runs in reach searched.
    """
    slim = _located(points.select(*keys, *SHAPE, "latitude", "longitude"))
    lat, lon, runs = F.col("latitude"), F.col("longitude"), F.col("runs")
    met = _on_shape(slim, packed_shapes(segments), "inner")
    near = met.withColumn("_near", F.array_min(_measured(lat, lon, _in_boxes(lat, lon, runs))))
    close = F.coalesce(F.col("_near.planar_distance") <= BOX_DEGREES, F.lit(False))
    best = near.withColumn(
        "_best", F.when(close, F.col("_near")).otherwise(F.array_min(_measured(lat, lon, _in_reach(lat, lon, runs))))
    )
    nearest = F.struct(
        F.col("_best.candidate"), F.col("_best.planar_distance"), F.col("_best.planar_position"), F.col("_best.total_m")
    )
    return best.where("_best IS NOT NULL").select(*keys, nearest.alias("nearest"))


def project_on_shape(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-line nearest point with position, progress, distance and quality."""
    nearest = nearest_segment(points, segments, keys)
    position = F.col("nearest.planar_position")
    distance = F.col("nearest.candidate.distance_to_shape_m")
    return nearest.select(
        *keys,
        position.alias("shape_position"),
        (position * F.col("nearest.total_m")).alias("shape_progress_m"),
        distance.alias("distance_to_shape_m"),
        projection_quality(distance).alias("projection_quality"),
        F.col("nearest.candidate.projected_latitude").alias("projected_latitude"),
        F.col("nearest.candidate.projected_longitude").alias("projected_longitude"),
    )


def candidates_of(lat: Column, lon: Column, runs: Column) -> Column:
    """Candidates of a point on one shape: those within 50 m and the nearest one, without repeats."""

    def chosen(near: Column) -> Column:
        def kept(first: Column) -> Column:
            return F.filter(
                near,
                lambda x: (x["segment_sequence"] == first["segment_sequence"]) | (x["candidate"]["distance_to_shape_m"] <= REDUCED_DISTANCE_M),
            )

        return let(F.array_min(near), kept)

    near = F.filter(_measured(lat, lon, _in_boxes(lat, lon, runs), planar=False), lambda x: x["planar_distance"] <= BOX_DEGREES)
    far = F.array(F.array_min(_measured(lat, lon, _in_reach(lat, lon, runs), planar=False)))
    either = let(near, lambda n: F.when(F.size(n) > 0, chosen(n)).otherwise(far))
    known = lat.isNotNull() & lon.isNotNull() & runs.isNotNull()
    return F.when(known, F.transform(F.filter(either, lambda x: x.isNotNull()), lambda x: x["candidate"]))


def candidate_union(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Nearby candidates plus the nearest one, without repeats."""
    slim = _located(points.select(*keys, *SHAPE, "latitude", "longitude"))
    met = _on_shape(slim, packed_shapes(segments, PLACED), "inner")
    found = candidates_of(F.col("latitude"), F.col("longitude"), F.col("runs"))
    return met.select(*keys, F.explode(found).alias("candidate"))


PROGRESS_BUCKET_M = 500.0


def segment_at_progress(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Bearing of the segment holding a progress, else of the nearest end.

    Segments of a shape tile its length without gaps, so a progress clamped to
    that length always lies in a segment; the lower sequence wins on a joint.
    Both sides meet in 500 m buckets of progress.
    """
    totals = shape_totals(segments)
    reach = points.select(*keys, *SHAPE, "shape_progress_m").join(totals, SHAPE)
    clamped = F.greatest(F.lit(0.0), F.least(F.col("shape_progress_m"), F.col("shape_total_m")))
    probes = reach.filter("shape_progress_m IS NOT NULL").select(
        *keys, *SHAPE, clamped.alias("progress"),
        F.floor(clamped / PROGRESS_BUCKET_M).alias("bucket"),
    )
    tiles = segments.select(
        *SHAPE, "segment_sequence", "start_distance_m", "end_distance_m", "bearing_degrees",
        F.explode(
            F.sequence(
                F.floor(F.col("start_distance_m") / PROGRESS_BUCKET_M),
                F.floor(F.col("end_distance_m") / PROGRESS_BUCKET_M),
            )
        ).alias("bucket"),
    )
    held = probes.join(tiles, [*SHAPE, "bucket"]).filter(
        F.col("progress").between(F.col("start_distance_m"), F.col("end_distance_m"))
    )
    best = held.groupBy(*keys).agg(
        F.min_by("bearing_degrees", "segment_sequence").alias("route_bearing_degrees")
    )
    return points.join(best, keys, "left")


def progress_clusters(df: DataFrame, keys: list[str], gap_m: float = 15.0) -> DataFrame:
    """Number runs of progress values split where the gap exceeds `gap_m`."""
    order = Window.partitionBy(*keys).orderBy("progress_m")
    split = (F.col("progress_m") - F.lag("progress_m").over(order) > gap_m).cast("int")
    flagged = df.withColumn("_split", F.coalesce(split, F.lit(0)))
    return flagged.withColumn(
        "cluster", F.sum("_split").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_split")
