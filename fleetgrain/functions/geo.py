"""Geodesy on plain doubles: WGS84 degrees in, metres out.

Lengths are great-circle on a sphere; nearest points and line fractions are
planar in degrees, as geometry functions on longitude/latitude treat them.
A point is STRUCT<lon, lat>, a line an ARRAY of points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgrain.functions.binding import let

EARTH_RADIUS_M = 6_371_008.8
LINE_TYPE = "array<struct<lon:double,lat:double>>"
SIMPLIFY_TOLERANCE = 0.00003


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (p2 - p1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    p1, p2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angular_difference(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def planar_azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(lon2 - lon1, lat2 - lat1)), F.lit(360.0))


def segment_fraction(
    lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column
) -> Column:
    """Planar fraction of the nearest point on a segment, clamped to 0..1."""
    dx, dy = lon2 - lon1, lat2 - lat1
    squared = dx * dx + dy * dy
    along = ((lon - lon1) * dx + (lat - lat1) * dy) / squared
    return F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))).otherwise(F.lit(0.0))


def planar_distance(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lon2 - lon) * (lon2 - lon) + (lat2 - lat) * (lat2 - lat))


def project_on_segment(lat: Column, lon: Column, segment: Column | None = None) -> Column:
    """Projection of a point on a shape segment, the row's own by default, as one struct."""

    def field(name: str) -> Column:
        return F.col(name) if segment is None else segment[name]

    def at(fraction: Column) -> Column:
        near_lat = field("start_lat") + fraction * (field("end_lat") - field("start_lat"))
        near_lon = field("start_lon") + fraction * (field("end_lon") - field("start_lon"))
        return F.struct(
            field("segment_sequence").alias("segment_sequence"),
            (field("start_distance_m") + fraction * field("segment_length_m")).alias("progress_m"),
            (
                field("start_fraction") + fraction * (field("end_fraction") - field("start_fraction"))
            ).alias("shape_position"),
            haversine_m(lat, lon, near_lat, near_lon).alias("distance_to_shape_m"),
            field("bearing_degrees").alias("bearing_degrees"),
            near_lat.alias("projected_latitude"),
            near_lon.alias("projected_longitude"),
            fraction.alias("segment_fraction"),
        )

    found = segment_fraction(
        lat, lon, field("start_lat"), field("start_lon"), field("end_lat"), field("end_lon")
    )
    return at(found) if segment is None else let(found, at)


def _leg(a: Column, b: Column) -> Column:
    x = (b["lon"] - a["lon"]) * F.cos(F.radians((a["lat"] + b["lat"]) / 2))
    y = b["lat"] - a["lat"]
    return F.sqrt(x * x + y * y)


def line_slice(points: Column, first: Column, second: Column) -> Column:
    """Sub-line between two fractions, in either order, with interpolated ends."""
    low = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(first, second)))
    high = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(first, second)))
    legs = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b"), _leg(a, b).alias("length")),
    )
    empty = F.array().cast(LINE_TYPE)

    def at(leg: Column, travelled: Column, target: Column) -> Column:
        ratio = F.when(leg["length"] > 0, (target - travelled) / leg["length"]).otherwise(F.lit(0.0))
        return F.struct(
            (leg["a"]["lon"] + (leg["b"]["lon"] - leg["a"]["lon"]) * ratio).alias("lon"),
            (leg["a"]["lat"] + (leg["b"]["lat"] - leg["a"]["lat"]) * ratio).alias("lat"),
        )

    def cut(line: Column) -> Column:
        """`line` holds the legs and the two target distances along them."""

        def step(state: Column, leg: Column) -> Column:
            travelled = state["travelled"]
            end, index = travelled + leg["length"], state["index"] + 1
            last = index == F.size(line["legs"])
            starts = ~state["started"] & ((end >= line["from"]) | last)
            started = state["started"] | starts
            ends = started & ~state["done"] & ((end >= line["to"]) | last)
            opened = F.when(starts, F.array(at(leg, travelled, line["from"]))).otherwise(empty)
            inner = (
                F.when(ends, F.array(at(leg, travelled, line["to"])))
                .when(started & ~state["done"], F.array(leg["b"]))
                .otherwise(empty)
            )
            return F.struct(
                end.alias("travelled"), index.alias("index"), started.alias("started"),
                (state["done"] | ends).alias("done"),
                F.concat(state["line"], opened, inner).alias("line"),
            )

        start = F.struct(
            F.lit(0.0).alias("travelled"), F.lit(0).alias("index"), F.lit(False).alias("started"),
            F.lit(False).alias("done"), empty.alias("line"),
        )
        return F.aggregate(line["legs"], start, step, lambda s: s["line"])

    def measured(legs_: Column) -> Column:
        total = F.aggregate(legs_, F.lit(0.0), lambda acc, leg: acc + leg["length"])
        return let(
            total,
            lambda t: F.struct(legs_.alias("legs"), (t * low).alias("from"), (t * high).alias("to")),
        )

    sliced = let(let(legs, measured), cut)
    return F.when(F.size(points) < 2, points).otherwise(sliced)


def split_line(points: Column, fraction: Column) -> Column:
    return F.struct(
        line_slice(points, F.lit(0.0), fraction).alias("completed"),
        line_slice(points, fraction, F.lit(1.0)).alias("remaining"),
    )


def _kept_vertices(xy: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    pending = [(0, len(xy) - 1)]
    while pending:
        lo, hi = pending.pop()
        if hi - lo < 2:
            continue
        a, d = xy[lo], xy[hi] - xy[lo]
        rel = xy[lo + 1 : hi] - a
        norm = float(d @ d)
        t = np.clip(rel @ d / norm, 0.0, 1.0) if norm > 0 else np.zeros(len(rel))
        gap = np.hypot(*(rel - t[:, None] * d).T)
        worst = int(gap.argmax())
        if gap[worst] > tolerance:
            middle = lo + 1 + worst
            keep[middle] = True
            pending += [(lo, middle), (middle, hi)]
    return keep


def simplify_line(points: Column, tolerance: float = SIMPLIFY_TOLERANCE) -> Column:
    """Drop vertices closer than the tolerance to the simplified line."""

    @F.pandas_udf(LINE_TYPE)
    def simplify(lines: pd.Series) -> pd.Series:
        def one(line):
            if line is None or len(line) < 3:
                return line
            xy = np.array([(p["lon"], p["lat"]) for p in line], dtype=float)
            return [p for p, kept in zip(line, _kept_vertices(xy, tolerance)) if kept]

        return lines.map(one)

    return simplify(points)


def line_geojson(points: Column, digits: int = 6) -> Column:
    """GeoJSON LineString text."""
    coordinates = F.transform(
        points, lambda p: F.array(F.round(p["lon"], digits), F.round(p["lat"], digits))
    )
    return F.to_json(F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")))


def point_geojson(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
