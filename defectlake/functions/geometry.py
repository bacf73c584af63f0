"""Plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.greatest(low, F.least(high, value))


def half_up(value: Column) -> Column:
    """Nearest integer, halves upward."""
    return F.floor(value + 0.5).cast("long")


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two corner boxes ``[x1, y1, x2, y2]``; 0 when neither has an area."""
    inter = box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = box_area(*a) + box_area(*b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def points_array(xs: Column, ys: Column) -> Column:
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def _next(points: Column) -> Column:
    """The ring rotated by one: element i holds the successor of vertex i."""
    return F.when(F.size(points) > 0, F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))).otherwise(points)


def polygon_area(points: Column) -> Column:
    """Shoelace area of ``array<struct<x,y>>``; 0 below three vertices."""
    terms = F.zip_with(points, _next(points), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(total) / 2)


def bounding_box(points: Column, pad: Column) -> Column:
    xs, ys = points["x"], points["y"]
    x0, y0 = F.array_min(xs) - pad, F.array_min(ys) - pad
    return F.struct(x0.alias("x"), y0.alias("y"), (F.array_max(xs) + pad - x0).alias("w"),
                    (F.array_max(ys) + pad - y0).alias("h"))


def line_to_quad(points: Column, width: Column) -> Column:
    """Quadrilateral of ``width`` around the chord from the first to the last vertex (a square if both coincide)."""
    a, b = points[0], F.element_at(points, -1)
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = F.hypot(dx, dy)
    half = F.greatest(F.lit(1.0), width / 2)
    nx, ny = -dy / F.nullif(length, F.lit(0.0)) * half, dx / F.nullif(length, F.lit(0.0)) * half

    def vertex(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    square = F.array(vertex(a["x"] - half, a["y"] - half), vertex(a["x"] + half, a["y"] - half),
                     vertex(a["x"] + half, a["y"] + half), vertex(a["x"] - half, a["y"] + half))
    quad = F.array(vertex(a["x"] + nx, a["y"] + ny), vertex(b["x"] + nx, b["y"] + ny),
                   vertex(b["x"] - nx, b["y"] - ny), vertex(a["x"] - nx, a["y"] - ny))
    return F.when(F.size(points) < 2, points).when(length <= 1e-6, square).otherwise(quad)


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd test against ``array<struct<x,y>>``; false below three vertices."""
    def crosses(p, q):
        dy = q["y"] - p["y"]
        straddles = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(dy == 0, F.lit(1e-12)).otherwise(dy) + p["x"]
        return F.when(straddles & (x < at), F.lit(1)).otherwise(F.lit(0))

    hits = F.aggregate(F.zip_with(points, _next(points), crosses), F.lit(0), lambda acc, t: acc + t)
    return F.when(F.size(points) < 3, F.lit(False)).otherwise(hits % 2 == 1)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = clamp(((px - ax) * dx + (py - ay) * dy) / F.nullif(l2, F.lit(0.0)), 0, 1)
    return F.when(l2 <= 1e-12, F.hypot(px - ax, py - ay)).otherwise(F.hypot(px - (ax + t * dx), py - (ay + t * dy)))


def near_polyline(x: Column, y: Column, points: Column, width: Column) -> Column:
    """Whether a point lies within ``max(1.5, width/2 + 1)`` of a polyline."""
    limit = F.greatest(F.lit(1.5), F.coalesce(width, F.lit(1.0)) / 2 + 1)
    ends = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    starts = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    near = F.zip_with(starts, ends, lambda p, q: segment_distance(x, y, p["x"], p["y"], q["x"], q["y"]) <= limit)
    return (F.size(points) >= 2) & F.exists(near, lambda hit: hit)


def record_contains(x: Column, y: Column, points: Column, closed: Column, width: Column) -> Column:
    return F.when(closed, point_in_polygon(x, y, points)).otherwise(near_polyline(x, y, points, width))


def round_scaled(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` decimals as SQL engines do on doubles: scaled, halves away from zero, scaled back.

    ``F.round`` rounds the decimal digits a double prints instead, which differs where scaling moves a value off a half.
    """
    scale = F.lit(float(10 ** digits))
    return F.round(value * scale, 0) / scale
