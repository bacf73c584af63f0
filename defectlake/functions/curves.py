"""Curves of annotations as array expressions: cubic segments, B-splines and spirals flattened to points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerance and limits of the flattening.
TOLERANCE, LEAST_STEP, MOST_STEPS = 0.35, 0.5, 400
STEPS_PER_SPAN = 16
SPIRAL_STEPS, LEAST_SPIRAL_STEPS = 72, 24


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _gap(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def _upto(n: Column) -> Column:
    """``0 .. n - 1``, empty for none."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def flatten_bezier(nodes: Column, closed: Column, tolerance: float = TOLERANCE) -> Column:
    """Points of a chain of cubic segments.

    ``nodes`` is ``array<struct<p, hin, hout>>`` of points; a null handle lies on its node. A segment is cut into as many
    steps as its control polygon holds four tolerances, 400 at most. A closed chain returns to its first node without repeating it.
    """
    count = F.size(nodes)

    def segment(i: Column) -> Column:
        here, there = F.get(nodes, i), F.get(nodes, (i + 1) % count)
        a, d = here["p"], there["p"]
        control = F.array(F.struct(a.alias("a"), F.coalesce(here["hout"], a).alias("b"), F.coalesce(there["hin"], d).alias("c"), d.alias("d")))
        # The control polygon and its number of steps are computed once and then shared by all points.
        sized = F.transform(control, lambda q: F.struct(*[q[k].alias(k) for k in "abcd"], steps(q).alias("n")))
        places = lambda q: F.transform(F.sequence(F.lit(1), q["n"]), lambda k: k / q["n"])
        return F.flatten(F.transform(sized, lambda q: F.transform(places(q), lambda t: at(q, t))))

    def steps(q: Column) -> Column:
        length = _gap(q["a"], q["b"]) + _gap(q["b"], q["c"]) + _gap(q["c"], q["d"])
        return F.greatest(F.lit(1), F.least(F.lit(MOST_STEPS), F.ceil(length / max(LEAST_STEP, tolerance * 4)))).cast("int")

    def at(q: Column, t: Column) -> Column:
        u = 1 - t
        value = lambda axis: u * u * u * q["a"][axis] + 3 * u * u * t * q["b"][axis] + 3 * u * t * t * q["c"][axis] + t * t * t * q["d"][axis]
        return _point(value("x"), value("y"))

    drawn = F.concat(F.slice(F.transform(nodes, lambda n: n["p"]), 1, 1), F.flatten(F.transform(_upto(F.when(closed, count).otherwise(count - 1)), segment)))
    return F.when(closed & (count > 0), F.slice(drawn, 1, F.greatest(F.size(drawn) - 1, F.lit(0)))).otherwise(drawn)


def flatten_bspline(control: Column, closed: Column, steps: int = STEPS_PER_SPAN) -> Column:
    """Points of a uniform cubic B-spline; an open one repeats its ends, so that it touches them. Fewer than three points stay."""
    first, last = F.slice(control, 1, 1), F.slice(control, -1, 1)
    padded = F.when(closed, control).otherwise(F.concat(first, first, control, last, last))
    size = F.size(padded)
    spans = F.when(closed, size).otherwise(size - 3)

    def span(i: Column) -> Column:
        p = [F.get(padded, (i + k) % size) for k in range(4)]

        def at(k: Column) -> Column:
            t = k / F.lit(float(steps))
            t2, t3 = t * t, t * t * t
            b = [(1 - 3 * t + 3 * t2 - t3) / 6, (4 - 6 * t2 + 3 * t3) / 6, (1 + 3 * t + 3 * t2 - 3 * t3) / 6, t3 / 6]
            value = lambda axis: b[0] * p[0][axis] + b[1] * p[1][axis] + b[2] * p[2][axis] + b[3] * p[3][axis]
            return _point(value("x"), value("y"))

        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), at)

    drawn = F.flatten(F.transform(_upto(spans), span))
    return F.when(F.size(control) < 3, control).when(closed, drawn).otherwise(F.concat(drawn, last))


def spiral_points(center: Column, radius: Column, angle: Column, turns: Column, power: Column, start: Column) -> Column:
    """Points of a spiral from its inner parameter ``start`` outwards: radius ``radius * t ** power``, 72 steps a turn and 24 at least."""
    n = F.greatest(F.lit(LEAST_SPIRAL_STEPS), F.ceil(turns * SPIRAL_STEPS)).cast("int")

    def at(k: Column) -> Column:
        t = start + (1 - start) * k / n
        r, theta = radius * F.pow(t, power), angle - 2 * math.pi * turns * (1 - t)
        return _point(center["x"] + r * F.cos(theta), center["y"] + r * F.sin(theta))

    return F.transform(F.sequence(F.lit(0), n), at)


def rounded(points: Column, digits: int = 2) -> Column:
    """Points as annotations store them."""
    return F.transform(points, lambda p: _point(F.round(p["x"], digits), F.round(p["y"], digits)))


def rebuilt(kind: Column, nodes: Column, control: Column, spiral: Column, closed: Column, points: Column) -> Column:
    """The stored polyline of an annotation whose curve was drawn or edited; without a curve its points stay."""
    s = spiral
    drawn = F.when(kind == "bezier", flatten_bezier(nodes, closed)).when(kind == "bspline", flatten_bspline(control, closed))
    drawn = drawn.when(kind == "spiral", spiral_points(s["center"], s["radius"], s["arg"], s["turns"], s["exp"], s["t0"])).otherwise(points)
    return F.when(kind.isNull(), points).otherwise(rounded(drawn))
