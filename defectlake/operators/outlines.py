"""Outlines of labelled regions: border following in tiles, chains stitched to rings across them.

An outline runs along pixel sides with the region on its right. Each side has one successor, told by the pixels around its
end, so that following needs one pixel of the neighbouring tiles at most. A tile returns closed rings and open chains; the
chains of a ring find their common name and their order by pointer doubling, in as many joins as the logarithm of their number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from .components import STRIDE, TILE

# Sides of a pixel in the order in which an outline turns right: top, right, bottom, left, with steps (dy, dx) along them.
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))
# Corner at which a side starts, from the pixel's own corner.
CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
POINTS = T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))


def _chains(pixels: np.ndarray, own: np.ndarray, y0: int, x0: int, conn: int) -> list[tuple]:
    """Chains of the sides of own pixels in an array with a margin of one: (first side, side after the last, closed, sides, twice the area, corners)."""
    h, w = pixels.shape
    after: dict[int, int] = {}
    for side, (dy, dx) in enumerate(STEPS):
        ly, lx = STEPS[side - 1]  # to the left of the direction
        ys, xs = np.nonzero(own)
        free = ~pixels[ys + ly, xs + lx]
        ys, xs = ys[free], xs[free]
        right = pixels[ys + dy, xs + dx]
        left = pixels[ys + dy + ly, xs + dx + lx] & (right if conn == 4 else True)
        ny = np.where(left, ys + dy + ly, np.where(right, ys + dy, ys))
        nx = np.where(left, xs + dx + lx, np.where(right, xs + dx, xs))
        turn = np.where(left, (side + 3) % 4, np.where(right, side, (side + 1) % 4))
        after.update(zip(((ys * w + xs) * 4 + side).tolist(), ((ny * w + nx) * 4 + turn).tolist()))
    name = lambda s: (s // 4 // w + y0) * STRIDE * 4 + (s // 4 % w + x0) * 4 + s % 4
    heads = sorted(set(after) - set(after.values()))
    out, seen = [], set()
    for head in [*heads, *sorted(after)]:
        if head in seen:
            continue
        side, sides, area, corners, before = head, 0, 0, [], None
        while side in after and side not in seen:
            seen.add(side)
            if side % 4 != before:
                oy, ox = CORNERS[side % 4]
                corners.append((side // 4 // w + y0 + oy, side // 4 % w + x0 + ox))
            dy, dx = STEPS[side % 4]
            cy, cx = side // 4 // w + y0 + CORNERS[side % 4][0], side // 4 % w + x0 + CORNERS[side % 4][1]
            area += cx * dy - cy * dx
            before, side, sides = side % 4, after[side], sides + 1
        closed = side == head
        if closed and len(corners) > 1 and before == head % 4:
            corners = corners[1:]  # the ring starts inside a straight line
        out.append((name(head), name(side), closed, sides, area, corners, head % 4, before))
    return out


def region_outlines(labels: DataFrame, keys: Sequence[str], conn: int = 8, tile: int = TILE) -> DataFrame:
    """Rings of every labelled region: ``(keys, label, ring, hole, sides, area, points)``.

    ``labels`` (``keys, y, x, label``) comes from :func:`.components.label_components` with the same ``conn``. ``points`` are
    the corners of the ring in pixel coordinates, from its smallest chain on; the outer ring runs clockwise on the screen. ``area``
    is that inside the ring, negative for holes, so that the rings of a label sum to its pixels.
    """
    keys = list(keys)
    rows = labels.select(*keys, "label", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    near = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: d)
    tiles = lambda a: F.array_distinct(F.transform(near, lambda d: F.floor((F.col(a) + d) / tile).cast("long")))
    dealt = rows.withColumn("_ty", F.explode(tiles("y"))).withColumn("_tx", F.explode(tiles("x")))

    def local(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(part["_ty"].iloc[0]) * tile - 1, int(part["_tx"].iloc[0]) * tile - 1
        # Regions of one labelling share no side, and corners only where the successor stays with its own region.
        label = np.zeros((tile + 2, tile + 2), dtype=np.int64)
        label[part["y"] - y0, part["x"] - x0] = part["label"]
        pixels = np.zeros(label.shape, dtype=bool)
        pixels[part["y"] - y0, part["x"] - x0] = True
        inner = np.zeros_like(pixels)
        inner[1:-1, 1:-1] = pixels[1:-1, 1:-1]
        out, mask = [], [part[k].iloc[0] for k in keys]
        for head, tail, closed, sides, area, corners, first, last in _chains(pixels, inner, y0, x0, conn):
            own = label[head // 4 // STRIDE - y0, head // 4 % STRIDE - x0]
            out.append((*mask, own, head, tail, closed, sides, area, first, last, [{"x": x, "y": y} for y, x in corners]))
        return pd.DataFrame(out, columns=[f.name for f in schema])

    schema = T.StructType([*[rows.schema[k] for k in [*keys, "label"]], *[T.StructField(n, t) for n, t in (
        ("head", T.LongType()), ("tail", T.LongType()), ("closed", T.BooleanType()), ("sides", T.LongType()), ("area", T.LongType()), ("first", T.LongType()), ("last", T.LongType()), ("points", POINTS))]])
    chains = checkpoint(dealt.groupBy(*keys, "_ty", "_tx").applyInPandas(local, schema))
    whole = chains.where("closed").select(*keys, "label", F.col("head").alias("ring"), "sides", "area", "points")
    open_ = chains.where("not closed")
    rings = whole if open_.isEmpty() else whole.unionByName(_stitched(open_, keys))
    return rings.select(*keys, "label", "ring", (F.col("area") < 0).alias("hole"), "sides", (F.col("area") / 2).cast("long").alias("area"), "points")


def _stitched(chains: DataFrame, keys: list[str]) -> DataFrame:
    own = [*keys, "label"]
    # The least head of a ring: each round looks twice as far ahead.
    state = checkpoint(chains.select(*own, "head", F.col("tail").alias("next"), F.col("head").alias("ring")))
    while True:
        ahead = state.select(*own, F.col("head").alias("next"), F.col("next").alias("next2"), F.col("ring").alias("ring2"))
        moved = checkpoint(state.join(ahead, [*own, "next"]).select(*own, "head", F.col("next2").alias("next"), F.least("ring", "ring2").alias("ring"), F.col("ring").alias("old")))
        state = moved.drop("old")
        if moved.where("ring <> old").isEmpty():
            break
    # Rank: chains from here to the end of the ring, which is cut before its first chain.
    named = checkpoint(chains.join(state.select(*own, "head", "ring"), [*own, "head"]))
    rank = named.select(*own, "head", F.when(F.col("tail") != F.col("ring"), F.col("tail")).alias("next"), F.lit(1).cast("long").alias("left"))
    rank = checkpoint(rank)
    while not rank.where("next is not null").isEmpty():
        ahead = rank.select(*own, F.col("head").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        rank = checkpoint(rank.join(ahead, [*own, "next"], "left").select(*own, "head", F.col("next2").alias("next"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
    parts = named.join(rank.select(*own, "head", "left"), [*own, "head"])
    # A chain that goes straight on from the one before has no corner at its start.
    before = named.select(*own, F.col("tail").alias("head"), F.col("last").alias("came"))
    parts = parts.join(before, [*own, "head"]).withColumn("points", F.when(F.col("came") == F.col("first"), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0)))).otherwise(F.col("points")))
    packed = parts.groupBy(*own, "ring").agg(F.sum("sides").alias("sides"), F.sum("area").alias("area"), F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("o"), "points"))).alias("p"))
    return packed.select(*own, "ring", "sides", "area", F.flatten("p.points").alias("points"))


def outline_summary(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rings, holes, sides, corners and pixels of every region."""
    return rings.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("rings"), F.count_if("hole").alias("holes"), F.sum("sides").alias("sides"), F.sum(F.size("points")).alias("corners"), F.sum("area").alias("pixels"))
