"""Connected components of sparse pixel masks and their geometry."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, checkpoint
from .spatial import tasks_for

STRIDE = 1 << 31  # label = y * STRIDE + x of the first pixel in scan order; pixel coordinates are 32-bit numbers
TILE = 256


def _neighbour_steps(conn: int) -> list[tuple[int, int]]:
    return [(0, 1), (1, 0), *([(1, 1), (1, -1)] if conn == 8 else [])]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable node per node, by vectorised hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
    return root


def tiled(rows: DataFrame, keys: Sequence[str], reach: int, tile: int = TILE, tasks: int | None = None) -> DataFrame:
    """Pixels in every tile (``_ty``, ``_tx``) that they lie in or within ``reach`` of, each tile in one task after one shuffle.

    Steps of that reach in all, taken by tile, are exact for the pixels that lie in it, which :func:`home` keeps.
    """
    at = lambda c: F.greatest(F.lit(0), F.floor(c / tile)).cast("long")
    for a in "yx":
        c = F.col(a)
        rows = rows.withColumn(f"_t{a}", F.explode(F.sequence(at(c - reach), at(c + reach))) if reach else F.floor(c / tile).cast("long"))
    return rows.repartition(*([tasks] if tasks else []), *keys, "_ty", "_tx")


def home(rows: DataFrame, tile: int = TILE) -> DataFrame:
    return rows.where((F.floor(F.col("y") / tile) == F.col("_ty")) & (F.floor(F.col("x") / tile) == F.col("_tx"))).drop("_ty", "_tx")


def label_components(mask: DataFrame, keys: Sequence[str], conn: int = 8, tile: int = TILE) -> DataFrame:
    """Label the connected pixels of every mask (``keys`` name one mask; rows are its set pixels).

    Pixels are labelled inside tiles of bounded size, then labels that touch across tile borders are merged by an
    iterative join over border components only. The label is the scan position of the component's first pixel.
    """
    keys = list(keys)
    rows = mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    rows = tiled(rows, keys, 0, tile).distinct().select(*keys, "y", "x", "_ty", "_tx")
    steps = _neighbour_steps(conn)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"], ignore_index=True)
        y = (part["y"] - part["_ty"] * tile).to_numpy()
        x = (part["x"] - part["_tx"] * tile).to_numpy()
        index = np.full((tile + 1, tile + 2), -1)
        index[y, x + 1] = np.arange(len(part))
        a, b = [], []
        for dy, dx in steps:
            other = index[y + dy, x + 1 + dx]
            a.append(np.flatnonzero(other >= 0))
            b.append(other[other >= 0])
        root = _roots(len(part), np.concatenate(a), np.concatenate(b))
        return part.assign(label=(part["y"] * STRIDE + part["x"]).to_numpy()[root])

    schema = T.StructType([*rows.schema.fields, T.StructField("label", T.LongType())])
    labelled = checkpoint(rows.groupBy(*keys, "_ty", "_tx").applyInPandas(local, schema))
    links = _border_links(labelled, keys, conn, tile)
    if links.isEmpty():
        return labelled.select(*keys, "y", "x", "label")
    merged = merge_labels(links, keys)
    out = labelled.join(broadcast_if_small(merged), [*keys, "label"], "left")
    return out.select(*keys, "y", "x", F.coalesce("root", "label").alias("label"))


def _border_links(labelled: DataFrame, keys: list[str], conn: int, tile: int) -> DataFrame:
    edge = (F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1)
    border = labelled.where(edge)
    reach = border.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _neighbour_steps(conn)])))
    reach = reach.select(*keys, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("label").alias("a"))
    hits = reach.join(border.select(*keys, "y", "x", F.col("label").alias("b")), [*keys, "y", "x"]).where("a <> b")
    return checkpoint(hits.select(*keys, "a", "b").distinct())


def merge_labels(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest label reachable over ``links`` (a, b) for every linked label: min-neighbour rounds with pointer jumping."""
    keys = list(keys)
    both = checkpoint(links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = checkpoint(both.groupBy(*keys, F.col("a").alias("label")).agg(F.least(F.col("label"), F.min("b")).alias("root")))
    while True:  # every round lowers a root until all are settled
        near = both.join(state.select(*keys, F.col("label").alias("b"), F.col("root").alias("nr")), [*keys, "b"]).groupBy(*keys, F.col("a").alias("label")).agg(F.min("nr").alias("nr"))
        hooked = state.join(near, [*keys, "label"]).select(*keys, "label", F.least("root", "nr").alias("root"), F.col("root").alias("old"))
        hooked = checkpoint(hooked)
        jump = hooked.select(*keys, F.col("label").alias("root"), F.col("root").alias("up"))
        fresh = checkpoint(hooked.join(jump, [*keys, "root"], "left").select(*keys, "label", F.coalesce("up", "root").alias("root"), "old"))
        state = fresh.drop("old")
        if fresh.where("root <> old").isEmpty():
            return state


def erode(mask: DataFrame, keys: Sequence[str], height: int, width: int, r: int = 1) -> DataFrame:
    """Pixels whose (2r+1)² neighbourhood, clipped to the image, is fully set: one pass per axis."""
    keys = list(keys)
    row = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-r, r)
    col = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-r, r)
    span = lambda c, n: F.least(F.lit(n - 1), F.col(c) + r) - F.greatest(F.lit(0), F.col(c) - r) + 1
    rows = mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    rows = rows.withColumn("_h", F.count(F.lit(1)).over(row) == span("x", width)).where("_h")
    return rows.withColumn("_v", F.count(F.lit(1)).over(col) == span("y", height)).where("_v").drop("_h", "_v")


def dilate(mask: DataFrame, keys: Sequence[str], height: int, width: int, r: int = 1) -> DataFrame:
    """Pixels within r of a set pixel on both axes."""
    keys = list(keys)
    rows = mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    wide = rows.select(*keys, "y", F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - r), F.least(F.lit(width - 1), F.col("x") + r))).alias("x")).distinct()
    return wide.select(*keys, F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - r), F.least(F.lit(height - 1), F.col("y") + r))).alias("y"), "x").distinct()


MORPH_ROWS = 100_000  # pixels of a mask in a task, which a dilation by some pixels makes dozens of


def morph(mask: DataFrame, keys: Sequence[str], height: int, width: int, *steps: tuple, tile: int = TILE) -> DataFrame:
    """Erosions and dilations one after another, as (function, radius), by tile: one shuffle for all of them."""
    keys = list(keys)
    rows = checkpoint(mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")))
    rows = tiled(rows, keys, sum(r for _, r in steps), tile, tasks_for(rows, MORPH_ROWS))
    for step, r in steps:
        rows = step(rows, [*keys, "_ty", "_tx"], height, width, r)
    return home(rows, tile)


def opening(mask: DataFrame, keys: Sequence[str], height: int, width: int, r: int = 1) -> DataFrame:
    return morph(mask, keys, height, width, (erode, r), (dilate, r))


def closing(mask: DataFrame, keys: Sequence[str], height: int, width: int, r: int = 1) -> DataFrame:
    return morph(mask, keys, height, width, (dilate, r), (erode, r))


def boundary(labels: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Labelled pixels with an unset in-image neighbour."""
    inner = erode(labels, keys, height, width)
    return labels.join(inner, [*keys, "y", "x"], "left_anti")


def component_boxes(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")) \
        .withColumn("bw", F.col("x1") - F.col("x0") + 1).withColumn("bh", F.col("y1") - F.col("y0") + 1)


def component_features(labels: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Area, box, aspect, perimeter, centroid, main axis length and mean width per component."""
    keys = list(keys)
    labels = labels.select(*keys, "y", "x", "label")
    moments = labels.groupBy(*keys, "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.covar_pop("x", "y").alias("_xy"), F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"))
    # Rounding off the last digits keeps the axis of symmetric shapes the same in every evaluation order.
    angle = F.atan2(2 * F.round("_xy", 9) + 0.0, F.round(F.col("_xx") - F.col("_yy"), 9) + 0.0) / 2
    moments = moments.select(*keys, "label", "cx", "cy", F.cos(angle).alias("_ux"), F.sin(angle).alias("_uy"))
    along = (F.col("x") - F.col("cx")) * F.col("_ux") + (F.col("y") - F.col("cy")) * F.col("_uy")
    axis = labels.join(moments, [*keys, "label"]).withColumn("_t", along).groupBy(*keys, "label").agg(
        (F.max("_t") - F.min("_t")).alias("axis_length"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    edge = boundary(labels, keys, height, width).groupBy(*keys, "label").agg(F.count(F.lit(1)).cast("double").alias("perimeter"))
    out = component_boxes(labels, keys).join(axis, [*keys, "label"]).join(edge, [*keys, "label"], "left")
    return (out.withColumn("perimeter", F.coalesce("perimeter", F.lit(0.0))).withColumn("aspect", F.greatest("bw", "bh") / F.greatest(F.lit(1), F.least("bw", "bh")))
            .withColumn("width", F.col("area") / F.greatest("axis_length", F.lit(1e-6))))


def convex_hulls(labels: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Hull polygon per component.

    Only the leftmost and rightmost pixel of each row can be hull vertices, so every component reaches its hull
    function with at most two points per image row.
    """
    keys = list(keys)
    ends = labels.groupBy(*keys, "label", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    packed = ends.groupBy(*keys, "label").agg(F.collect_list(F.struct("y", "a", "b")).alias("rows"))

    def hull(rows) -> list:
        pts = sorted({(float(r["a"]), float(r["y"])) for r in rows} | {(float(r["b"]), float(r["y"])) for r in rows})
        if len(pts) < 3:
            return pts
        chains = []
        for ordered in (pts, pts[::-1]):
            chain: list = []
            for p in ordered:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                    chain.pop()
                chain.append(p)
            chains += chain[:-1]
        return chains

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def hull_udf(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: [{"x": p[0], "y": p[1]} for p in hull(r)])

    return packed.select(*keys, "label", hull_udf("rows").alias("points"))
