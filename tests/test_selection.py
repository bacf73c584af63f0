"""Greedy selection by rounds against one pass in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from defectlake.operators import selection, spatial

BOXES = "image_id long, cand_id long, score double, x1 double, y1 double, x2 double, y2 double"


def slow_boxes(rows, iou):
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        k = np.array([q[3:] for q in kept if q[0] == r[0]]).reshape(-1, 4)
        inter = np.maximum(0, np.minimum(k[:, 2], r[5]) - np.maximum(k[:, 0], r[3])) * np.maximum(0, np.minimum(k[:, 3], r[6]) - np.maximum(k[:, 1], r[4]))
        area = (k[:, 2] - k[:, 0]) * (k[:, 3] - k[:, 1]) + (r[5] - r[3]) * (r[6] - r[4])
        if not (inter / np.maximum(area - inter, 1e-9) > iou).any():
            kept.append(r)
    return sorted(r[1] for r in kept)


def select(spark, rows, iou, tile):
    order = [-F.col("score"), F.col("cand_id")]
    return sorted(r["cand_id"] for r in selection.select_boxes(spark.createDataFrame(rows, BOXES), ["image_id"], order, iou, tile).collect())


def test_boxes_over_tile_borders(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        x, y, w, h = (float(v) for v in (*rng.integers(-150, 150, 2), *rng.integers(5, 90, 2)))
        rows.append((i % 2, i, float(rng.integers(0, 60)) / 60, x, y, x + w, y + h))
    rows += [(2, 5000 + i, 0.5, 3.0, 3.0, 60.0 + i % 3, 60.0) for i in range(40)] + [(2, 6000, 0.1, 5.0, 5.0, 5.0, 9.0)]
    for iou, tile in ((0.45, 40.0), (0.2, 1024.0)):
        assert select(spark, rows, iou, tile) == slow_boxes(rows, iou)


def test_chain_of_boxes_is_split(spark, monkeypatch):
    """Each box overlaps the next; scores fall along the chain, so that every decision waits for the one before."""
    n = 10_000
    rows = [(0, i, 1.0 - i / (2 * n), 10.0 * i, 0.0, 10.0 * i + 16, 16.0) for i in range(n)]
    seen = []
    fold = spatial.ordered_fold

    def measured(df, keys, *rest):
        seen.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return fold(df, keys, *rest)

    monkeypatch.setattr(selection, "ordered_fold", measured)
    assert select(spark, rows, 0.2, 16_384.0) == list(range(0, n, 2))
    assert max(seen) < n / 5 and len(seen) < 12


def slow_pairs(rows):
    used, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        if not {(r[0], 0, r[1]), (r[0], 1, r[2])} & used:
            used |= {(r[0], 0, r[1]), (r[0], 1, r[2])}
            out.append(r)
    return sorted(out)


def test_pairs_over_blocks(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(rng.integers(2)), int(a), int(a + rng.integers(-3, 4)), int(rng.integers(40))) for a in rng.integers(0, 120, 900)})
    rows += [(7, i, i + d, 2 * i + d) for i in range(300) for d in (0, 1)]  # a chain in order
    df = spark.createDataFrame(rows, "k long, a long, b long, score long")
    out = selection.select_pairs(df, ["k"], "a", "b", [F.col("score"), F.col("a"), F.col("b")], F.floor(F.col("a") / 50))
    assert sorted((r["k"], r["a"], r["b"], r["score"]) for r in out.collect()) == slow_pairs(rows)
    empty = df.where("k = 99")
    assert selection.select_pairs(empty, ["k"], "a", "b", [F.col("score")], F.lit(0)).count() == 0
    assert selection.select_boxes(spark.createDataFrame([], BOXES), ["image_id"], [F.col("cand_id")], 0.5).count() == 0
