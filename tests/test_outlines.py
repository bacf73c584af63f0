"""Outlines over tile borders: areas, rings and corners against counts of pixels and of 2 x 2 windows."""

from __future__ import annotations

import numpy as np
import pytest

from defectlake.operators import components, outlines


def filled(points, h, w):
    """Pixels inside a ring by crossings of the vertical sides to their left."""
    out = np.zeros((h, w), dtype=int)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        assert (ax == bx) != (ay == by)
        for y in range(min(ay, by), max(ay, by)):
            out[y, ax:] ^= 1
    return out


@pytest.mark.parametrize("conn,tile", [(8, 8), (4, 8), (8, 256)])
def test_rings_over_tile_borders(spark, conn, tile):
    rng = np.random.default_rng(3)
    h, w = 37, 41
    masks = [np.zeros((h, w), dtype=bool) for _ in range(3)]
    masks[0][2:33, 3:38] = True
    masks[0][8:25, 9:30] = False
    masks[0][12:20, 14:22] = True  # an island in a hole over many tiles
    masks[1] = rng.random((h, w)) < 0.55
    masks[2][::2, :] = True
    masks[2][:, 0] = True
    rows = [(i, int(y), int(x)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    labels = components.label_components(spark.createDataFrame(rows, "image_id long, y long, x long"), ["image_id"], conn)
    rings = outlines.region_outlines(labels, ["image_id"], conn, tile).collect()
    got = {r["image_id"]: np.zeros((h, w), dtype=int) for r in rings}
    for r in rings:
        inside = filled([(p["x"], p["y"]) for p in r["points"]], h, w)
        assert inside.sum() == abs(r["area"]) and r["hole"] == (r["area"] < 0)
        got[r["image_id"]] += inside * (-1 if r["hole"] else 1)
    assert all((got[i] == m).all() for i, m in enumerate(masks))
    sizes = {(r["image_id"], r["label"]): r["n"] for r in labels.groupBy("image_id", "label").count().withColumnRenamed("count", "n").collect()}
    assert {(r["image_id"], r["label"]): r["pixels"] for r in outlines.outline_summary(outlines.region_outlines(labels, ["image_id"], conn, tile), ["image_id"]).collect()} == sizes
    outer = [r for r in rings if not r["hole"]]
    assert len(outer) == len(sizes)
