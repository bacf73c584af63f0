"""Skeletons by tiles against the whole image, and centre lines of drawn cracks."""

from __future__ import annotations

import math

import numpy as np
import pytest

from defectlake.operators import components as C
from defectlake.operators import raster as R
from defectlake.operators import skeleton as S


def frame(spark, mask, key=1):
    return spark.createDataFrame([(key, int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "image_id long, y long, x long")


def pixels(df):
    return {(r["y"], r["x"]) for r in df.collect()}


def slow_thin(mask):
    """Zhang and Suen by the definition, pixel by pixel."""
    on = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = len(on)
        for half in (0, 1):
            gone = set()
            for y, x in on:
                p = [int((y + dy, x + dx) in on) for dy, dx in ring]
                n, e, s, w = p[0], p[2], p[4], p[6]
                rises = sum(a == 0 and b == 1 for a, b in zip(p, p[1:] + p[:1]))
                free = (n * e * s == 0 and e * s * w == 0) if half == 0 else (n * e * w == 0 and n * s * w == 0)
                if 2 <= sum(p) <= 6 and rises == 1 and free:
                    gone.add((y, x))
            on -= gone
        if len(on) == before:
            return on


def blobs(seed, height=90, width=110):
    rng = np.random.default_rng(seed)
    mask = np.zeros((height, width), dtype=bool)
    yy, xx = np.mgrid[:height, :width]
    for _ in range(9):
        cy, cx, r = rng.integers(0, height), rng.integers(0, width), rng.integers(3, 22)
        mask |= (yy - cy) ** 2 + (xx - cx) ** 2 <= r * r
    return mask & (rng.random(mask.shape) > 0.01)


@pytest.mark.parametrize("margin", [4, 32])
def test_thinning_by_tiles_equals_the_whole_image(spark, margin):
    mask = blobs(3)
    assert pixels(S.thin(frame(spark, mask), ["image_id"], tile=32, margin=margin)) == slow_thin(mask)


def test_pruning_by_tiles_equals_the_whole_image(spark):
    thin = slow_thin(blobs(5))
    data = spark.createDataFrame([(1, y, x) for y, x in thin], "image_id long, y long, x long")
    assert pixels(S.prune_spurs(data, ["image_id"], tile=32)) == thin - S._spurs(thin, S.SPUR_PX)


def test_short_branches_go_and_long_ones_stay(spark):
    line = {(20, x) for x in range(60)}
    short, long = {(20 - i, 15) for i in range(1, 9)}, {(20 - i, 40) for i in range(1, 19)}
    data = spark.createDataFrame([(1, y, x) for y, x in line | short | long], "image_id long, y long, x long")
    kept = pixels(S.prune_spurs(data, ["image_id"]))
    assert long <= kept and (12, 15) not in kept and {(20, 0), (20, 59)} <= kept


def test_walks_measure_lines_branches_and_rings():
    line, length = S.walked([(x, 5) for x in range(30)])
    assert abs(length - 29) < 1e-9 and {line[0], line[-1]} <= {(0.0, 5.0), (29.0, 5.0)}
    assert abs(S.walked([(i, i) for i in range(30)])[1] - 29 * math.sqrt(2)) < 1e-9
    fork = [(x, 20) for x in range(41)] + [(20, y) for y in range(20)]
    assert abs(S.walked(fork)[1] - 60) < 2
    assert S.walked([(3, 3)]) == ([(3.0, 3.0)], 0) and S.walked([]) == ([], 0.0)
    two = [(x, 0) for x in range(10)] + [(x, 50) for x in range(20)]
    assert abs(S.walked(two)[1] - 28) < 1e-9 and S.walked(two)[0][0][1] == 50.0


def test_crack_with_gaps_and_a_branch_is_measured_within_ten_percent(spark):
    height, width = 240, 320
    mask, true = np.zeros((height, width), dtype=bool), 0.0
    course = [(x, 120 + 40 * math.sin(x / 45)) for x in range(20, 300)]
    for (x0, y0), (x1, y1) in zip(course, course[1:]):
        true += math.hypot(x1 - x0, y1 - y0)
        if not (90 <= x0 < 96 or 200 <= x0 < 206):
            mask[int(round(y0)) - 1 : int(round(y0)) + 2, x0] = True
    last = 112
    for i in range(60):  # a branch upwards
        x, y = 150 + i // 2, int(round(120 + 40 * math.sin((150 + i // 2) / 45))) - i
        mask[y:last, x - 1 : x + 2] = True
        last = y
    true += math.hypot(30, 60 + 40 * (math.sin(150 / 45) - math.sin(180 / 45)))
    labels = C.label_components(frame(spark, mask), ["image_id"])
    found = R.crack_measures(R.crack_fragments(labels, ["image_id"]), None, ["image_id"], height, width).collect()
    assert len(found) == 1 and abs(found[0]["length"] - true) < 0.1 * true


@pytest.mark.parametrize("batch", [7, 10_000])
def test_many_masks_are_thinned_and_pruned_as_each_alone(spark, batch):
    """Masks of all sizes in one task, with a null key, repeated and negative pixels, over tile borders and none."""
    shapes = {None: blobs(1, 20, 25), 1: blobs(2, 60, 70), 2: np.ones((3, 3), bool), 3: np.ones((2, 2), bool), 4: np.zeros((1, 1), bool) | True, 5: blobs(7, 30, 9)}
    sets = {key: {(int(y) - 11, int(x) - 40) for y, x in zip(*np.nonzero(mask))} for key, mask in shapes.items()}
    rows = [(key, y, x) for key, on in sets.items() for y, x in on]
    data = spark.createDataFrame(rows + rows[::3] * 3, "image_id long, y long, x long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [sorted((str(r[0]), r[1], r[2]) for r in df.collect()) for df in (S.thin(data, ["image_id"], tile=32, margin=8), S.prune_spurs(data, ["image_id"], longest=4, tile=16))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    thin = {key: slow_thin_of(on) for key, on in sets.items()}
    assert got[0] == sorted((str(k), y, x) for k, on in thin.items() for y, x in on)
    assert got[1] == sorted((str(k), y, x) for k, on in sets.items() for y, x in on - S._spurs(on, 4))


def slow_thin_of(on):
    low = min(y for y, _ in on), min(x for _, x in on)
    mask = np.zeros((200, 200), bool)
    for y, x in on:
        mask[y - low[0], x - low[1]] = True
    return {(y + low[0], x + low[1]) for y, x in slow_thin(mask)}


def test_spurs_of_a_stack_are_those_of_the_definition():
    rng = np.random.default_rng(4)
    for share in (0.1, 0.2, 0.3, 0.4):
        image = np.zeros((62, 82), np.uint8)
        image[1:-1, 1:-1] = rng.random((60, 80)) < share
        place = np.flatnonzero(image)
        want = S._spurs({divmod(int(p), 82) for p in place}, 5)
        assert {divmod(int(p), 82) for p in S.spurs_of_stack(image.ravel(), 82, place, 5)} == want
