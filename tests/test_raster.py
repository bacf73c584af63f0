import numpy as np
from pyspark.sql import functions as F

from defectlake.operators import components as C
from defectlake.operators import context as X
from defectlake.operators import raster as R


def mask_df(spark, mask, key=1):
    return spark.createDataFrame([(key, int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "image_id long, y long, x long")


def flood(mask, conn=8):
    label = np.full(mask.shape, -1)
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x] >= 0:
            continue
        stack, root = [(y, x)], y * C.STRIDE + x
        label[y, x] = root
        while stack:
            a, b = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if conn == 4 and abs(dy) + abs(dx) != 1:
                        continue
                    p, q = a + dy, b + dx
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and label[p, q] < 0:
                        label[p, q] = root
                        stack.append((p, q))
    return label


def test_components_match_flood_fill_across_tiles(spark):
    rng = np.random.default_rng(2)
    for conn, density in ((8, 0.45), (4, 0.6)):
        mask = rng.random((40, 40)) < density
        want = flood(mask, conn)
        got = C.label_components(mask_df(spark, mask), ["image_id"], conn, tile=7).collect()
        assert len(got) == mask.sum() and all(want[r["y"], r["x"]] == r["label"] for r in got)


def test_spiral_component_settles(spark):
    mask = np.zeros((25, 25), bool)
    for i in range(0, 25, 2):
        mask[i] = True
        if i < 24:
            mask[i + 1, 0 if (i // 2) % 2 else 24] = True
    got = C.label_components(mask_df(spark, mask), ["image_id"], 4, tile=5)
    assert got.select("label").distinct().count() == 1


def shift_op(mask, r, fn):
    pad = np.pad(mask, r, mode="edge")
    return fn([pad[r + dy:r + dy + mask.shape[0], r + dx:r + dx + mask.shape[1]] for dy in range(-r, r + 1) for dx in range(-r, r + 1)], axis=0)


def test_sparse_morphology_equals_dense(spark):
    mask = np.random.default_rng(4).random((20, 26)) < 0.7
    df = mask_df(spark, mask)
    dense = lambda d: {(r["y"], r["x"]) for r in d.collect()}
    pts = lambda m: set(zip(*(v.tolist() for v in np.nonzero(m))))
    for r in (1, 2):
        er, di = shift_op(mask, r, np.min), shift_op(mask, r, np.max)
        assert dense(C.erode(df, ["image_id"], 20, 26, r)) == pts(er)
        assert dense(C.dilate(df, ["image_id"], 20, 26, r)) == pts(di)
        assert dense(C.opening(df, ["image_id"], 20, 26, r)) == pts(shift_op(er, r, np.max))
        assert dense(C.closing(df, ["image_id"], 20, 26, r)) == pts(shift_op(di, r, np.min))


def test_hull_contains_all_pixels_and_has_the_right_area(spark):
    mask = np.zeros((20, 20), bool)
    mask[3:9, 4:12] = True
    mask[5, 15] = mask[5, 14] = mask[5, 13] = mask[5, 12] = True
    from defectlake.functions.geometry import polygon_area
    hull = C.convex_hulls(C.label_components(mask_df(spark, mask), ["image_id"]), ["image_id"], 20, 20)
    row = hull.select("points", polygon_area(F.col("points")).alias("a")).first()
    assert {(p["x"], p["y"]) for p in row["points"]} == {(4.0, 3.0), (11.0, 3.0), (15.0, 5.0), (11.0, 8.0), (4.0, 8.0)}
    assert row["a"] == 35 + 0.5 * 5 * 4


def test_family_separation(spark):
    rows = [(1, "spalling_dark", y, x) for y in range(0, 10) for x in range(0, 10)] + [(1, "corrosion_rust", y, x) for y in range(0, 7) for x in range(0, 10)]
    rows += [(1, "cracks", 3, x) for x in range(0, 20)] + [(1, "exposed_rebar", 5, 5), (1, "exposed_rebar", 15, 15)] + [(1, "spalling_dark", y, x) for y in range(14, 18) for x in range(14, 18)]
    df = spark.createDataFrame(rows, "image_id long, damage_class string, y long, x long")
    out = {}
    for r in R.separate_families(df, ["image_id"], 20, 20).collect():
        out.setdefault(r["damage_class"], set()).add((r["y"], r["x"]))
    assert out["cracks"] == {(3, x) for x in range(10, 20)}
    assert out["exposed_rebar"] == {(15, 15)}
    assert {(y, x) for y in range(14, 18) for x in range(14, 18)} <= out["spalling_dark"]
    assert not {p for p in out["spalling_dark"] if p[0] < 7}


def test_crack_measures_join_fragments_over_small_gaps(spark):
    pts = [(10, x) for x in range(0, 60) if x not in (20, 21, 22, 40, 41)]
    labels = C.label_components(spark.createDataFrame([(1, y, x) for y, x in pts], "image_id long, y long, x long"), ["image_id"])
    frag = R.crack_fragments(labels, ["image_id"], 12)
    skel = spark.createDataFrame([(1, 10, x) for x in range(0, 60)], "image_id long, y long, x long")
    out = R.crack_measures(frag, skel, ["image_id"], 64, 64, min_area=12).collect()
    assert len(out) == 1 and out[0]["length"] == 59.0 and out[0]["area"] == 55


def test_rle_adds_up(spark):
    mask = np.random.default_rng(1).random((9, 7)) < 0.4
    counts = R.rle(mask_df(spark, mask), ["image_id"], 9, 7).first()["counts"]
    flat, on = [], False
    for c in counts:
        flat += [on] * c
        on = not on
    assert flat == mask.T.ravel().tolist()


def test_crack_candidates_find_a_dark_line(spark):
    img = np.full((40, 48), 190)
    img[18:21, 5:40] = 40
    rows = [(1, y, x, int(img[y, x]), int(img[y, x]), int(img[y, x])) for y in range(40) for x in range(48)]
    out = R.crack_candidates(spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long"), 40, 48).collect()
    assert len(out) == 1 and out[0]["bw"] >= 33 and out[0]["area"] >= 90


def test_context_gate_threshold_and_clip(spark):
    labels = C.label_components(spark.createDataFrame([(1, 5, x) for x in range(30, 50)], "image_id long, y long, x long"), ["image_id"])
    excl = spark.createDataFrame([(1, cy, cx) for cy in range(4) for cx in range(4)], "image_id long, cell_y long, cell_x long")
    assert X.gate_components(labels, excl, ["image_id"], (4, 8), (40, 80), 0.6).first()["removed"] is False
    assert X.gate_components(labels, excl, ["image_id"], (4, 8), (40, 80), 0.4).first()["removed"] is True
    full = spark.createDataFrame([(1, y, x) for y in range(40) for x in range(80)], "image_id long, y long, x long")
    out = {(r["y"], r["x"]) for r in X.clip_by_context(full, excl, ["image_id"], (4, 8), (40, 80)).collect()}
    assert out == {(y, x) for y in range(40) for x in range(80) if x >= 25}
