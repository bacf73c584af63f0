"""Steps whose work must not grow faster than their input."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from defectlake.operators import cloud, components, consensus, imagerun, skeleton, spatial, tracking
from defectlake.streaming import live


def plans(monkeypatch, module):
    """The optimised plans of all tables that ``module`` checkpoints from now on."""
    seen, before = [], module.checkpoint

    def kept(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return before(df)

    monkeypatch.setattr(module, "checkpoint", kept)
    return seen


def test_label_points_stops_at_the_first_record(spark, monkeypatch):
    """Places of a crowded cell meet records until one covers them: no table of all pairs is made."""
    boxes = [(0, k, float(x), float(y), 1.0 + x % 3) for x in range(0, 40, 5) for y in range(0, 40, 7) for k in range(5)]
    boxes += boxes[:50]  # equal records
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    c = F.col
    closed = c("k") != 2
    records = spark.createDataFrame(boxes, "view_id long, k int, x double, y double, width_px double").select(
        "view_id", F.element_at(F.array(*[F.lit(n) for n in cloud.PRIORITY]), c("k") + 1).alias("damage_class"), closed.alias("closed"),
        F.when(c("k") == 4, F.lit(None)).otherwise(c("width_px")).alias("width_px"),
        F.when(closed, F.array(p(c("x"), c("y")), p(c("x") + 4 - c("k"), c("y")), p(c("x") + 4 - c("k"), c("y") + 3 + c("k")), p(c("x"), c("y") + 3 + c("k"))))
        .otherwise(F.array(p(c("x"), c("y")), p(c("x") + 6, c("y") + 6))).alias("points"))
    rows = [(0, i, (i * 7 % 97) / 2.0, (i * 13 % 89) / 2.0, i % 11 != 0) for i in range(600)] + [(1, 0, 1.0, 1.0, True), (0, 600, 0.5, 0.5, True), (0, 601, 0.5, 0.5, True)]
    points = spark.createDataFrame(rows, "view_id long, point_id long, u double, v double, visible boolean")
    seen = plans(monkeypatch, cloud)
    got = {(r.view_id, r.point_id): r.class_id for r in cloud.label_points(points, records, 1.0, 1.0).collect()}
    want: dict = {}
    for view, i, u, v, visible in rows:
        if not visible or view:
            continue
        for _, k, x, y, w in boxes:
            if k != 2:
                hit = x <= u < x + 4 - k and y <= v < y + 3 + k if k < 4 else False  # the last class has no area
            else:
                t = max(0.0, min(1.0, ((u - x) * 6 + (v - y) * 6) / 72))
                hit = ((u - x - 6 * t) ** 2 + (v - y - 6 * t) ** 2) ** 0.5 <= max(1.5, w / 2 + 1)
            if hit:
                want[view, i] = min(want.get((view, i), 9), k)
    assert got == want and len(set(want.values())) >= 3
    assert any("LeftSemi" in plan for plan in seen) and not any("Join Inner" in plan for plan in seen)


def test_label_points_without_points(spark):
    points = spark.createDataFrame([], "view_id long, point_id long, u double, v double, visible boolean")
    records = spark.createDataFrame([], "view_id long, damage_class string, closed boolean, width_px double, points array<struct<x: double, y: double>>")
    assert cloud.label_points(points, records, 1.0, 1.0).collect() == []


def test_lifted_records_meet_once(spark):
    """Matches are shuffled by record once and hashed; of vertices at one point the first counts."""
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    records = spark.createDataFrame([(0, "a", "cracks", False, p((0, 0), (1, 0), (50, 0))), (0, "b", "cracks", False, p((0, 0), (1, 0))), (1, "a", "cracks", False, p((0, 0), (50, 0))),
                                     (0, "c", "spalling_dark", True, p((49, 1), (2, 0), (300, 0)))],
                                    "view_id long, record_id string, damage_class string, closed boolean, points array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(0, "p", 0.0, 0.0, True), (0, "q", 50.0, 4.0, True), (0, "r", 50.0, 0.0, False), (1, "s", 0.0, 3.0, True)], "view_id long, point_id string, u double, v double, visible boolean")
    out = tracking.lift_records(records, points, 1.0, 1.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {(r.view_id, r.record_id): (r.matches, round(r.reprojection_rmse, 9), r.point_ids) for r in out.collect()}
    assert got == {(0, "a"): (2, round(8 ** 0.5, 9), ["p", "q"]), (0, "c"): (2, round(((1 + 9) + 4) ** 0.5 / 2 ** 0.5, 9), ["q", "p"])}
    assert "SortAggregate" not in plan.split("SortMergeJoin")[0] and len(re.findall(r"Exchange hashpartitioning\(view_id#\d+L?, record_id", plan)) == 1


def test_iou_totals_without_pairs(spark, monkeypatch):
    """Totals equal those of the pairs: several blocks and cells, copies, empty boxes, missing keys; no join of boxes."""
    monkeypatch.setattr(spatial, "PAIR_BLOCK", 7)
    boxes = [(i % 2 if i % 19 else None, "ab"[i % 3 == 0], float(i * 31 % 190), float(i * 17 % 150), float(i * 31 % 190 + 20 + i % 90), float(i * 17 % 150 + 15 + i % 60)) for i in range(400)]
    boxes += boxes[::5] + boxes[::10] + [(0, "a", 10.0, 10.0, 5.0, 30.0)] * 3 + [(0, "a", -70.0, -70.0, -10.0, -5.0), (0, "a", -65.0, -70.0, -10.0, 0.0), (1, "c", 0.0, 0.0, None, 1.0)]
    df = spark.createDataFrame(boxes, "image_id long, canonical_label string, x1 double, y1 double, x2 double, y2 double").withColumn("label", F.col("canonical_label")).repartition(5)
    keys = ["image_id", "canonical_label"]
    want = consensus.pairwise_iou(df, 0.25).groupBy(*keys).agg(F.sum("n_pairs").alias("p"), F.sum(F.col("iou") * F.col("n_pairs")).alias("s"), F.max("iou").alias("m"))
    want = {(r.image_id, r.canonical_label): (r.p, round(r.s, 6), r.m) for r in want.collect()}
    totals = consensus.iou_totals(df, 0.25)
    assert {(r.image_id, r.canonical_label): (r.pairs, round(r.iou_sum, 6), r.iou_max) for r in totals.collect()} == want and len(want) == 4
    assert "Join" not in totals._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_placed_in_stretches(monkeypatch):
    """Stretches of boxes get the clusters that single boxes get, to the bit, with few single steps in a settled group."""
    rng = np.random.default_rng(3)
    for spread, step in ((2, 100), (12, 40), (30, 25)):
        base = rng.integers(0, 5, (3000, 2)) * step + rng.integers(0, spread, (3000, 2))
        boxes = np.column_stack([base, base + 30 + rng.integers(0, 20, (3000, 2))]).astype(float) / 1.1
        boxes[::500] = 0.0  # no area
        one, many = consensus._Clusters(), consensus._Clusters()
        want = [one.place(b, 0.25) for b in boxes]
        singles, place = [], consensus._Clusters.place
        with monkeypatch.context() as m:
            m.setattr(consensus._Clusters, "place", lambda self, box, iou: singles.append(1) or place(self, box, iou))
            cuts = [0, 1, 40, 1700, len(boxes)]
            got = [c for a, b in zip(cuts, cuts[1:]) for c in many.place_all(boxes[a:b], 0.25)]
        assert got == want and many.n == one.n
        for name in ("sums", "counts", "means"):
            assert np.array_equal(getattr(many, name)[:many.n], getattr(one, name)[:one.n])
        assert spread > 2 or len(singles) < 200


def test_averages_sort_a_bounded_number_of_rows(spark, monkeypatch):
    """Every sort of an average has as many tasks as its rows ask for; restarts and long keys come out as by hand."""
    monkeypatch.setattr(spatial, "TASK_ROWS", 40)
    data = [(s, q, float((q * 7 + s) % 5), q % 50 == 3) for s in range(30) for q in range(1, 101)]
    rows = spark.createDataFrame(data, "session_id long, seq long, v double, again boolean")
    out = live.ema(rows, ["session_id"], "seq", "v", 0.45, F.floor(F.col("seq") / 7), restart=F.col("again"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r", 75\)?, REPARTITION_BY_NUM", plan)) >= 3
    got, acc = {(r.session_id, r.seq): r.ema for r in out.collect()}, {}
    for s, q, v, again in data:
        acc[s] = v if again or s not in acc else acc[s] * 0.55 + v * 0.45
        assert abs(got[s, q] - acc[s]) < 1e-9
    assert len(got) == len(data)


def test_morphology_by_tile(spark, monkeypatch):
    """Several steps over tiles with a margin equal the steps over whole masks, and cost one shuffle."""
    monkeypatch.setattr(components, "MORPH_ROWS", 50)
    rng = np.random.default_rng(5)
    pixels = [(k, int(y), int(x)) for k in range(2) for y, x in np.argwhere(rng.random((23, 31)) < (0.75, 0.3)[k])]
    df = spark.createDataFrame(pixels + pixels[:40], "k long, y long, x long").repartition(4)
    rows = lambda d: {tuple(r) for r in d.select("k", "y", "x").collect()}
    for steps in (((components.erode, 1), (components.dilate, 2), (components.erode, 1)), ((components.dilate, 3), (components.erode, 3))):
        want = df
        for step, r in steps:
            want = step(want, ["k"], 23, 31, r)
        out = components.morph(df, ["k"], 23, 31, *steps, tile=8)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert rows(out) == rows(want) and out.count() == len(rows(want)) > 0
        assert plan.count("Exchange") == 1


def test_image_windows_by_tile(spark, monkeypatch):
    """The measures of the image run do not depend on the tiles that its windows are taken in."""
    rng = np.random.default_rng(6)
    data = [(i, y, x, *(int(v) for v in rng.integers(0, 256, 3))) for i in range(2) for y in range(20) for x in range(33)]
    df = spark.createDataFrame(data, "image_id long, y long, x long, r long, g long, b long")
    measures = ["image_id", "y", "x", "gray", "response", "rough", "texture"]
    whole = imagerun.base_table(df, 7)[0].select(*measures).collect()
    tiled = components.tiled
    monkeypatch.setattr(components, "tiled", lambda rows, keys, reach, tile=8, tasks=None: tiled(rows, keys, reach, 8, tasks))
    home = components.home
    monkeypatch.setattr(components, "home", lambda rows, tile=8: home(rows, 8))
    assert sorted(map(tuple, imagerun.base_table(df, 7)[0].select(*measures).collect())) == sorted(map(tuple, whole))
    assert len(whole) == len(data)


def test_association_search_grows(spark, monkeypatch):
    """Matches search from a small radius; of points at one distance the nearer in depth, then the smaller id, is taken."""
    started, search = [], cloud.nearest_within
    monkeypatch.setattr(cloud, "nearest_within", lambda *a: started.append(a[6] < a[5]) or search(*a))
    points = spark.createDataFrame([(0, 1, 10.0, 10.0, 5.0, True), (0, 2, 10.0, 12.0, 4.0, True), (0, 3, 10.0, 12.0, 4.0, True), (0, 4, 40.0, 10.0, 1.0, True), (0, 5, 100.0, 100.0, 1.0, False)],
                                   "view_id long, point_id long, u double, v double, depth double, in_frame boolean")
    matches = spark.createDataFrame([(0, "a", 10.0, 11.0, 5.0, 5.0, 1.0), (0, "b", 49.0, 10.0, 50.0, 50.0, 1.0), (0, "c", 50.0, 10.0, 90.0, 90.0, 1.0), (0, "d", 100.0, 100.0, 130.0, 130.0, 1.0)],
                                    "view_id long, match_id string, au double, av double, tu double, tv double, distance double")
    got = {r.match_id: (r.point_id, r.association_px, r.score) for r in cloud.associate_matches(matches, points).collect()}
    assert got == {"a": (2, 1.0, 5.0), "b": (4, 9.0, 37.0)} and started == [True]


def test_small_masks_are_thinned_in_one_round(spark, monkeypatch):
    """Masks within a tile have no copies in tiles beyond them, and one round does them to the end."""
    masks = [(k, y, x) for k in range(20) for y in range(32) for x in range(32) if (y // 8 + x // 8 + k) % 3]
    data = spark.createDataFrame(masks, "image_id long, y long, x long")
    assert skeleton._with_margin(data, ["image_id"], 256, 32).count() == len(masks)
    seen = plans(monkeypatch, skeleton)
    assert skeleton.thin(data, ["image_id"]).count() > 0 and len(seen) == 1
