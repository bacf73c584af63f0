"""Steps whose disk, memory and time must suit tables hundreds of times as large."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from defectlake.operators import annotations, cloud, spans, spatial, tracking
from defectlake.sources import fixtures


@pytest.mark.parametrize("crowd", [1.0, 12.0])
def test_nearest_index_equals_brute_force(crowd):
    """Levels of cells give the nearest point, the first on ties, within the radius and the group."""
    rng = np.random.default_rng(8)
    for d in (2, 3):
        points = np.concatenate([rng.normal(0, 1, (1500, d)) * crowd / 6, rng.integers(-20, 20, (700, d)).astype(float)])
        points = np.concatenate([points, points[::9]])
        queries = np.concatenate([rng.normal(0, 9, (400, d)), rng.integers(-20, 20, (300, d)) + 0.5, np.full((1, d), np.nan)])
        group, part = rng.integers(0, 2, len(points)), rng.integers(0, 3, len(queries))
        index = spatial.NearestIndex(group, points, crowd)
        index.PAIRS = 500
        gap = np.sqrt(sum((queries[:, None, i] - points[None, :, i]) ** 2 for i in range(d)))
        gap[(part[:, None] != group[None]) | ~(gap <= crowd)] = np.inf
        found, distance, other = index.query(part, queries)
        second = np.where(np.arange(len(points)) == found[:, None], np.inf, gap)
        second[(found[:, None] >= 0) & (points[None] == points[found][:, None]).all(axis=2) & (group[None] == group[found][:, None])] = np.inf  # a copy is no other point
        assert (other <= second.min(axis=1)).all() and (other >= np.minimum(distance, crowd)).all()
        assert (distance == gap.min(axis=1)).all() and (found == np.where(np.isfinite(distance), gap.argmin(axis=1), -1)).all()
        assert len(index.levels) > 1 and (found >= 0).any() and (found < 0).any()


def test_records_stay_where_they_are(spark, monkeypatch):
    """Records meet places held in memory without a shuffle of vertices; repeated records count as one, as by shuffles."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        n = int(rng.integers(1, 6)) if i % 10 else 90
        pts = [(float(x) + 45 * (i >= 100), float(y)) for x, y in rng.integers(0, 80, (n, 2)) * 0.5]  # a repeated record meets other points
        rows.append((int(i % 4) if i % 13 else None, f"r{i % 100}", "cracks" if i % 20 < 10 else "spalling_dark", bool(i % 20 >= 10), [{"x": x, "y": y} for x, y in pts] if i % 17 else []))
    records = spark.createDataFrame(rows, "view_id long, record_id string, damage_class string, closed boolean, points array<struct<x: double, y: double>>")
    points = [(int(v) if k % 29 else None, f"p{k % 230:03d}", float(u), float(w), bool(k % 7)) for k, (v, u, w) in enumerate(zip(rng.integers(0, 3, 260), rng.integers(0, 90, 260), rng.integers(0, 90, 260)))]
    visible = spark.createDataFrame(points, "view_id long, point_id string, u double, v double, visible boolean")
    result = lambda df: {(r.view_id, r.record_id, r.damage_class, r.closed): (r.matches, round(r.reprojection_rmse, 9)) for r in df.collect()}
    held = tracking.lift_records(records, visible, 1.0, 1.0, 4.0)
    assert "SortMergeJoin" not in held._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tracking, "HELD_PLACES", 0)
    by_place = tracking.lift_records(records, visible, 1.0, 1.0, 4.0)
    assert result(held) == result(by_place) and len(result(held)) > 15
    lists = lambda df: {(r.view_id, r.record_id, r.damage_class): sorted(r.point_ids) for r in df.collect()}
    assert lists(held) == lists(by_place)
    none = tracking.lift_records(records, visible.where("false"), 1.0, 1.0, 4.0)
    monkeypatch.undo()
    assert none.collect() == tracking.lift_records(records, visible.where("false"), 1.0, 1.0, 4.0).collect() == []


def test_single_lines_are_not_shuffled(spark):
    """A row whose hash comes once gets its id in place; equal rows are still numbered."""
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    at = datetime.datetime(1995, 3, 1)
    line = lambda i: (i, i * 7 if i % 3 else None, 2, 1, 3.0, 4.25, 0.05, 0.0, None if i % 5 == 0 else "R", "F", at)
    single = fixtures._lines(spark.createDataFrame([line(i) for i in range(40)], names))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    ids = {r.line_id for r in single.collect()}
    assert len(ids) == 40 and all(i.endswith("-1") for i in ids)
    mixed = [r.line_id for r in fixtures._lines(spark.createDataFrame([line(i) for i in range(40)] + [line(3)] * 2 + [line(0)], names)).collect()]
    assert len(mixed) == len(set(mixed)) == 43 and ids < set(mixed) and sorted(i[-2:] for i in set(mixed) - ids) == ["-2", "-2", "-3"]


def test_nearest_places_settle_in_blocks(spark, monkeypatch):
    """Neighbours equal those of all pairs, the smallest id on ties, also where a task settles a block in several steps."""
    monkeypatch.setattr(spatial, "SETTLED_ROWS", 16)
    rng = np.random.default_rng(4)
    points = [(int(k) if i % 40 else None, (0, f"p{i}"), float(x), float(y)) for i, (k, x, y) in enumerate(zip(rng.integers(0, 2, 400), rng.integers(-40, 60, 400), rng.normal(0, 9, 400).round(0)))]
    queries = [(int(k) if i % 30 else None, float(x), float(y)) for i, (k, x, y) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(-60, 80, 300) + 0.5, rng.integers(-20, 20, 300) - 0.5))] + [(0, None, 1.0), (0, float("nan"), 1.0)]
    p = spark.createDataFrame(points, "k long, id struct<d: int, name: string>, x double, y double")
    q = spark.createDataFrame(queries, "k long, x double, y double")
    for radius, start in ((4.0, 1.0), (None, 0.5)):
        got = {(r.k, r.x, r.y): (tuple(r.point_id), r.distance) for r in spatial.nearest_within(q, p, ["k"], ["x", "y"], "id", radius, start).collect()}
        want = {}
        for k, x, y in queries:
            near = [(np.sqrt((x - c) * (x - c) + (y - d) * (y - d)), i) for kk, i, c, d in points if kk == k and k is not None and x is not None and x == x]
            if near and (radius is None or min(near)[0] <= radius):
                want[k, x, y] = (min(near)[1], min(near)[0])
        assert got == want and len(want) > 100
    whole = spatial.nearest_within(q.where("NOT isnan(x)").select(F.col("x").cast("long").alias("x")), p.select("id", F.col("x").cast("long").alias("x")), [], ["x"], "id", None, 1.0)
    assert dict(whole.dtypes)["x"] == "bigint" and all(r.distance == min(abs(r.x - int(c)) for *_, c, _ in points) for r in whole.collect())


def test_icp_searches_again_only_where_neighbours_may_change(spark, monkeypatch):
    """Rounds equal those that search all places again; a cloud that has found its place is searched once."""
    rng = np.random.default_rng(6)
    goal = rng.random((250, 3)) * [30, 20, 10]
    turn = np.array([[np.cos(0.03), -np.sin(0.03), 0], [np.sin(0.03), np.cos(0.03), 0], [0, 0, 1]])
    begin = (goal + rng.normal(0, 0.05, goal.shape)) @ turn.T + [0.4, -0.2, 0.1]
    table = lambda a: spark.createDataFrame([(f"p{i:03d}", *map(float, v)) for i, v in enumerate(a)], "point_id string, x double, y double, z double")
    sizes, search = [], spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda left, *a, **k: (sizes.append(left.count()), search(left, *a, **k))[1])
    rotation, shift, history = cloud.icp(table(np.concatenate([begin, begin[:9]])), table(np.concatenate([goal, goal, goal])), 0.5, max_iterations=8)
    at, want = np.concatenate([begin, begin[:9]]), []
    for _ in history:
        to = goal[((at[:, None] - goal[None]) ** 2).sum(-1).argmin(1)]
        u, _, vt = np.linalg.svd((at - at.mean(0)).T @ (to - to.mean(0)))
        r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
        at = (at - at.mean(0)) @ r.T + to.mean(0)
        want.append(np.sqrt(((at - to) ** 2).sum(-1).mean()))
    assert np.allclose(history, want, atol=1e-9) and len(history) > 2
    assert np.allclose(begin @ np.reshape(rotation, (3, 3)).T + shift, at[:250], atol=1e-9)
    assert sizes[0] == 250 and sum(sizes) < 250 * len(history)
    sizes.clear()
    shifted = cloud.icp(table(np.floor(goal) + [0.1, 0.05, 0.0]), table(np.floor(goal)), 0.5)
    assert sizes == [len(np.unique(np.floor(goal), axis=0))] and round(shifted[2][-1], 9) == 0


def test_unions_are_drawn_in_tasks(spark, monkeypatch):
    """The union of shapes has the pixels of all shapes, each once; copies of a shape do not shuffle a pixel more."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(160):
        pts = [(float(x), float(y)) for x, y in rng.normal(20, 14, (int(rng.integers(1, 7)), 2)).round(int(i % 3))]
        if i % 11 == 0:
            pts[0] = (None, pts[0][1]) if i % 2 else (pts[0][0], None)
        rows.append((int(i % 4) if i % 23 else None, int(i), ["cracks", "spalling_dark", "structure", None][i % 4 if i % 7 else 0], float(1 + i % 5) if i % 9 else None, [{"x": x, "y": y} for x, y in pts] if i % 31 else []))
    rows += [(1, -1, "cracks", 3.0, None), (1, -2, "spalling_dark", 3.0, None)] + rows[:40]
    df = spark.createDataFrame(rows, "image_id long, ann_id long, cls string, w double, points array<struct<x: double, y: double>>")
    closed, keys = F.col("cls") != "cracks", ["image_id", "cls"]
    want = {tuple(r) for r in annotations.rasterize(df, keys, 40, 32, closed, F.col("w")).collect()}
    for held, drawn in ((1 << 20, 1 << 21), (64, 300)):
        monkeypatch.setattr(spans, "HELD_RUNS", held)
        monkeypatch.setattr(spans, "DRAWN", drawn)
        got = [tuple(r) for r in annotations.rasterize(df, keys, 40, 32, closed, F.col("w"), union=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 3000


def test_runs_of_a_task_stay_few(monkeypatch):
    """A task keeps the runs of the union and not those of all shapes; lines that may go on are kept back."""
    monkeypatch.setattr(spans, "HELD_RUNS", 100)
    rng = np.random.default_rng(1)
    union, seen, out = spans._Union(20, 50, [pa.int64()]), set(), []
    for step in range(30):
        key = union.numbers([pa.array(rng.integers(0, 3, 40) if step < 20 else np.full(40, 9))])
        names = list(union.keys)
        y, a = rng.integers(0, 20, 40) if step < 20 else np.full(40, 7), rng.integers(0, 45, 40)
        b = a + rng.integers(0, 5, 40)
        seen |= {(*names[k], yy, x) for k, yy, aa, bb in zip(key, y, a, b) for x in range(aa, bb + 1)}
        union.add(key, y, a, b)
        if step == 25:
            out += [r for batch in union.rows(["k", "y", "a", "b"], (int(key[-1]), 7)) for r in batch.to_pylist()]
            assert all(r["k"] != 9 for r in out) and list(union.keys) == [(9,)]
    out += [r for batch in union.rows(["k", "y", "a", "b"]) for r in batch.to_pylist()]
    got = [(r["k"], r["y"], x) for r in out for x in range(r["a"], r["b"] + 1)]
    assert len(got) == len(set(got)) and set(got) == seen
