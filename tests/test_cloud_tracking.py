import numpy as np
from pyspark.sql import functions as F

from defectlake.operators import cloud as G
from defectlake.operators import tracking as H


def cloud(spark, pts):
    return spark.createDataFrame([(f"p{i:05d}", 1, *map(float, p)) for i, p in enumerate(pts)], "point_id string, cloud_id long, x double, y double, z double")


def test_local_shapes(spark):
    plane = [(x, y, 0) for x in range(21) for y in range(21)]
    s = {r["geometry"]: r["n"] for r in G.geometry_summary(cloud(spark, plane)).collect()}
    assert s["planar_surface"] > 300 and sum(s.values()) == 441
    line = {r["geometry"]: r["n"] for r in G.geometry_summary(cloud(spark, [(i * 0.1, 0, 0) for i in range(120)])).collect()}
    assert line["linear_edge"] > 90


def test_projection_occlusion(spark):
    pose = spark.createDataFrame([(0, 100.0, 100.0, 50.0, 50.0, 100, 100, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
                                 "view_id long, fx double, fy double, cx double, cy double, w long, h long, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, "
                                 "tx double, ty double, tz double, k1 double, k2 double, p1 double, p2 double, k3 double")
    out = {r["point_id"]: r for r in G.project_points(cloud(spark, [(0, 0, 2), (0, 0, 4), (5, 0, 2), (0, 0, -1)]), pose).collect()}
    assert (out["p00000"]["u"], out["p00000"]["v"], out["p00000"]["in_frame"]) == (50.0, 50.0, True)
    assert out["p00002"]["in_frame"] is False and out["p00003"]["u"] is None
    seen = {r["point_id"]: r["visible"] for r in G.zbuffer_visible(G.project_points(cloud(spark, [(0, 0, 2), (0, 0, 4)]), pose)).collect()}
    assert seen == {"p00000": True, "p00001": False}


def test_votes(spark):
    votes = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 0.8), (0, 2, 2, 0.9), (1, 0, 3, 1.0), (2, 0, 0, 0.5), (2, 1, 1, 0.5)], "point_id long, view_id long, class_id long, weight double")
    out = {r["point_id"]: r for r in G.fuse_votes(votes, 3).collect()}
    assert out[0]["class_id"] == 2 and out[0]["support"] == 2 and out[0]["confirmed"] and not out[1]["confirmed"]
    assert out[2]["class_id"] == 0 and out[2]["confidence"] == 0.5


def test_nearest_point_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    pts, qs = rng.random((300, 3)) * 10, rng.random((80, 3)) * 14 - 2
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(qs)], "qid long, x double, y double, z double")
    got = {r["query_id"]: r["distance"] for r in G.nearest_point(q, cloud(spark, pts), [], 0.4, "qid", "point_id").collect()}
    want = np.sqrt(((qs[:, None] - pts[None]) ** 2).sum(-1)).min(1)
    assert len(got) == 80 and np.allclose([got[i] for i in range(80)], want)


def test_rigid_fit_and_icp(spark):
    rng = np.random.default_rng(9)
    a = np.radians(20)
    rot = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    src = rng.random((30, 3)) * 5
    dst = src @ rot.T + [2.5, -1.25, 0.75]
    pairs = spark.createDataFrame([(1, *map(float, s), *map(float, d)) for s, d in zip(src, dst)] + [(2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)] * 4, "k long, sx double, sy double, sz double, tx double, ty double, tz double")
    out = {r["k"]: r for r in G.fit_rigid(pairs, "k").collect()}
    assert out[1]["status"] == "ok" and out[1]["rmse"] < 1e-8 and abs(out[1]["r10"] - np.sin(a)) < 1e-9 and out[2]["status"] == "degenerate"
    grid = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(3)], float)
    _, shift, history = G.icp(cloud(spark, grid + [0.1, -0.05, 0.08]), cloud(spark, grid), 0.5, max_iterations=5)
    assert np.allclose(shift, [-0.1, 0.05, -0.08], atol=1e-9) and history[-1] < 1e-8


def test_knn_ratio_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((60, 8)), rng.random((50, 8))
    mk = lambda m, o: spark.createDataFrame([(1, i + o, list(map(float, v))) for i, v in enumerate(m)], "k long, vec_id long, embedding array<double>")
    got = {r["a_id"]: r["b_id"] for r in G.knn_ratio_match(mk(a, 0), mk(b, 1000), ["k"], 0.9, block=16).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    o = np.argsort(d, axis=1)
    want = {i: int(o[i, 0]) + 1000 for i in range(60) if d[i, o[i, 0]] < 0.9 * d[i, o[i, 1]]}
    assert got == want


def test_match_association_is_unique_and_capped(spark):
    rng = np.random.default_rng(6)
    proj = spark.createDataFrame([(0, f"p{i}", float(u), float(v), 1.0, True) for i, (u, v) in enumerate(rng.random((200, 2)) * 300)], "view_id long, point_id string, u double, v double, depth double, in_frame boolean")
    m = [(0, f"m{i:03d}", *map(float, rng.random(2) * 300), *map(float, rng.random(2) * 300), float(rng.random() * 50)) for i in range(300)]
    out = G.associate_matches(spark.createDataFrame(m, "view_id long, match_id string, au double, av double, tu double, tv double, distance double"), proj, cap=40).collect()
    pts = {r["point_id"]: (r["u"], r["v"]) for r in proj.collect()}
    cand = []
    for _, mid, au, av, tu, tv, d in m:
        near = min(((np.hypot(u - au, v - av), p) for p, (u, v) in pts.items()))
        if near[0] < 10:
            cand.append((d + near[0] * 4, mid, near[1], (int(tu // 12), int(tv // 12))))
    used, cells, want = set(), set(), []
    for s, mid, p, c in sorted(cand):
        if len(want) < 40 and p not in used and c not in cells:
            used.add(p), cells.add(c), want.append(mid)
    assert sorted(r["match_id"] for r in out) == sorted(want)


SPATIAL = "campaign_id long, record_id long, damage_class string, host_id long, x double, y double, z double, metric_value double"


def greedy(prev, cur, max_d):
    used, out = set(), {}
    for c in sorted(cur, key=lambda r: r[1]):
        best = sorted((np.sqrt(sum((c[k] - p[k]) ** 2 for k in (4, 5, 6))), p[1]) for p in prev if p[1] not in used and p[2] == c[2] and (p[3] is None or c[3] is None or p[3] == c[3]))
        if best and best[0][0] <= max_d:
            used.add(best[0][1])
            out[c[1]] = best[0][1]
    return out


def test_campaign_matching_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(11)
    mk = lambda camp, base: [(camp, base + i, "cracks" if i % 2 else "spalling_dark", None if i % 3 else int(i % 2), *map(float, rng.random(2) * 6), 0.0, float(i % 5)) for i in range(120)]
    prev, cur = mk(1, 0), mk(2, 1000)
    p, c = (spark.createDataFrame(r, SPATIAL).withColumn("pair", F.lit(1)) for r in (prev, cur))
    got = {r["record_id"]: r["previous_id"] for r in H.match_campaigns(p, c.repartition(5), ["pair"]).collect() if r["previous_id"] is not None}
    assert got == greedy(prev, cur, 0.5)


def test_timeline_tracks(spark):
    rows = [(1, 1, "cracks", None, 0.0, 0.0, 0.0, 10.0), (2, 2, "cracks", None, 0.1, 0.0, 0.0, 12.0), (3, 3, "cracks", None, 0.2, 0.0, 0.0, 12.1), (2, 5, "cracks", None, 50.0, 0.0, 0.0, 5.0), (3, 6, "cracks", None, 50.1, 0.0, 0.0, None),
            (3, 7, "cracks", None, None, None, None, 1.0)]
    t = {r["record_id"]: r for r in H.damage_timeline(spark.createDataFrame(rows, SPATIAL)).collect()}
    assert [t[i]["track_id"] for i in (1, 2, 3)] == ["cdm3-track-1"] * 3 and t[5]["track_id"] is None and t[6]["track_id"] == "cdm3-track-5"
    assert (t[1]["change_status"], t[2]["change_status"], t[3]["change_status"], t[5]["change_status"], t[6]["change_status"], t[7]["change_status"]) == ("baseline", "grown", "stable", "unmatched", "matched_not_quantified", "not_comparable")
    tracks = {r["track_id"]: r["observation_count"] for r in H.damage_tracks(H.damage_timeline(spark.createDataFrame(rows, SPATIAL))).collect()}
    assert tracks == {"cdm3-track-1": 3, "cdm3-track-5": 1}


def test_triangle_distance_on_tilted_faces(spark):
    rng = np.random.default_rng(12)
    rows, want = [], []
    for i in range(40):
        p, a, b, c = rng.random((4, 3)) * 4
        s = rng.dirichlet((1, 1, 1), 4000)
        want.append(np.sqrt(((s @ np.array([a, b, c]) - p) ** 2).sum(1)).min())
        rows.append((i, *map(float, (*p, *a, *b, *c))))
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, ax double, ay double, az double, bx double, by_ double, bz double, cx double, cy double, cz double")
    d = H.point_triangle_distance([F.col(k) for k in "xyz"], *[[F.col(k) for k in t] for t in H.TRI])
    got = [r["d"] for r in df.select("id", d.alias("d")).orderBy("id").collect()]
    assert all(g <= w + 1e-9 and w - g < 0.12 for g, w in zip(got, want))
