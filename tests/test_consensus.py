import numpy as np
from pyspark.sql import functions as F

from defectlake.functions.taxonomy import canonicalize, clean_label, display_name
from defectlake.operators import consensus as con


def test_labels(spark):
    rows = [("Cracks",), ("  rust  corrosion",), ("water-leak",), ("Exposed_Rebar",), ("concrete cracking",), ("graffiti tag",), (None,), ("",), ("micro_crack zone",)]
    df = spark.createDataFrame(rows, "label string")
    got = {r["label"]: (r["c"], r["k"], r["d"]) for r in df.select("label", clean_label(F.col("label")).alias("c"), canonicalize(F.col("label")).alias("k"), display_name(canonicalize(F.col("label"))).alias("d")).collect()}
    assert got["Cracks"][1] == "crack" and got["Cracks"][2] == "Fissura"
    assert got["  rust  corrosion"][:2] == ("rust corrosion", "corrosion")
    assert got["water-leak"][1] == "moisture"
    assert got["Exposed_Rebar"][1] == "exposed_rebar"
    assert got["concrete cracking"][1] == "crack"
    assert got["graffiti tag"][1:] == ("graffiti_tag", "Graffiti Tag")
    assert got[None][1] == got[""][1] == "unknown"
    assert got["micro_crack zone"][1] == "crack"


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = max(0, a[2] - a[0]) * max(0, a[3] - a[1]) + max(0, b[2] - b[0]) * max(0, b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0


def sequential_clusters(dets, min_iou):
    out, clusters = {}, []
    for d in sorted(dets, key=lambda d: (-(d["score"] if d["score"] is not None else -1), d["det_id"])):
        best, top = None, 0
        for i, c in enumerate(clusters):
            v = iou(d["box"], [round(x, 2) for x in np.mean(c, axis=0)])
            if v > top:
                best, top = i, v
        if best is None or top < min_iou:
            clusters.append([d["box"]])
            best = len(clusters) - 1
        else:
            clusters[best].append(d["box"])
        out[d["det_id"]] = best
    return out


def test_clusters_match_the_sequential_algorithm(spark):
    rng = np.random.default_rng(7)
    dets = []
    for i in range(400):
        x, y, w, h = rng.integers(0, 400), rng.integers(0, 60), rng.integers(10, 60), rng.integers(10, 40)
        dets.append({"det_id": f"d{i:04d}", "score": None if i % 11 == 0 else float(rng.integers(0, 50)) / 50, "box": [float(x), float(y), float(x + w), float(y + h)]})
    rows = [(1, f"e{i % 3}", "crack", d["det_id"], d["score"], *d["box"]) for i, d in enumerate(dets)]
    df = spark.createDataFrame(rows, "image_id long, engine_id string, label string, det_id string, score double, x1 double, y1 double, x2 double, y2 double")
    runs = spark.createDataFrame([(1, f"e{i}", "ok") for i in range(3)] + [(1, "e9", "error")], "image_id long, engine_id string, status string")
    want = sequential_clusters(dets, 0.25)
    for parts in (1, 5):
        got = {}
        for r in con.spatial_clusters(runs, df.repartition(parts), 0.25, cell=16.0).collect():
            got[r["det_id"]] = (r["island_x"], r["island_y"], r["cluster"])
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
        assert groups(got) == groups(want)
    assert len(set(v[:2] for v in got.values())) >= 1
    summary = con.spatial_consensus(runs, df, 0.25).collect()
    assert sorted(r["cluster_id"] for r in summary) == list(range(1, len(set(want.values())) + 1))
    assert all(r["successful_engine_count"] == 3 for r in summary)


def test_pairs_by_id_equal_brute_force_with_copies(spark):
    rng = np.random.default_rng(3)
    boxes = [[float(x), float(y), float(x + 30), float(y + 20)] for x, y in rng.integers(0, 120, (60, 2))]
    boxes += boxes[:10] + boxes[:3]
    rows = [(1, "e", "crack", f"d{i:03d}", 0.5, *b) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "image_id long, engine_id string, label string, det_id string, score double, x1 double, y1 double, x2 double, y2 double")
    want = {frozenset((f"d{i:03d}", f"d{j:03d}")) for i in range(len(boxes)) for j in range(i) if iou(boxes[i], boxes[j]) >= 0.25}
    pairs = con.pairwise_iou_ids(df, 0.25).collect()
    assert {frozenset((r["det_a"], r["det_b"])) for r in pairs} == want and len(pairs) == len(want)
    assert con.pairwise_iou(df, 0.25).agg(F.sum("n_pairs")).first()[0] == len(want)


def test_engine_without_detections_counts_in_the_denominator(spark):
    runs = spark.createDataFrame([(1, "a", "ok"), (1, "b", "ok"), (1, "c", "error")], "image_id long, engine_id string, status string")
    dets = spark.createDataFrame([(1, "a", "crack", 0.5), (1, "c", "crack", 0.9)], "image_id long, engine_id string, label string, score double")
    r = con.label_consensus(runs, dets).collect()
    assert len(r) == 1 and r[0]["agreement_ratio"] == 0.5 and r[0]["engines"] == ["a"] and r[0]["mean_score"] == 0.5
