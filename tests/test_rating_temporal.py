import numpy as np
from pyspark.sql import functions as F

from defectlake.functions.rating import RatingConfig
from defectlake.operators import rating as R
from defectlake.operators import temporal as T

RECORD = "record_id string, image_id long, time_label string, damage_class string, area_px2 double, length_px double, width_px double, perimeter_px double, bbox_x long, bbox_y long, bbox_w long, bbox_h long, mm_per_px double"


def sequential_regions(rows, min_area):
    largest = max(r[4] for r in rows)
    kept = []
    for r in sorted((r for r in rows if r[4] >= max(min_area, 0.0005 * 90000, 0.03 * largest)), key=lambda r: (-r[4], r[0])):
        for k in kept:
            ix = max(0, min(r[8] + r[10], k["b"][0] + k["b"][2]) - max(r[8], k["b"][0]))
            iy = max(0, min(r[9] + r[11], k["b"][1] + k["b"][3]) - max(r[9], k["b"][1]))
            if ix * iy >= 0.8 * r[10] * r[11]:
                k["area"] += r[4]
                break
        else:
            kept.append({"id": r[0], "area": r[4], "b": r[8:12]})
    return {k["id"]: k["area"] for k in kept}


def test_regions_match_the_sequential_rule(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        x, y, w, h = (int(v) for v in (rng.integers(0, 260), rng.integers(0, 260), rng.integers(5, 80), rng.integers(5, 80)))
        rows.append((f"r{i:03d}", 1, "t1_current", "spalling_dark", float(w * h), 1.0, 1.0, 1.0, x, y, w, h, None))
    df = spark.createDataFrame(rows, RECORD)
    got = {r["record_id"]: r["area_px2"] for r in R.consolidate_regions(df.repartition(4), F.lit(90000), 30.0, cell=32.0).collect()}
    assert got == sequential_regions(rows, 30.0)


def test_rating_of_an_image_without_damage_and_emergency(spark):
    rows = [("a", 1, "t1_current", "exposed_rebar", 9000.0, 10.0, 5.0, 1.0, 0, 0, 10, 10, None), ("b", 2, "t0_previous", "cracks", 10.0, 10.0, 5.0, 1.0, 0, 0, 10, 10, None)]
    df = spark.createDataFrame(rows, RECORD)
    cfg = RatingConfig(allow_emergency=True)
    images = df.select("image_id").distinct()
    rated = R.rate_damages(df, F.lit(1_000_000), cfg)
    out = {r["image_id"]: r for r in R.element_rating(images, rated, cfg).collect()}
    assert out[2]["nt"] == 5 and out[2]["ec"] == 4 and out[2]["element_rank"] == 0
    assert out[1]["nt"] == 0 and out[1]["nt_label"] == "Emergencial"
    fam = R.family_summary(images, rated, cfg).collect()
    assert len(fam) == 10 and {r["family_ec"] for r in fam if r["n"] == 0} == {4}
    assert {r["image_id"]: r["gde"] for r in R.gde(images, rated).collect()}[2] == 0.0


def scene(seed=1, h=72, w=96):
    rng = np.random.default_rng(seed)
    base = rng.integers(60, 200, (h // 6 + 1, w // 6 + 1)).repeat(6, 0).repeat(6, 1)[:h, :w]
    return base.astype(int)


def pixels(spark, image, image_id=1):
    rows = [(image_id, y, x, int(image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y long, x long, g long")


def test_registration_recovers_a_known_shift_and_gate_reacts(spark):
    cur = scene()
    prev = np.roll(cur, (4, -6), (0, 1))
    c, p = pixels(spark, cur), pixels(spark, prev)
    radius = T.search_radius(72, 96, 1)
    s = T.best_shift(T.shift_scores(T.edge_map(c), T.edge_map(p), 72, 96), radius)
    row = s.first()
    assert (row["dx"], row["dy"], row["accepted"]) == (6, -4, True)
    aligned = T.apply_shift(p, c, s)
    assert aligned.join(c.withColumnRenamed("g", "t"), ["image_id", "y", "x"]).where("g <> t").count() == 0
    good = T.temporal_gate(T.pair_quality_metrics(c, aligned, s, 72, 96)).first()
    assert good["status"] in ("pass", "warning") and good["validated"]
    bright = T.temporal_gate(T.pair_quality_metrics(c, aligned.withColumn("g", F.least(F.lit(255), F.col("g") + 70)), s, 72, 96)).first()
    assert bright["status"] == "fail" and "illumination_mismatch" in bright["issues"]
    far = T.best_shift(T.shift_scores(T.edge_map(c), T.edge_map(pixels(spark, np.roll(cur, 9, 1))), 72, 96), radius).first()
    assert far["reason"] == "search_boundary_hit" or not far["accepted"]


def test_mask_change_edge_cases(spark):
    m = spark.createDataFrame([(1, "cracks", "t1", 0, x) for x in range(4)] + [(2, "cracks", "t0", 0, 0), (2, "cracks", "t1", 0, 0), (2, "cracks", "t1", 0, 1)], "pair_id long, damage_class string, epoch string, y long, x long")
    out = {r["pair_id"]: r for r in T.mask_change(m).collect()}
    assert out[1]["growth_pct"] is None and out[1]["growth_px2"] == 4 and out[1]["growth_mm2"] is None
    assert out[2]["iou"] == 0.5 and out[2]["growth_pct"] == 100.0
