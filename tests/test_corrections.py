"""Cases that decide single rules: long chains, small images, abstention, unlike metrics, replayed batches, sinks."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from defectlake import session
from defectlake.operators import campaign, cloud, context, raster, spatial, temporal, tracking
from defectlake.sources import readers, schemas, writers
from defectlake.streaming import live


def test_retention_follows_a_long_chain_and_a_ring(spark):
    chain = [(i, i - 1 if i else None) for i in range(5000)]
    ring = [(10_000, 10_002), (10_001, 10_000), (10_002, 10_001)]
    rows = spark.createDataFrame([(i, r, f"2020-01-01 00:00:{0:02d}") for i, r in chain + ring], "inspection_id long, reference_origin_id long, created_at string")
    kept = {r["inspection_id"] for r in campaign.retain_recent(rows, 4).select("inspection_id").collect()}
    assert kept == {i for i, _ in ring} | set(range(5000))


def test_small_pairs_keep_a_row(spark):
    pixels = spark.createDataFrame([(1, y, x, 100 + y * x) for y in range(4) for x in range(4)], "image_id long, y long, x long, g long")
    edge = temporal.edge_map(pixels)
    shift = temporal.best_shift(temporal.shift_scores(edge, edge, 4, 4), temporal.search_radius(4, 4, 1))
    row = shift.first()
    assert row["reason"] == "image_too_small" and (row["dx"], row["dy"], row["accepted"], row["score_before"]) == (0, 0, False, 0.0)
    assert temporal.temporal_gate(temporal.pair_quality_metrics(pixels, temporal.apply_shift(pixels, pixels, shift), shift, 4, 4)).first()["issues"][0] == "registration_unreliable"


def test_large_edge_maps_are_refused(spark):
    edge = spark.createDataFrame([], "image_id long, y long, x long, edge double")
    with pytest.raises(ValueError, match="registration_step"):
        temporal.shift_scores(edge, edge, 200, 400)
    assert temporal.registration_step(200, 400) == 3


def test_scene_names_and_abstention(spark):
    names = spark.createDataFrame([("Floor, flooring",), (" sky; clouds ",), ("thing",), (None,)], "label string")
    assert [r[0] for r in names.select(context.scene_group(F.col("label"))).collect()] == ["structure", "irrelevant", "neutral", "neutral"]
    cells = [(i, y, x, 1.0, 1, "sky", "irrelevant") if i == 1 or y < 3 else (i, y, x, 1.0, 0, "wall", "structure") for i in (1, 2) for y in range(4) for x in range(4)]
    cells = spark.createDataFrame(cells, "image_id long, cell_y long, cell_x long, conf double, class_id long, label string, scene_group string")
    assert {r["image_id"] for r in context.gating_mask(cells).collect()} == {2}
    assert {r["image_id"] for r in context.gating_mask(cells, abstain=False).collect()} == {1, 2}


def test_cracks_are_not_cut_unless_asked(spark):
    excluded = spark.createDataFrame([(1, y, x) for y in range(4) for x in range(4)], "image_id long, cell_y long, cell_x long")
    mask = spark.createDataFrame([(1, c, y, 20) for c in ("cracks", "spalling_dark") for y in range(40)], "image_id long, damage_class string, y long, x long")
    count = lambda **o: {r["damage_class"]: r["count"] for r in context.clip_by_context(mask, excluded, ["image_id", "damage_class"], (4, 4), (40, 40), **o).groupBy("damage_class").count().collect()}
    assert count() == {"cracks": 40} and count(include_cracks=True) == {}


def test_crack_gaps_of_up_to_eight_pixels_join(spark):
    line = lambda gap: [(1, 10, x) for x in range(0, 30)] + [(1, 10, x) for x in range(30 + gap - 1, 60)]
    for gap, groups in ((7, 1), (9, 1), (10, 2)):  # pixels 4 + 4 + 1 apart touch after both grow by four
        frag = spark.createDataFrame(line(gap), "image_id long, y long, x long")
        assert raster.crack_measures(frag, frag, ["image_id"], 64, 64, min_area=5).count() == groups, gap


RECORD = "campaign_id long, record_id long, damage_class string, host_id long, x double, y double, z double, metric_value double, metric_kind string, metric_unit string, metric_comparable boolean, observed_at string"


def test_only_like_metrics_are_compared(spark):
    rows = [(1, 10, "cracks", None, 0.0, 0.0, 0.0, 2.0, "area", "mm2", True), (1, 11, "cracks", None, 5.0, 0.0, 0.0, 2.0, "length", "mm", True), (1, 12, "cracks", None, 9.0, 0.0, 0.0, 2.0, "area", " ", True), (1, 13, "cracks", None, 13.0, 0.0, 0.0, 2.0, "area", "mm2", False)]
    old = spark.createDataFrame([(*r, None) for r in rows], RECORD).withColumn("pair", F.lit(1))
    new = spark.createDataFrame([(2, r[1] + 10, *r[2:7], 3.0, "area", "mm2", True, None) for r in rows], RECORD).withColumn("pair", F.lit(1))
    got = {r["record_id"]: (r["change_status"], r["change_ratio"]) for r in tracking.match_campaigns(old, new, ["pair"]).collect()}
    assert got == {20: ("grown", 0.5), 21: ("matched_not_quantified", None), 22: ("matched_not_quantified", None), 23: ("matched_not_quantified", None)}


def test_timeline_goes_by_date_with_undated_campaigns_last(spark):
    one = lambda c, r, date: (c, r, "cracks", None, 0.0, 0.0, 0.0, 1.0, "area", "mm2", True, date)
    rows = spark.createDataFrame([one(1, 30, ""), one(2, 20, "2021-01-01"), one(3, 10, "2020-01-01")], RECORD)
    timeline = {r["record_id"]: r["previous_id"] for r in tracking.damage_timeline(rows).collect()}
    assert timeline == {10: None, 20: 10, 30: 20}
    assert [o["record_id"] for o in tracking.damage_tracks(tracking.damage_timeline(rows)).first()["observations"]] == [10, 20, 30]


def test_stations_on_a_long_alignment(spark):
    count = 3000
    line = spark.createDataFrame([(i, float(i), 3.0 * math.sin(i / 50), 0.0) for i in range(count)], "seq long, x double, y double, z double")
    segments = tracking.alignment_segments(line)
    points = spark.createDataFrame([(1, 1500.2, 8.0, 1.0), (2, -400.0, 0.0, 0.0), (3, 2e5, 7.0, 0.0), (4, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r["id"]: r for r in tracking.station_on_alignment(points, segments, "id").collect()}
    rows = sorted(segments.collect(), key=lambda r: r["seq"])
    assert set(got) == {1, 2, 3}
    for p in points.collect()[:3]:
        best = None
        for s in rows:
            d = [s[f"e{k}"] - s[f"s{k}"] for k in "xyz"]
            t = min(1, max(0, sum((p[k] - s[f"s{k}"]) * d[i] for i, k in enumerate("xyz")) / s["length"] ** 2))
            off = math.dist([p[k] for k in "xyz"], [s[f"s{k}"] + t * d[i] for i, k in enumerate("xyz")])
            if best is None or off < best[0] - 1e-12:
                best = (off, s["walked"] + t * s["length"])
        assert abs(got[p["id"]]["offset"] - best[0]) < 1e-9 and abs(got[p["id"]]["station"] - best[1]) < 1e-6
    back = tracking.point_at_station(spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.37)], "id long, ratio double"), segments, "id").collect()
    total = rows[0]["total"]
    for r in back:
        assert abs(r["distance"] - {1: 0.0, 2: total, 3: 0.37 * total}[r["id"]]) < 1e-6
    assert {r["id"] for r in back} == {1, 2, 3} and abs(next(r for r in back if r["id"] == 2)["x"] - (count - 1)) < 1e-9


def test_moments_survive_map_coordinates(spark):
    flat = [(x / 64, y / 64, 0.0) for x in range(20) for y in range(20)]  # exact in binary at either place
    kinds = []
    for shift in (0.0, 2.0**22):
        points = spark.createDataFrame([(0, x + shift, y + shift, z + shift) for x, y, z in flat], "cloud_id long, x double, y double, z double")
        kinds.append(sorted((r["ix"], r["iy"], r["iz"], r["class_id"]) for r in cloud.geometry_voxels(points).collect()))
    assert kinds[0] == kinds[1] and {k[3] for k in kinds[0]} >= {2}


def test_nearest_point_skips_broken_coordinates(spark):
    queries = spark.createDataFrame([(0.0, 0.0), (float("nan"), 1.0), (None, 1.0), (1e7, 0.0)], "x double, y double")
    points = spark.createDataFrame([(1, 0.5, 0.0), (2, float("inf"), 0.0)], "id long, x double, y double")
    got = {r["x"]: r["point_id"] for r in spatial.nearest_within(queries, points, [], ["x", "y"], "id", None, 1.0).collect()}
    assert got == {0.0: 1, 1e7: 1}


def test_average_of_a_long_session(spark):
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("session_id"), (F.col("id") + 1).alias("seq"), ((F.col("id") * 7919) % 101).cast("double").alias("v"))
    got = {r["seq"]: r["ema"] for r in live.ema(rows, ["session_id"], "seq", "v", 0.3, F.floor(F.col("seq") / 4000)).collect()}
    acc = None
    for seq in range(1, 30_001):
        v = float((seq - 1) * 7919 % 101)
        acc = v if acc is None else acc * 0.7 + v * 0.3
        if seq % 1777 == 0 or seq in (1, 2, 3999, 4000, 4001):
            assert abs(got[seq] - acc) < 1e-9
    assert len(got) == 30_000


def test_context_is_refreshed_by_the_frames_that_arrive(spark):
    seqs = [1, 2, 4, 5, 6, 7, 8, 9, 11, 12]
    frames = spark.createDataFrame([(1, s, f"f{s}") for s in seqs], "session_id long, seq long, scene string")
    got = {r["seq"]: r["context_seq"] for r in live.context_refresh(frames.drop("scene"), frames, 3).collect()}
    assert got == {1: 1, 2: 2, 4: 2, 5: 2, 6: 6, 7: 6, 8: 6, 9: 9, 11: 9, 12: 9}


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    schema = "frame_id long, y long, x long"
    for part, frame in enumerate((1, 2)):
        spark.createDataFrame([(frame, y, x) for y in range(3) for x in range(3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        masks = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        live.write_frame_components(masks, f"{tmp_path}/out", 8, 8, f"{tmp_path}/state").awaitTermination()
    # Losing the commit of the last batch makes the stream run it again.
    last = sorted((tmp_path / "state/commits").glob("[0-9]*"))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    live.write_frame_components(masks, f"{tmp_path}/out", 8, 8, f"{tmp_path}/state").awaitTermination()
    assert sorted(r["frame_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def record(i: int, cls: str = "cracks") -> tuple:
    points = [(1.0, 2.0), (5.0, 2.0)]
    return (f"r{i}", 7, cls, "t1_current", points, False, 12.0, 10.0, 1, 2, 5, 3, 1.5, 4.0, 2.0, 0.5, "a note")


def test_sinks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([record(1), record(2, "spalling_dark")], schemas.RECORDS)
    writers.write_records_csv(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", True).option("sep", ";").csv(f"{tmp_path}/csv").count() == 2 or spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    writers.write_coco(rows, spark.createDataFrame([(7, "a.png")], "id long, file_name string"), f"{tmp_path}/coco")
    notes = spark.read.json(f"{tmp_path}/coco/annotations").orderBy("id").collect()
    assert [n["id"] for n in notes] == [1, 2] and notes[0]["attributes"]["aspect_ratio"] == 1.5 and notes[0]["attributes"]["note"] == "a note"
    assert {r["name"] for r in spark.read.json(f"{tmp_path}/coco/categories").collect()} >= {"crack", "spalling", "temporal_growth"}
    writers.write_bim_features(rows, f"{tmp_path}/bim")
    assert spark.read.json(f"{tmp_path}/bim").count() == 2
    writers.write_pathology_properties(rows.select("record_id", "damage_class"), f"{tmp_path}/properties")
    assert spark.read.parquet(f"{tmp_path}/properties").where("property = 'DamageClass'").count() == 2


def test_campaign_documents_are_whole_unless_asked(spark, tmp_path):
    import datetime

    base = datetime.datetime(2020, 1, 1)
    rows = spark.createDataFrame([(i, 1, 1, "s", base + datetime.timedelta(days=i), i > 0, i - 1 if i else None, "linked_inspection", False, i, i - 1, 1.0, "pass") for i in range(25)], schemas.INSPECTIONS)
    writers.write_campaign_json(rows, f"{tmp_path}/one")
    assert [len(r["chain_edges"]) for r in spark.read.json(f"{tmp_path}/one").collect()] == [25]
    writers.write_campaign_json(rows, f"{tmp_path}/parts", part_rows=10)
    assert sorted(len(r["chain_edges"]) for r in spark.read.json(f"{tmp_path}/parts").collect()) == [5, 10, 10]
    snapshots = rows.select("inspection_id", "asset_id", "element_id", "created_at", F.lit("cracks").alias("damage_class"), F.lit(9.0).alias("area_px2"), F.lit(0.5).alias("mm_per_px"), F.lit(4.0).alias("previous_area_px2"))
    writers.write_campaign_events(rows, snapshots, f"{tmp_path}/events")
    events = spark.read.option("header", True).option("sep", ";").csv(f"{tmp_path}/events")
    assert {r["record_type"] for r in events.select("record_type").distinct().collect()} == {"condition", "snapshot_pathology_area", "temporal"}


def test_stored_tables_read_with_missing_columns(spark, tmp_path):
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    spark.createDataFrame([("r1", 3)], "record_id string, image_id long").write.mode("overwrite").parquet(f"{tmp_path}/records")
    row = readers.read_inspection_tables(spark, str(tmp_path))["records"].first()
    assert (row["record_id"], row["image_id"], row["note"]) == ("r1", 3, None)


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Fake)


def test_prices_round_as_the_sql_does(spark):
    from defectlake.functions.geometry import round_scaled
    from defectlake.sources.fixtures import _spark_text
    text = _spark_text("SELECT round(p/1000,2) r FROM VALUES (153545.0D), (2500.0D) t(p)")
    assert [r["r"] for r in spark.sql(text).collect()] == [153.54, 2.5]
    assert spark.range(1).select(round_scaled(F.lit(153.545), 2).alias("r")).first()["r"] == 153.54


def test_a_fold_keeps_its_keys_whole_above_a_join_that_turns_into_a_broadcast(spark):
    """The side is small only once it has run, so the join gets its shuffle first and then reads it by map tasks."""
    side = spark.range(5_000_000).where("id < 50").select(F.col("id").alias("k"))
    rows = spark.range(0, 1_500_000, 1, 8).select((F.col("id") % 50).alias("k"), "id").join(side, "k")

    def step(state, arrays):
        out = [state[0] + i + 1 for i in range(len(arrays[0]))]
        state[0] += len(arrays[0])
        return out

    from pyspark.sql import types as T
    out = spatial.ordered_fold(rows, ["k"], [F.col("id")], lambda: [0], step, ["id"], "n", T.LongType())
    assert {r["m"] for r in out.groupBy("k").agg(F.max("n").alias("m")).collect()} == {30_000}


def test_near_pairs_do_not_trust_the_estimate_of_a_checkpointed_table(spark):
    """The copies of a small table may be many times its size: no side is broadcast on Spark's estimate."""
    rows = session.checkpoint(spark.range(100).select(F.col("id").alias("i"), *[(F.col("id") * 0.5).alias(a) for a in "xyz"]))
    pairs = spatial.near_pairs(rows, rows, [], ["x", "y", "z"], 1.0)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    wide = spatial.near_pairs(rows, rows, [], ["x", "y", "z"], 1.0, cell=4.0)
    assert sorted((r["l_i"], r["r_i"]) for r in wide.collect()) == sorted((r["l_i"], r["r_i"]) for r in pairs.collect()) == [(i, j) for i in range(100) for j in range(max(0, i - 1), min(99, i + 1) + 1)]


def test_icp_moves_a_place_once_and_counts_its_copies(spark):
    from unittest import mock
    spots = [(f"p{i}", float(i % 4), float(i // 4 % 3), float(i // 12) * 1.5) for i in range(24)]
    points = spark.createDataFrame(spots + [("again", *spots[0][1:])] * 5, "point_id string, x double, y double, z double")
    moved = points.withColumn("x", F.col("x") + 0.05)
    seen = []
    real = spatial.near_pairs
    with mock.patch.object(spatial, "near_pairs", side_effect=lambda left, *a, **k: (seen.append((left.count(), left.columns)), real(left, *a, **k))[1]):
        rotation, shift, history = cloud.icp(moved, points, 0.5)
    assert [round(v, 6) for v in shift] == [-0.05, 0, 0] and round(history[-1], 6) == 0
    assert seen[0] == (24, ["x", "y", "z", "copies"])  # no ids travel with the copies, and equal points go once


def test_records_meet_in_cells_wider_than_the_distance(spark, monkeypatch):
    """The wider cells copy a record a few times instead of 27, and give the same pairs."""
    rows = [(1, "cracks", i, None, i % 7 * 0.4, i // 7 % 7 * 0.4, i // 49 * 0.4) for i in range(147)]
    df = spark.createDataFrame(rows, "k long, damage_class string, record_id long, host_id long, x double, y double, z double")
    cells = []
    monkeypatch.setattr(tracking, "near_pairs", lambda *a, **k: (cells.append(k.get("cell")), spatial.near_pairs(*a, **k))[1])
    got = {(r["l_record_id"], r["r_record_id"]) for r in tracking.candidate_pairs(df, df, ["k"], 0.5).collect()}
    assert got == {(a[2], b[2]) for a in rows for b in rows if math.dist(a[4:], b[4:]) <= 0.5}
    assert cells[0] is not None and cells[0] >= 1.0
