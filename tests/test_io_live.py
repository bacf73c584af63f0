import hashlib
import json
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from defectlake.sources import las_ranges, readers, writers
from defectlake.sources.fixtures import _lines
from defectlake.streaming import live


def test_xyz_text(spark, tmp_path):
    f = tmp_path / "a.xyz"
    f.write_text("# header\n1 2 3 255 0 10\n1,2;4, 0 255 10\n\n// note\n5 6 7 1 2 3\nbad line\n1 2\n")
    out = readers.read_xyz(spark, str(f))
    c = readers.xyz_counts(out).first()
    assert (c["valid_points"], c["skipped_lines"], c["has_rgb"]) == (3, 2, True)
    assert out.where("valid").agg(F.sum("z")).first()[0] == 14


def test_assets_and_catalog(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(b"abc")
    (tmp_path / "b.ifc").write_bytes(b"ISO-10303-21")
    got = {r["name"]: r for r in readers.list_assets(spark, str(tmp_path)).collect()}
    assert got["a.JPG"]["kind"] == "2d" and got["a.JPG"]["sha256"] == hashlib.sha256(b"abc").hexdigest() and got["b.ifc"]["kind"] == "spatial"
    cat = tmp_path / "c" / "catalog.json"
    cat.parent.mkdir()
    cat.write_text(json.dumps({"version": 1, "engines": [{"id": "cdm_1", "name": "x", "recommended": True, "extra": 5}, {"id": "b", "name": "y"}]}))
    rows = readers.read_catalog(spark, str(cat)).collect()
    assert [r["id"] for r in rows] == ["cdm_1", "b"] and rows[0]["recommended"] is True and rows[1]["recommended"] is None


def test_comparison_csv(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a", "ok", 5.0), (1, "b", "error", 1.0)], "image_id long, engine_id string, status string, latency_ms double")
    dets = spark.createDataFrame([(1, "a", 'crack "x"', 0.5, 1.0, 2.0, 3.0, 4.0, 4.0)], "image_id long, engine_id string, label string, score double, x1 double, y1 double, x2 double, y2 double, area_px double")
    rows = {r["engine_id"]: r for r in writers.comparison_rows(runs, dets).collect()}
    assert rows["a"]["detections"] == 1 and rows["b"]["detections"] == 0 and rows["b"]["label"] is None
    writers.write_comparison_csv(runs, dets, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "out"))
    assert back.count() == 2 and "canonical_label" in back.columns


def test_copies_get_distinct_ids(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(50)
    out = _lines(li.unionByName(li).unionByName(li.limit(10)))
    assert out.count() == 110 and out.select("line_id").distinct().count() == 110


def frames(n=60):
    rng = np.random.default_rng(4)
    return [(int(i % 3), int(i // 3 + 1), datetime(2024, 5, 1) + timedelta(seconds=int(i) * 7), 20, ["crack", "rust"][int(rng.integers(0, 2))], int(rng.integers(0, 6))) for i in range(n)]


def stream_folder(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, live.FRAME_SCHEMA)
    path = str(tmp_path / "frames")
    df.repartition(4).write.parquet(path)
    return path


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_totals_and_duplicates(spark, tmp_path):
    rows = frames()
    path = stream_folder(spark, tmp_path, rows + rows[:7])
    got = {(r["session_id"], r["label"]): (r["max_n"], r["frames"]) for r in drain(live.session_totals(live.read_frames(spark, path)), "totals", "complete").collect()}
    want = {(r["session_id"], r["label"]): (r["max_n"], r["frames"]) for r in live.session_totals(spark.createDataFrame(rows, live.FRAME_SCHEMA)).collect()}
    assert got == want


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = frames()
    path = stream_folder(spark, tmp_path, rows)
    stream = drain(live.windowed_counts(live.read_frames(spark, path), "1 minute"), "windows", "complete").collect()
    batch = live.windowed_counts(spark.createDataFrame(rows, live.FRAME_SCHEMA), "1 minute").collect()
    assert sorted(stream) == sorted(batch)


def test_stream_mask_average_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(s, "cracks", seq, [int(v) for v in rng.integers(0, 2, 5)]) for s in (1, 2) for seq in range(1, 13)]
    path = str(tmp_path / "cells")
    df = spark.createDataFrame(rows, "session_id long, layer string, seq long, cells array<int>")
    df.orderBy("seq").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = {(r["session_id"], r["seq"]): (np.round(r["ema"], 9).tolist(), r["show"]) for r in drain(live.ema_masks_stream(stream), "ema").collect()}
    flat = df.select("session_id", "layer", "seq", F.posexplode("cells").alias("cell", "on"))
    batch = live.ema_masks(flat, F.floor(F.col("seq") / 5)).groupBy("session_id", "seq").agg(F.array_sort(F.collect_list(F.struct("cell", "ema", "show"))).alias("c")).collect()
    assert len(got) == 24
    for r in batch:
        e, show = got[(r["session_id"], r["seq"])]
        assert np.allclose(e, [c["ema"] for c in r["c"]]) and show == [c["show"] for c in r["c"]]


def test_throttle_keeps_the_newest(spark):
    rows = [(1, i, datetime(2024, 1, 1) + timedelta(milliseconds=100 * i), 5, "crack", 1) for i in range(20)]
    out = live.throttle_frames(spark.createDataFrame(rows, live.FRAME_SCHEMA), 2)
    assert sorted(r["seq"] for r in out.collect()) == [4, 9, 14, 19]


def test_las_files(spark, tmp_path):
    import struct

    def las(points, kind=3, size=34, count=None, version=2):
        head = bytearray(227 if version < 4 else 375)
        head[:4], head[24], head[25] = b"LASF", 1, version
        struct.pack_into("<I", head, 96, len(head))
        struct.pack_into("<BHI", head, 104, kind, size, (len(points) if count is None else count) if version < 4 else 0)
        struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.5, 10.0, 20.0, 30.0)
        if version >= 4:
            struct.pack_into("<Q", head, 247, len(points))
        body = b""
        for x, y, z, i, c, r in points:
            rec = bytearray(size)
            struct.pack_into("<iiiH", rec, 0, x, y, z, i)
            rec[15 if kind <= 5 else 16] = c
            at = readers.LAS_RGB_AT.get(kind)
            if at is not None:
                struct.pack_into("<3H", rec, at, r, 0, 1)
            body += bytes(rec)
        return bytes(head) + body

    pts = [(2 * i, -i, 1, i % 7, 200 if i == 3 else 2, i) for i in range(10)]
    files = {"a.las": las(pts), "b.las": las(pts, 1, 28), "c.las": las(pts, 7, 36, version=4), "short.las": b"LASF", "zip.las": las(pts, 0x83), "cut.las": las(pts)[:-40], "none.las": las([]), "other.las": b"x" * 300}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = readers.read_las(spark, str(tmp_path)).collect()
    by = {n: sorted((r for r in rows if r["path"].endswith("/" + n) and not r["error"]), key=lambda r: r["index"]) for n in files}
    assert [(r["x"], r["y"], r["z"]) for r in by["a.las"]] == [(x * 0.5 + 10, y * 0.5 + 20, z * 0.5 + 30) for x, y, z, *_ in pts]
    assert [r["cls"] for r in by["a.las"]][3] == 200 & 31 and [r["r"] for r in by["a.las"]] == list(range(10))
    assert by["b.las"][0]["r"] is None and by["b.las"][5]["intensity"] == 5
    assert [r["cls"] for r in by["c.las"]][3] == 200 and len(by["c.las"]) == 10 and len(by["cut.las"]) == 8
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows if r["error"]}
    assert errors.keys() == {"short.las", "zip.las", "none.las", "other.las"} and errors["zip.las"] == "compressed points"
    key = lambda r: tuple(str(v) for v in (r["path"].rsplit("/", 1)[1], *r[1:]))
    for step in (1 << 20, 70):
        ranges = las_ranges.read_las_ranges(spark, str(tmp_path), step)
        assert sorted(map(key, ranges.collect())) == sorted(map(key, rows))
    assert ranges.rdd.getNumPartitions() > 15  # two points of a file in each
    summary = {r["path"].rsplit("/", 1)[1]: r for r in readers.las_summary(readers.read_las(spark, str(tmp_path))).collect()}
    assert summary["a.las"]["has_rgb"] and not summary["b.las"]["has_rgb"] and summary["a.las"]["classes"] == {2: 9, 8: 1}


def timed_run(spark, tmp_path, build, schema, steps):
    """Run ``build`` over a stream of files that grows by step; the rows that each step adds to the output."""
    out, seen = [], set()
    session = live.stream_session(spark)
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = session.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
        build(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        now = {tuple(str(v) for v in r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        out.append(now - seen)
        seen = now
    return out


def test_idle_masks_are_freed(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "session_id long, layer string, seq long, ts timestamp, cells array<int>"
    steps = [[(1, "a", 1, at(0), [1, 1]), (1, "a", 2, at(1), [0, 1]), (2, "a", 1, at(1), [1])],
             [(1, "a", 3, at(2), [0, 0]), (2, "a", 2, at(3), [0, 1, 1])],  # goes on; another size restarts
             [(2, "a", 3, at(100), [0, 0, 0])],  # the watermark passes session 1
             [(1, "a", 4, at(101), [0, 1])]]
    out = timed_run(spark, tmp_path, lambda s: live.ema_masks_stream(s, 10_000), schema, steps)
    assert {(r[0], r[2], r[3]) for r in out[1]} == {("1", "3", str([0.55 * 0.55, 0.55])), ("2", "2", "[0.0, 1.0, 1.0]")}
    assert {(r[0], r[2], r[3]) for r in out[2]} == {("2", "3", "[0.0, 0.55, 0.55]")}
    assert {(r[0], r[2], r[3]) for r in out[3]} == {("1", "4", "[0.0, 1.0]")}


def test_layers_share_a_session_and_are_freed_alone(spark, tmp_path):
    """One call of Python for a session and not for each of its layers; an idle layer still goes by itself, a null layer is one."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "session_id long, layer string, seq long, ts timestamp, cells array<int>"
    steps = [[(1, "a", 2, at(1), [0]), (1, "a", 1, at(0), [1]), (1, "b", 1, at(1), [1]), (1, None, 1, at(1), [1])],
             [(1, "b", 2, at(9), [0]), (1, None, 2, at(100), [0]), (1, "a", 1, at(2), [1])],  # an old frame of a
             [(1, None, 3, at(101), [0])],  # the watermark has passed a and b
             [(1, "a", 3, at(102), [0]), (1, "b", 3, at(102), [0]), (1, None, 4, at(102), [0])]]
    built = []
    out = timed_run(spark, tmp_path, lambda s: built.append(live.ema_masks_stream(s, 10_000)) or built[-1], schema, steps)
    got = [{(r[1], int(r[2])): float(r[3].strip("[]")) for r in part} for part in out]
    want = [{("a", 1): 1, ("a", 2): 0.55, ("b", 1): 1, ("None", 1): 1}, {("b", 2): 0.55, ("None", 2): 0.55}, {("None", 3): 0.55**2}, {("a", 3): 0, ("b", 3): 0, ("None", 4): 0.55**3}]
    assert [{k: round(v, 9) for k, v in part.items()} for part in got] == [{k: round(v, 9) for k, v in part.items()} for part in want]
    plan = built[0]._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "layer" not in plan.split("FlatMapGroupsInPandasWithState")[1].split("\n")[0].split("]")[0]


def test_scenes_are_held_and_freed(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "session_id long, seq long, ts timestamp, mode long, scene string"
    steps = [[(1, i, at(i), 0, f"s{i}") for i in range(1, 6)], [(1, i, at(i), int(i > 6), f"s{i}") for i in range(6, 10)], [(2, 1, at(200), 0, "x")], [(1, 10, at(201), 1, "s10")]]
    out = timed_run(spark, tmp_path, lambda s: live.context_refresh_stream(s, 3, 10_000), schema, steps)
    assert [{int(r[1]): r[3] for r in part} for part in out] == [{1: "s1", 2: "s2", 3: "s2", 4: "s2", 5: "s5"}, {6: "s5", 7: "s7", 8: "s7", 9: "s9"}, {1: "x"}, {10: "s10"}]
    flat = [r for step in steps[:2] for r in step]
    rows = spark.createDataFrame(flat, schema)
    assert {r["seq"]: r["context"] for r in live.context_refresh(rows, rows, 3, "mode").collect()} == {1: "s1", 2: "s2", 3: "s2", 4: "s2", 5: "s5", 6: "s5", 7: "s7", 8: "s7", 9: "s9"}


def test_stride_sample_joins_few_strides_without_a_shuffle_by_key(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.format_string("%05d", "id").alias("o"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = readers.stride_sample(rows, ["k"], "o", F.substring("o", 1, 2), 100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["o"] for r in out.collect()) == sorted(f"{i:05d}" for k in range(2) for i in range(k, 5000, 50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(k#" not in plan.split("BroadcastHashJoin")[0]


def test_large_assets_are_digested_in_blocks(spark, tmp_path):
    (tmp_path / "a b%20.las").write_bytes(b"x" * 9_000_000)
    (tmp_path / "small.png").write_bytes(b"abc")
    out = readers.list_assets(spark, str(tmp_path), whole_bytes=1000)
    got = {r["name"]: r["sha256"] for r in out.collect()}
    assert got == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.iterdir()}


def test_las_files_grow_in_number_and_not_in_size(spark, monkeypatch):
    from defectlake.plans import s_sources
    from defectlake.sources.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    whole = sorted(map(tuple, s_sources.s3c(fx).collect()))
    monkeypatch.setattr(s_sources, "FILE_POINTS", 200, raising=False)
    seen, read = [], las_ranges.read_las_ranges
    monkeypatch.setattr(las_ranges, "read_las_ranges", lambda spark, path, size: (out := read(spark, path, size), seen.append(out.select("path").distinct().count()))[0])
    assert sorted(map(tuple, s_sources.s3c(fx).collect())) == whole and seen[0] > 25
