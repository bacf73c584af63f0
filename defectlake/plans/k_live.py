"""Registered queries: live streams, as batch twins of the streaming functions (K)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.geometry import round_scaled
from ..session import ensure_checkpoint_dir
from ..streaming import live as ops
from .base import query
from .e_raster import labels_cte

def day():
    return F.col("ts").cast("date")


@query("k1_read_frames", "SELECT session_id, seq, ts, label, n, latency_ms FROM fx_frames", "fx_frames")
def k1(fx):
    """All frames through a file stream into a table; a second copy of every file's rows is dropped on the way."""
    root = f"{ensure_checkpoint_dir(fx.spark)}/frames-{uuid4().hex}"
    frames = fx.frames.select(*ops.FRAME_SCHEMA.names)
    frames.union(frames).write.parquet(f"{root}/in")
    stream = ops.read_frames(fx.spark, f"{root}/in", delay="60 days")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.parquet(f"{root}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("k2_throttle_frames", "SELECT session_id, seq, ts, label, n, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id, epoch_us(ts)//3600000000 ORDER BY seq DESC) rn FROM fx_frames) q WHERE rn=1", "fx_frames")
def k2(fx):
    return throttled(fx)


def throttled(fx):
    # The test frames are spread over a month: an hour stands for a second.
    hours = fx.frames.withColumn("real_ts", F.col("ts")).withColumn("ts", F.expr("timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) DIV 3600)"))
    return ops.throttle_frames(hours, 1).select("session_id", "seq", F.col("real_ts").alias("ts"), "label", "n", "latency_ms")


def through_stream(fx, rows, build):
    """Rows of a batch table that pass through a file stream and end in a table of files."""
    root = f"{ensure_checkpoint_dir(fx.spark)}/stream-{uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    stream = build(ops.stream_session(fx.spark), f"{root}/in")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.parquet(f"{root}/out")


@query("k2_throttle_stream", "SELECT session_id, seq, label, n, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id, epoch_us(ts)//3600000000 ORDER BY seq DESC) rn FROM fx_frames) q WHERE rn=1", "fx_frames")
def k2b(fx):
    """The same through a stream: a last row far ahead lets the watermark pass all slots."""
    hours = fx.frames.withColumn("ts", F.expr("timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) DIV 3600)")).select(*ops.FRAME_SCHEMA.names)
    end = hours.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(*[F.col(f.name) if f.name == "ts" else F.lit(-1 if f.name == "session_id" else None).cast(f.dataType).alias(f.name) for f in ops.FRAME_SCHEMA])
    out = through_stream(fx, hours.union(end), lambda spark, path: ops.throttle_frames(ops.read_frames(spark, path, "1 minute"), 1))
    return out.select("session_id", "seq", "label", "n", "latency_ms")


CELLS = "SELECT session_id, label layer, CAST(cell AS BIGINT) cell, seq, ts, CASE WHEN (n + cell + CAST(floor(latency_ms/100) AS BIGINT)) % 3 <> 0 THEN 1 ELSE 0 END m FROM {f} f [[cell 0 3]]"
CELL_CTE = "ce AS (" + CELLS.format(f="fx_frames").replace("[[cell 0 3]]", "CROSS JOIN (SELECT unnest(range(0,4)) cell) c") + """),
cn AS (SELECT *, row_number() OVER (PARTITION BY session_id, layer, cell ORDER BY seq) k FROM ce),
em AS /* RECURSIVE */ (SELECT session_id, layer, cell, seq, k, m::DOUBLE acc FROM cn WHERE k=1 UNION ALL SELECT c.session_id, c.layer, c.cell, c.seq, c.k, e.acc*0.55::DOUBLE+c.m*0.45::DOUBLE FROM em e JOIN cn c ON c.session_id=e.session_id AND c.layer=e.layer AND c.cell=e.cell AND c.k=e.k+1)"""


@query("k3_ema_masks", "SELECT session_id, layer, cell, seq, round(acc, 9) ema, acc>=0.5 AS \"show\" FROM em", "fx_frames", CELL_CTE)
def k3(fx):
    from ..sources.fixtures import _spark_text
    cells = fx.spark.sql(_spark_text(CELLS), f=fx.frames).withColumnRenamed("m", "on")
    return ops.ema_masks(cells, day()).withColumn("ema", F.round("ema", 9))


SIZED = "SELECT session_id, label layer, seq, ts, n, latency_ms, CAST(CASE WHEN CAST(floor(seq/40) AS BIGINT) % 2 = 0 THEN 4 ELSE 3 END AS BIGINT) size FROM {f}"
RESTARTS = "fs AS (" + SIZED.format(f="fx_frames") + """),
fa AS (SELECT *, coalesce(lag(size) OVER (PARTITION BY session_id, layer ORDER BY seq) <> size, false) again FROM fs),
fg AS (SELECT *, sum(again::INT) OVER (PARTITION BY session_id, layer ORDER BY seq) g FROM fa),
fk AS (SELECT *, row_number() OVER (PARTITION BY session_id, layer, g ORDER BY seq) k FROM fg),
fc AS (SELECT f.*, cell, CASE WHEN (n + cell + CAST(floor(latency_ms/100) AS BIGINT)) % 3 <> 0 THEN 1 ELSE 0 END m FROM fk f JOIN (SELECT unnest(range(0,4)) cell) c ON cell < size),
fe AS /* RECURSIVE */ (SELECT session_id, layer, g, cell, seq, k, m::DOUBLE acc FROM fc WHERE k=1 UNION ALL SELECT c.session_id, c.layer, c.g, c.cell, c.seq, c.k, e.acc*0.55::DOUBLE+c.m*0.45::DOUBLE FROM fe e JOIN fc c ON c.session_id=e.session_id AND c.layer=e.layer AND c.g=e.g AND c.cell=e.cell AND c.k=e.k+1)"""
RESTARTED = "SELECT session_id, layer, cell::BIGINT cell, seq, round(acc, 9) ema, acc>=0.5 AS \"show\" FROM fe"


def sized_masks(fx):
    """Masks of three or four cells, by turns of 40 frames."""
    on = F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda i: F.when((F.col("n") + i + F.floor(F.col("latency_ms") / 100)) % 3 != 0, 1).otherwise(0))
    return fx.spark.sql(SIZED, f=fx.frames).select("session_id", "layer", "seq", "ts", "size", on.alias("cells"))


@query("k3_mask_restarts", RESTARTED, "fx_frames", RESTARTS)
def k3b(fx):
    cells = sized_masks(fx).select("session_id", "layer", "seq", "ts", "size", F.posexplode("cells").alias("cell", "on")).withColumn("cell", F.col("cell").cast("long"))
    return ops.ema_masks(cells, day()).withColumn("ema", F.round("ema", 9))


@query("k3_mask_stream", RESTARTED, "fx_frames", RESTARTS)
def k3c(fx):
    rows = sized_masks(fx).drop("size", "ts")
    out = through_stream(fx, rows, lambda spark, path: ops.ema_masks_stream(spark.readStream.schema(rows.schema).parquet(path)))
    out = out.select("session_id", "layer", "seq", F.posexplode(F.arrays_zip("ema", "show")).alias("cell", "c"))
    return out.select("session_id", "layer", F.col("cell").cast("long").alias("cell"), "seq", F.round("c.ema", 9).alias("ema"), "c.show")


@query("k4_ema_rate", "SELECT session_id, seq, round(acc, 12) rate FROM er", "fx_frames", """
ir AS (SELECT session_id, seq, 1000/greatest(1, (epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY seq))/1000) r FROM fx_frames),
er AS /* RECURSIVE */ (SELECT session_id, seq, r acc FROM ir WHERE seq=2 UNION ALL SELECT i.session_id, i.seq, e.acc*0.7::DOUBLE+i.r*0.3::DOUBLE FROM er e JOIN ir i ON i.session_id=e.session_id AND i.seq=e.seq+1)""")
def k4(fx):
    return ops.ema_rate(fx.frames, F.floor(F.col("seq") / 1000)).withColumn("rate", round_scaled(F.col("rate"), 12))


@query("k5_session_totals", "SELECT session_id, label, max(n) max_n, count(*) frames, min(ts) first_ts, max(ts) last_ts FROM fx_frames GROUP BY 1,2", "fx_frames")
def k5(fx):
    return ops.session_totals(fx.frames)


@query("k5_recording_summary", "SELECT session_id, count(*) frames, (epoch_us(max(ts))-epoch_us(min(ts)))//1000 duration_ms, count(DISTINCT label) labels FROM fx_frames GROUP BY 1", "fx_frames")
def k5b(fx):
    return ops.recording_summary(ops.session_totals(fx.frames)).select("session_id", "frames", "duration_ms", F.size("totals").cast("long").alias("labels"))


@query("k6_windowed_counts", "SELECT time_bucket(INTERVAL 6 HOURS, ts) window_start, label, sum(n)::BIGINT detections, count(*) frames, max(n) max_n FROM fx_frames GROUP BY 1,2", "fx_frames")
def k6(fx):
    return ops.windowed_counts(fx.frames, "6 hours")


@query("k7_context_refresh", """
SELECT f.session_id, f.seq, f.label, r.seq context_seq, r.label context FROM kept f JOIN kept r ON r.session_id=f.session_id AND r.pos=CASE WHEN f.pos=1 THEN 1 ELSE f.pos-(f.pos-2)%6 END""", "fx_frames",
       "kept AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id, epoch_us(ts)//3600000000 ORDER BY seq DESC) rn FROM fx_frames) q WHERE rn=1)")
def k7(fx):
    """Scenes of the frames that throttling keeps."""
    kept = throttled(fx)
    out = ops.context_refresh(kept, kept.withColumn("scene", F.col("label")), 6)
    return out.select("session_id", "seq", "label", "context_seq", "context")


MODES = """kept AS (SELECT *, CAST(floor(seq/37) AS BIGINT) % 3 mode FROM (SELECT *, row_number() OVER (PARTITION BY session_id, epoch_us(ts)//3600000000 ORDER BY seq DESC) rn FROM fx_frames) q WHERE rn=1),
kc AS (SELECT *, coalesce(lag(mode) OVER (PARTITION BY session_id ORDER BY seq) <> mode, true) ch FROM kept),
kn AS (SELECT *, sum((NOT ch)::INT) OVER (PARTITION BY session_id ORDER BY seq) c FROM kc),
kr AS (SELECT *, ch OR (c-1) % 6 = 0 rf FROM kn),
kg AS (SELECT *, sum(rf::INT) OVER (PARTITION BY session_id ORDER BY seq) g FROM kr)"""
MODED = "SELECT f.session_id, f.seq, r.seq context_seq, r.label context FROM kg f JOIN kg r ON r.session_id=f.session_id AND r.g=f.g AND r.rf"


def moded(fx):
    return throttled(fx).withColumn("mode", F.floor(F.col("seq") / 37) % 3).withColumn("scene", F.col("label"))


@query("k7_context_modes", MODED, "fx_frames", MODES)
def k7b(fx):
    rows = moded(fx)
    return ops.context_refresh(rows, rows, 6, "mode").select("session_id", "seq", "context_seq", "context")


@query("k7_context_stream", MODED, "fx_frames", MODES)
def k7c(fx):
    rows = moded(fx).select("session_id", "seq", "mode", "scene")
    return through_stream(fx, rows, lambda spark, path: ops.context_refresh_stream(spark.readStream.schema(rows.schema).parquet(path), 6))


@query("k8_scale_live_params", """
SELECT session_id, seq, greatest(5, CAST(floor(15*s+0.5) AS BIGINT) | 1) kernel, greatest(4, CAST(floor(30*s*s+0.5) AS BIGINT)) min_area FROM (SELECT session_id, seq, least(1.0::DOUBLE, (256+n*128)/greatest(1, least(1600, latency_ms*3))) s FROM fx_frames) q""", "fx_frames")
def k8(fx):
    kernel, area = ops.scale_live_params(F.lit(15), F.lit(30), 256 + F.col("n") * 128, F.lit(256), F.col("latency_ms") * 3)
    return fx.frames.select("session_id", "seq", kernel.alias("kernel"), area.alias("min_area"))


@query("k9_frame_components", """
SELECT frame_id, label, area, x0/32.0::DOUBLE x1, y0/32.0::DOUBLE y1, (x1+1)/32.0::DOUBLE x2, (y1+1)/32.0::DOUBLE y2 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY label) rn FROM (
 SELECT frame_id, label, count(*) area, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM lab GROUP BY 1,2) a WHERE area>=3) b WHERE rn<=25""", "fx_pixels", "fm AS (SELECT image_id frame_id, y, x FROM fx_pixels WHERE g>=165),\n" + labels_cte("fm", "frame_id"))
def k9(fx):
    return ops.frame_components(fx.pixels.where("g >= 165").select(F.col("image_id").alias("frame_id"), "y", "x"), 32, 32, 3, 0.0, 25)
