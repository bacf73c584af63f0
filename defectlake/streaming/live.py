"""Live detection streams: throttling, smoothing, totals and windowed counts.

Functions without state of their own take a batch or a streaming frame table alike. The exponential averages have a batch
form (parallel over chunks of a long session) and a streaming form with explicit state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import half_up
from ..operators import components as C
from ..operators.ordered import ordered_positions, running_sum, shifted
from ..operators.spatial import ordered_fold, tasks_for
from ..session import checkpoint

ALPHA, RATE_ALPHA, MASK_ON = 0.45, 0.3, 0.5
REFERENCE_SIDE = 1600

FRAME_SCHEMA = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("latency_ms", T.LongType()),
    T.StructField("label", T.StringType()), T.StructField("n", T.LongType())])


def read_frames(spark: SparkSession, path: str, delay: str = "10 minutes", schema: T.StructType = FRAME_SCHEMA) -> DataFrame:
    """File stream of analysed frames with a watermark; a frame that arrives twice is taken once."""
    frames = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return frames.dropDuplicatesWithinWatermark(["session_id", "seq", "label"])


def throttle_frames(frames: DataFrame, fps: int) -> DataFrame:
    """Newest frame of every session and 1/fps second."""
    slot = F.window("ts", f"{1_000_000 // fps} microseconds")
    keep = [c for c in frames.columns if c != "session_id"]
    return frames.groupBy("session_id", slot.alias("slot")).agg(F.max_by(F.struct(*keep), "seq").alias("f")).select("session_id", *[F.col(f"f.{c}").alias(c) for c in keep])


def session_totals(frames: DataFrame) -> DataFrame:
    """Per recording and label: the largest simultaneous count."""
    return frames.groupBy("session_id", "label").agg(F.max("n").alias("max_n"), F.count(F.lit(1)).alias("frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def recording_summary(totals: DataFrame) -> DataFrame:
    """One row per recording from its label totals."""
    duration = (F.unix_micros(F.max("last_ts").cast("timestamp")) - F.unix_micros(F.min("first_ts").cast("timestamp"))) / 1000
    return totals.groupBy("session_id").agg(F.sum("frames").alias("frames"), duration.cast("long").alias("duration_ms"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "max_n")))).alias("totals"))


def windowed_counts(frames: DataFrame, length: str) -> DataFrame:
    """Detections per label and tumbling window; on a stream, rows later than the watermark are dropped."""
    out = frames.groupBy(F.window("ts", length).alias("w"), "label").agg(F.sum("n").alias("detections"), F.count(F.lit(1)).alias("frames"), F.max("n").alias("max_n"))
    return out.select(F.col("w.start").alias("window_start"), "label", "detections", "frames", "max_n")


SEQ_CHUNK = 10_000


def context_refresh(frames: DataFrame, scenes: DataFrame, every: int, mode: str | None = None) -> DataFrame:
    """Attach the scene computed at the last refresh among the frames that arrived; no state is needed.

    The first frame and every change of ``mode`` compute a scene and are not counted; of the other frames the first and then
    each ``every``-th do. Frames that throttling dropped count for nothing.
    """
    chunk = F.floor(F.col("seq") / SEQ_CHUNK)
    placed = checkpoint(ordered_positions(frames, ["session_id"], ["seq"], chunk))
    value = F.lit(0) if mode is None else F.col(mode)
    marked = shifted(placed.withColumn("_mode", value), placed.withColumn("_mode", value), ["session_id"], -1, {"_mode": "_before"})
    changed = (F.col("pos") == 1) | ~F.col("_mode").eqNullSafe(F.col("_before"))
    counted = running_sum(marked.withColumn("_changed", changed), ["session_id"], ["seq"], chunk, {"_count": F.when(changed, 0).otherwise(1)})
    refresh = F.col("_changed") | ((F.col("_count") - 1) % every == 0)
    held = checkpoint(running_sum(counted.withColumn("_refresh", refresh), ["session_id"], ["seq"], chunk, {"_held": F.when(refresh, 1).otherwise(0)}))
    at = held.where("_refresh").select("session_id", "_held", F.col("seq").alias("context_seq"))
    rows = held.select(*frames.columns, "_held").join(at, ["session_id", "_held"]).drop("_held")
    return rows.join(scenes.select("session_id", F.col("seq").alias("context_seq"), F.col("scene").alias("context")), ["session_id", "context_seq"], "left")


def scale_live_params(kernel: Column, min_area: Column, width: Column, height: Column, source_side: Column) -> tuple[Column, Column]:
    """Odd kernel and minimum area of the full analysis scaled to the live resolution."""
    scale = F.least(F.lit(1.0), F.greatest(width, height) / F.greatest(F.lit(1), F.least(F.lit(REFERENCE_SIDE), source_side)))
    k = F.greatest(F.lit(5), half_up(kernel * scale).cast("int").bitwiseOR(F.lit(1))).cast("long")
    return k, F.greatest(F.lit(4), half_up(min_area * scale * scale)).cast("long")


def ema(rows: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float, chunk: Column, name: str = "ema", restart: Column | None = None) -> DataFrame:
    """Exponential average in order, seeded by the first value of each key and by each value where ``restart`` holds.

    One step is ``acc → (1−α)·acc + α·v``, and the steps of a chunk compose to ``acc → a·acc + b``. ``b`` is a weighted sum
    over the chunk, so starting values follow from one row for each chunk; then chunks are folded independently, in sorted
    batches that carry the average. Neither a session nor a chunk is ever held as a list.
    """
    keys, decay = list(keys), 1.0 - alpha
    v = F.col(value).cast("double")
    inside = Window.partitionBy(*keys, "_c").orderBy(order)
    again = F.lit(False) if restart is None else F.coalesce(restart, F.lit(False))
    tasks = tasks_for(rows)  # no task sorts more rows than it should, however many there are
    seen = rows.select(*keys, order, v.alias("_v"), chunk.alias("_c"), again.alias("_again")).repartition(tasks, *keys, "_c").withColumn("_i", F.row_number().over(inside))
    sizes = seen.groupBy(*keys, "_c").agg(F.max("_i").alias("n"), F.coalesce(F.max(F.when(F.col("_again"), F.col("_i"))), F.lit(0)).alias("_r"))
    # The first value of a key counts in full, and so does the last restart of a chunk, before which nothing counts.
    first = seen.join(sizes, [*keys, "_c"]).withColumn("_w", F.when(F.col("_i") >= F.col("_r"), F.pow(F.lit(decay), F.col("n") - F.col("_i"))).otherwise(0.0))
    parts = first.groupBy(*keys, "_c").agg(F.sum(F.col("_v") * F.col("_w")).alias("s"), F.max(F.when(F.col("_i") == F.greatest("_r", F.lit(1)), F.col("_v") * F.col("_w"))).alias("f"), F.max("n").alias("n"), F.max("_r").alias("r"))

    def chain(state: list, arrays: list) -> list:
        out = []
        for s, f, n, r in zip(*arrays):
            out.append(state[0])
            state[0] = alpha * s + (1 - alpha) * f if state[0] is None or r else state[0] * decay ** int(n) + alpha * s
        return out

    starts = ordered_fold(parts.withColumn("_o", F.col("_c")), keys, [F.col("_o")], lambda: [None], chain, ["s", "f", "n", "r"], "_start", T.DoubleType(), tasks).select(*keys, "_c", "_start")

    def run(state: list, arrays: list) -> list:
        out = []
        for x, start, anew in zip(*arrays):
            acc = state[0] if state[0] is not None else (None if start is None or np.isnan(start) else float(start))
            state[0] = float(x) if acc is None or anew else acc * decay + x * alpha
            out.append(state[0])
        return out

    folded = ordered_fold(seen.drop("_i").join(starts, [*keys, "_c"]), [*keys, "_c"], [F.col(order)], lambda: [None], run, ["_v", "_start", "_again"], name, T.DoubleType(), tasks)
    return folded.select(*keys, order, name)


def ema_masks(cells: DataFrame, chunk: Column, keys: Sequence[str] = ("session_id", "layer", "cell")) -> DataFrame:
    """Smoothed on/off state of every mask cell (``seq``, ``on`` as 0/1).

    Where cells carry the ``size`` of their mask, a frame whose mask has another size than the frame before restarts the average.
    """
    restart = None
    if "size" in cells.columns:
        layer = [k for k in keys if k != "cell"]
        sizes = checkpoint(ordered_positions(cells.groupBy(*layer, "seq").agg(F.max("size").alias("size")), layer, ["seq"], F.floor(F.col("seq") / SEQ_CHUNK)))
        changed = shifted(sizes, sizes, layer, -1, {"size": "_before"}).select(*layer, "seq", (F.col("size") != F.col("_before")).alias("_restart"))
        cells, restart = cells.join(changed, [*layer, "seq"]), F.col("_restart")
    out = ema(cells, keys, "seq", "on", ALPHA, chunk, restart=restart)
    return out.withColumn("show", F.col("ema") >= MASK_ON)


def ema_rate(frames: DataFrame, chunk: Column) -> DataFrame:
    """Smoothed analysis rate per session from the time between consecutive frames (position ``seq``)."""
    rows = shifted(frames.select("session_id", "seq", "ts"), frames.select("session_id", "seq", "ts"), ["session_id"], -1, {"ts": "_prev"}, position="seq").where(F.col("_prev").isNotNull())
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))) / 1000
    return ema(rows.withColumn("_rate", 1000 / F.greatest(F.lit(1.0), gap)), ["session_id"], "seq", "_rate", RATE_ALPHA, chunk, "rate")


def _stateful(rows: DataFrame, key: str, part: str | None, columns: Sequence[str], step: Callable, kept: str, result: str, idle_ms: int | None) -> DataFrame:
    """Stream of ``step`` over the newer rows, by number, of every ``part`` of a ``key``, which keeps its values ``kept`` between micro-batches.

    ``step(values, seq, *columns)`` gets None or the kept values, and arrays; it gives new values and the ``result`` columns.
    A call of Python and its way to the state cost milliseconds, so the few parts of a key share both, and states travel with the
    rows of many keys. With ``idle_ms`` a part is forgotten once the watermark is that far past its newest row (``ts``).
    """
    timed = idle_ms is not None
    named = rows.schema[part].dataType.simpleString() if part else "string"
    rows = rows.select(key, F.col(part).alias("part__") if part else F.lit("").alias("part__"), F.col("seq").cast("long").alias("seq"), *columns,
                       *([F.unix_millis(F.col("ts").cast("timestamp")).alias("ms__"), "ts"] if timed else []))  # Spark looks for the watermark of ``ts``
    inputs = ["part__", "seq", *columns, *["ms__"] * timed]
    schema = T.StructType([*rows.select(key, "part__", "seq").schema.fields, *T.StructType.fromDDL(result).fields])

    def run(names: tuple, found: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = {p: tuple(v) for p, *v in state.get[0]} if state.exists else {}, []
        if not state.hasTimedOut:
            parts, seq, *arrays = [np.concatenate(c) for c in zip(*[[rows[c].to_numpy() for c in inputs] for rows in found])]
            code, parts = pd.factorize(parts, use_na_sentinel=False)
            order = np.lexsort((seq, code))
            ends = np.searchsorted(code[order], np.arange(len(parts) + 1))
            for name, begin, end in zip(parts, ends, ends[1:]):
                name = None if pd.isna(name) else name
                last, until, *values = held.get(name, (-1, 0))
                at = order[begin:end]
                at = at[seq[at] > last]
                if len(at):
                    values, made = step(values or None, seq[at], *[a[at] for a in arrays[: len(columns)]])
                    until = max(until, int(arrays[-1][at].max()) + idle_ms) if timed else 0
                    held[name] = (int(seq[at[-1]]), until, *values)
                    out.append(([name] * len(at), seq[at], *made))
        if timed:
            now = state.getCurrentWatermarkMs()
            held = {p: v for p, v in held.items() if v[1] >= now}
        if held:
            state.update(([(p, *v) for p, v in held.items()],))
            if timed:
                state.setTimeoutTimestamp(max(min(v[1] for v in held.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            parts, seq, *made = [[v for c in column for v in c] for column in zip(*out)]
            yield pd.DataFrame(dict(zip(schema.names, [[names[0]] * len(seq), parts, seq, *made])))

    states = f"parts array<struct<part: {named}, last: bigint, until: bigint, {kept}>>"
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    out = rows.groupBy(key).applyInPandasWithState(run, schema, states, "append", timeout)
    return out.withColumnRenamed("part__", part) if part else out.drop("part__")


def _mask_averages(values: list | None, seq: np.ndarray, cells: np.ndarray) -> tuple[list, list]:
    """Averages of all cells of a (session, layer); another mask size starts them anew."""
    acc, out = None if values is None else np.asarray(values[0], dtype=float), []
    for mask in cells:
        mask = np.asarray(mask, dtype=float)
        acc = mask if acc is None or len(acc) != len(mask) else acc * (1 - ALPHA) + mask * ALPHA
        out.append(acc)
    return [acc.tolist()], [out, [a >= MASK_ON for a in out]]


def _scenes(every: int) -> Callable:
    """The scene in use of a session: number of its frame, mode, and how many frames were counted since the start."""
    def step(values: list | None, seq: np.ndarray, modes: np.ndarray, scenes: np.ndarray) -> tuple[list, list]:
        at, scene, mode, counted = values or (None, None, None, 0)
        out = []
        for number, now, seen in zip(seq.tolist(), modes.tolist(), scenes):
            if at is None or mode != now:
                at, scene, mode = int(number), seen, int(now)
            else:
                if counted % every == 0:
                    at, scene = int(number), seen
                counted += 1
            out.append((at, scene))
        return [at, scene, mode, counted], list(zip(*out))

    return step


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep state in the store that holds more than an executor's memory."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def ema_masks_stream(cells: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streaming form of ``ema_masks``: one packed state per session holding all cells of its layers.

    Input rows carry ``session_id, layer, seq, cells`` (cells as an array of 0/1 for one frame). Rows of a key are ordered
    within a micro-batch; frames older than the last applied one are ignored, and another mask size restarts the average.
    With ``idle_ms`` rows also carry ``ts`` with a watermark; a key is freed once the watermark is that far past its newest
    frame, and starts anew if it comes back.
    """
    return _stateful(cells, "session_id", "layer", ["cells"], _mask_averages, "acc: array<double>", "ema array<double>, show array<boolean>", idle_ms)


def context_refresh_stream(frames: DataFrame, every: int, idle_ms: int | None = None) -> DataFrame:
    """Streaming form of ``context_refresh`` over frames ``session_id, seq, mode, scene`` (``ts`` and ``idle_ms`` as in ``ema_masks_stream``)."""
    return _stateful(frames, "session_id", None, ["mode", "scene"], _scenes(every), "context_seq: bigint, context: string, mode: bigint, counted: bigint", "context_seq long, context string", idle_ms)


def frame_components(mask: DataFrame, height: int, width: int, min_area: int = 1, min_aspect: float = 0.0, cap: int = 400) -> DataFrame:
    """Component boxes of every frame mask (``frame_id, y, x``) in relative coordinates, first ``cap`` in scan order."""
    boxes = C.component_boxes(C.label_components(mask, ["frame_id"]), ["frame_id"])
    aspect = F.greatest("bw", "bh") / F.greatest(F.lit(1), F.least("bw", "bh"))
    rows = boxes.where((F.col("area") >= min_area) & (aspect >= min_aspect))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy("label"))).where(F.col("rank") <= cap)
    return rows.select("frame_id", "label", "area", (F.col("x0") / F.lit(float(width))).alias("x1"), (F.col("y0") / F.lit(float(height))).alias("y1"),
                       ((F.col("x1") + 1) / F.lit(float(width))).alias("x2"), ((F.col("y1") + 1) / F.lit(float(height))).alias("y2"))


def write_frame_components(masks: DataFrame, path: str, height: int, width: int, checkpoint: str, trigger: dict | None = None, **limits):
    """Run ``frame_components`` on each micro-batch of a mask stream and write the boxes under its number.

    A micro-batch that is replayed replaces its own rows. ``trigger`` holds the options of the stream's trigger.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        frame_components(df, height, width, **limits).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").partitionBy("epoch").option("partitionOverwriteMode", "dynamic").parquet(path)

    return masks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
