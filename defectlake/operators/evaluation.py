"""Model outputs, segmentation metrics, gates and parity reports."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import clamp
from ..functions.taxonomy import literal_map
from .selection import TILE, select_boxes
from .spatial import BOX

IGNORE_INDEX = 255
# Threshold grid of the sweep, gates, tolerances and label vocabularies.
SWEEP = [float(t) for t in np.unique(np.concatenate([np.linspace(.01, .25, 25), np.linspace(.26, .90, 33), np.linspace(.91, .999, 46)])).astype(np.float32)]
VALIDATION_GRID = [float(t) for t in np.linspace(.10, .90, 33)]
GATES = {"supervised": {"iou": (">=", .50), "dice": (">=", .65), "area_delta": ("<=", .10)},
         "external": {"iou": (">=", .35), "dice": (">=", .50), "area_delta": ("<=", .15)},
         "candidate": {"iou": (">=", .35), "dice": (">=", .50), "area_delta": ("<=", .20)},
         "consistency": {"mean_abs_error": ("<=", .02), "iou": (">=", .95), "area_delta": ("<=", .03)}}
TOLERANCES = {"gray_linf": ("<=", 1.0), "response_linf": ("<=", 1.0), "raw_pmr": ("<=", 1e-4), "open_pmr": ("<=", 0.0), "clean_iou": (">=", .9999), "dcc": ("<=", 0.0),
              "skeleton_nodes": ("<=", 0.0), "measure_rel": ("<=", .01)}
WARN_IOU, WARN_REL = .995, .05
EXTERNAL_CLASSES = {0: "cracks", 1: "cracks", 3: "efflorescence_white", 4: "corrosion_rust", 8: "spalling_dark", 12: "exposed_rebar"}
VOCABULARY = {"background": 0, "cracks": 1, "spalling_dark": 2, "exposed_rebar": 3, "corrosion_rust": 4, "efflorescence_white": 5}


def softmax_argmax(logits: DataFrame, target: int) -> DataFrame:
    """Best class (lowest index on ties) and softmax probability of ``target`` per pixel; a pixel's classes are one small array."""
    packed = logits.groupBy("image_id", "y", "x").agg(F.collect_list(F.struct(F.col("logit").alias("l"), (-F.col("class_id")).alias("c"))).alias("v"))
    top = F.array_max("v")
    rows = packed.select("image_id", "y", "x", "v", top["l"].alias("top"), (-top["c"]).cast("long").alias("class_id"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, s: acc + F.exp(s["l"] - F.col("top")))
    goal = F.aggregate("v", F.lit(0.0), lambda acc, s: acc + F.when(s["c"] == -target, F.exp(s["l"] - F.col("top"))).otherwise(0.0))
    return rows.select("image_id", "y", "x", "class_id", (goal / F.greatest(total, F.lit(1e-12))).alias("prob"))


def threshold_mask(probs: DataFrame, threshold: float) -> DataFrame:
    """Mask area and scores per image; without any mask pixel the score is the maximum probability."""
    on = F.col("prob") >= threshold
    out = probs.groupBy("image_id").agg(F.count_if(on).alias("area"), F.avg(F.when(on, F.col("prob"))).alias("_in"), F.avg("prob").alias("mean_probability"),
                                        F.max("prob").alias("max_probability"), F.count(F.lit(1)).alias("_n"))
    return out.select("image_id", "area", (F.col("area") / F.col("_n")).alias("area_ratio"), "mean_probability", "max_probability", F.coalesce("_in", "max_probability").alias("score"))


def _axis_weights(spark: SparkSession, n: int, m: int, name: str) -> DataFrame:
    """Half-pixel bilinear weights of one axis: which source index contributes how much to which target index."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col("id") + 0.5) * n / F.lit(float(m)) - 0.5))
    rows = spark.range(m).select(F.col("id").alias(f"t{name}"), at.alias("a"))
    low = F.floor("a").cast("long")
    part = F.col("a") - low
    return rows.select(f"t{name}", F.inline(F.array(F.struct(low.alias(name), (1 - part).alias(f"w{name}")), F.struct(F.least(F.lit(n - 1).cast("long"), low + 1).alias(name), part.alias(f"w{name}"))))).where(F.col(f"w{name}") > 0)


def bilinear_resample(probs: DataFrame, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Half-pixel bilinear resample (height, width); the weight tables have at most two rows per target line, so they are broadcast."""
    spark = probs.sparkSession
    rows = probs.join(F.broadcast(_axis_weights(spark, src[0], dst[0], "y")), "y").join(F.broadcast(_axis_weights(spark, src[1], dst[1], "x")), "x")
    return rows.groupBy("image_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("prob") * F.col("wy") * F.col("wx")).alias("prob"))


def decode_boxes(candidates: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Best class of each candidate (``cx, cy, w, h, scores``), confidence filter and corner boxes."""
    best = F.array_max("scores")
    rows = candidates.withColumn("score", best).where(F.col("score") >= threshold)
    return rows.select("image_id", "cand_id", (F.array_position("scores", F.col("score")) - 1).cast("long").alias("class_id"), "score",
                       (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))


def nms(boxes: DataFrame, iou: float = 0.45, cap: int | None = 30, tile: float = TILE) -> DataFrame:
    """Class-agnostic greedy suppression per image, best score first, up to ``cap`` kept boxes (the operator's limit).

    Equal boxes are reduced to their best score first: a copy is suppressed by whatever decides the original. Tiles of an
    image are settled side by side, see :mod:`.selection`.
    """
    rows = boxes.groupBy("image_id", *BOX).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("cand_id").alias("cand_id"))).alias("b"))
    rows = rows.select("image_id", *BOX, (-F.col("b.s")).alias("score"), F.col("b.cand_id").alias("cand_id"))
    kept = select_boxes(rows, ["image_id"], [-F.col("score"), F.col("cand_id")], iou, tile).select("image_id", "cand_id", "score", *BOX)
    if cap is None:
        return kept
    # The first kept boxes are those that a run which stops at the cap would keep.
    place = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "cand_id")
    return kept.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= cap).drop("_place")


def unletterbox(boxes: DataFrame, ratio: Column, pad_x: Column, pad_y: Column, width: Column, height: Column) -> DataFrame:
    """Boxes in original image coordinates, clipped; empty ones are dropped."""
    out = boxes
    for c, pad, size in (("x1", pad_x, width), ("y1", pad_y, height), ("x2", pad_x, width), ("y2", pad_y, height)):
        out = out.withColumn(c, clamp((F.col(c) - pad) / ratio, 0, size))
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def sigmoid(v: Column) -> Column:
    return F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v)))


def proto_masks(coefficients: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Mask probability of every detection pixel: sigmoid of the channel-wise product sum."""
    rows = coefficients.join(prototypes, ["image_id", "channel"])
    out = rows.groupBy("image_id", "det_id", "y", "x").agg(F.sum(F.col("coefficient") * F.col("value")).alias("_s"))
    return out.select("image_id", "det_id", "y", "x", sigmoid(F.col("_s")).alias("prob"))


def class_area_ratios(classes: DataFrame) -> DataFrame:
    per = classes.groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("area"))
    total = per.groupBy("image_id").agg(F.sum("area").alias("_n"))
    return per.join(total, "image_id").select("image_id", "class_id", "area", (F.col("area") / F.col("_n")).alias("ratio"))


def zero_shot_argmax(prompts: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Best prompt per pixel above the threshold (first prompt on ties); area, share and mean score per prompt."""
    best = prompts.groupBy("image_id", "y", "x").agg(F.max(F.struct("prob", (-F.col("prompt_id")).alias("p"))).alias("b"))
    rows = best.select("image_id", (-F.col("b.p")).cast("long").alias("prompt_id"), F.col("b.prob").alias("prob"), (F.col("b.prob") >= threshold).alias("on"))
    total = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    out = rows.where("on").groupBy("image_id", "prompt_id").agg(F.count(F.lit(1)).alias("area"), F.avg("prob").alias("score"))
    return out.join(total, "image_id").select("image_id", "prompt_id", "area", "score", (F.col("area") / F.col("_n")).alias("ratio"))


def metric_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = F.lit(0)
    return {"iou": tp / F.nullif(tp + fp + fn, zero), "dice": 2 * tp / F.nullif(2 * tp + fp + fn, zero),
            "precision": tp / F.nullif(tp + fp, zero), "recall": tp / F.nullif(tp + fn, zero)}


def mask_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of pixels in both, only a, only b per key: one shuffle by pixel over the union of both masks."""
    pixel = [*keys, "y", "x"]
    both = a.select(*pixel, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*pixel, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    flags = both.groupBy(*pixel).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return flags.groupBy(*keys).agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("both"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("only_a"),
                                    F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("only_b"))


def seg_metrics(gt: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confusion counts, IoU, Dice, precision and recall of sparse masks; undefined values are null."""
    n = mask_overlap(gt, pred, keys)
    out = n.select(*keys, F.col("both").alias("tp"), F.col("only_b").alias("fp"), F.col("only_a").alias("fn"))
    return out.select("*", *[c.alias(k) for k, c in metric_columns(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def cldice(gt: DataFrame, pred: DataFrame, skel_gt: DataFrame, skel_pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centre-line Dice from given skeletons."""
    def share(skeleton: DataFrame, mask: DataFrame, name: str) -> DataFrame:
        pixel = [*keys, "y", "x"]
        hit = skeleton.select(*pixel).distinct().join(mask.select(*pixel).distinct().withColumn("_m", F.lit(1)), pixel, "left")
        return hit.groupBy(*keys).agg((F.count("_m") / F.count(F.lit(1))).alias(name))

    out = share(skel_pred, gt, "topology_precision").join(share(skel_gt, pred, "topology_sensitivity"), list(keys), "full")
    out = out.na.fill(0.0, ["topology_precision", "topology_sensitivity"])
    p, s = F.col("topology_precision"), F.col("topology_sensitivity")
    return out.withColumn("cldice", F.when(p + s > 0, 2 * p * s / F.nullif(p + s, F.lit(0.0))).otherwise(0.0))


def _rank(value: Column, thresholds: Sequence[float]) -> Column:
    """How many thresholds a probability reaches."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= value))


def sweep_counts(probs: DataFrame, thresholds: Sequence[float], keys: Sequence[str], modes: Sequence[str] = ("direct", "inverted")) -> DataFrame:
    """Confusion counts for every key, mode and threshold from one pass over the pixels.

    Pixels are first counted per distinct probability, then by the number of thresholds they reach; counts per threshold
    are running sums over at most len(thresholds) + 1 rows per key.
    """
    keys = list(keys)
    values = probs.groupBy(*keys, "prob", "gt").agg(F.count(F.lit(1)).alias("_n"))
    modes_array = F.array(*[F.struct(F.lit(m).alias("mode"), (F.col("prob") if m == "direct" else 1.0 - F.col("prob")).alias("p")) for m in modes])
    ranked = values.select(*keys, "gt", "_n", F.inline(modes_array)).groupBy(*keys, "mode", _rank(F.col("p"), thresholds).alias("k")).agg(
        F.sum(F.when(F.col("gt"), F.col("_n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("gt"), 0).otherwise(F.col("_n"))).alias("neg"))
    packed = ranked.groupBy(*keys, "mode").agg(F.collect_list(F.struct("k", "pos", "neg")).alias("h"), F.sum("pos").alias("gt_px"), F.sum(F.col("pos") + F.col("neg")).alias("pixels"))
    rows = packed.select(*keys, "mode", "gt_px", "pixels", "h", F.posexplode(F.array(*[F.lit(t) for t in thresholds])).alias("i", "threshold"))
    reach = lambda f: F.aggregate("h", F.lit(0).cast("long"), lambda acc, s: acc + F.when(s["k"] > F.col("i"), s[f]).otherwise(F.lit(0).cast("long")))
    out = rows.select(*keys, "mode", "threshold", "gt_px", "pixels", reach("pos").alias("tp"), reach("neg").alias("fp"))
    return out.withColumn("fn", F.col("gt_px") - F.col("tp"))


def with_scores(counts: DataFrame) -> DataFrame:
    """IoU, Dice (1 when both masks are empty) and area difference from confusion counts and pixel totals."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (counts.withColumn("iou", F.coalesce(tp / F.nullif(tp + fp + fn, F.lit(0)), F.lit(1.0))).withColumn("dice", F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(1.0)))
            .withColumn("area_delta", F.abs(tp + fp - F.col("gt_px")) / F.col("pixels")))


def threshold_sweep(probs: DataFrame, keys: Sequence[str] = ("image_id",), thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """Best polarity and threshold per key by (IoU, Dice, smaller area difference), with the supervised gate."""
    rows = with_scores(sweep_counts(probs, thresholds, keys))
    best = F.min(F.struct((-F.col("iou")).alias("a"), (-F.col("dice")).alias("b"), F.col("area_delta"), F.col("mode"), F.col("threshold"), F.col("iou"), F.col("dice")))
    out = rows.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in ("mode", "threshold", "iou", "dice", "area_delta")])
    return out.withColumn("passed", gate(GATES["supervised"]))


def minority_foreground(mask: DataFrame, flag: str = "gt") -> DataFrame:
    """Flip the polarity of images that are mostly set."""
    share = mask.groupBy("image_id").agg((F.avg(F.col(flag).cast("double")) > 0.5).alias("_flip"))
    return mask.join(share, "image_id").withColumn(flag, F.col(flag) != F.col("_flip")).drop("_flip")


def bucketed_median(df: DataFrame, keys: Sequence[str], value: str, name: str, buckets: int = 1000) -> DataFrame:
    """Exact median of values in [0, 1] in two passes: bucket counts first, then only the rows of the middle buckets."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(value) * buckets))
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_b")
    counts = counts.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    middle = counts.where((F.col("_before") <= high) & (F.col("_before") + F.col("_n") > low))
    inside = rows.join(middle.select(*keys, "_b", "_before", "_total"), [*keys, "_b"])
    inside = inside.groupBy(*keys, "_b", "_before", "_total", value).agg(F.count(F.lit(1)).alias("_k"))
    last = F.col("_before") + F.sum("_k").over(Window.partitionBy(*keys, "_b").orderBy(value))
    inside = inside.withColumn("_last", last)
    hit = lambda r: F.max(F.when((F.col("_last") > r) & (F.col("_last") - F.col("_k") <= r), F.col(value)))
    return inside.groupBy(*keys).agg(((hit(low) + hit(high)) / 2).alias(name))


def dataset_metrics(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, median and minimum of the case metrics per key."""
    keys = list(keys)
    out = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.avg("iou").alias("mean_iou"), F.min("iou").alias("min_iou"), F.avg("dice").alias("mean_dice"), F.avg("area_delta").alias("mean_area_delta"))
    for m in ("iou", "dice"):
        out = out.join(bucketed_median(cases, keys, m, f"median_{m}"), keys)
    return out


def choose_threshold(probs: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = VALIDATION_GRID) -> DataFrame:
    """Threshold with the best mean case metrics per key (first one on ties)."""
    cases = with_scores(sweep_counts(probs, thresholds, [*keys, "image_id"], ("direct",)))
    means = cases.groupBy(*keys, "threshold").agg(F.avg("iou").alias("mean_iou"), F.avg("dice").alias("mean_dice"), F.avg("area_delta").alias("mean_area_delta"))
    best = F.min(F.struct((-F.round("mean_iou", 12)).alias("a"), (-F.round("mean_dice", 12)).alias("b"), F.round("mean_area_delta", 12).alias("c"), F.col("threshold"), F.col("mean_iou"), F.col("mean_dice")))
    return means.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.threshold").alias("threshold"), F.col("b.mean_iou").alias("mean_iou"), F.col("b.mean_dice").alias("mean_dice"))


def gate(limits: Mapping[str, tuple[str, float]]) -> Column:
    """All named limits hold (a missing value fails)."""
    tests = [F.coalesce(F.col(c) >= v if op == ">=" else F.col(c) <= v, F.lit(False)) for c, (op, v) in limits.items()]
    return functools.reduce(lambda a, b: a & b, tests)


def quality_gate(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.withColumn("passed", gate(GATES[name]))


def confusion_matrix(classes: DataFrame, keys: Sequence[str] = (), ignore: int = IGNORE_INDEX) -> DataFrame:
    """Pixel counts per (truth, prediction), ignored truth pixels left out."""
    return classes.where(F.col("truth") != ignore).groupBy(*keys, "truth", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_iou(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n = F.col("n")
    sides = matrix.select(*keys, F.inline(F.array(
        F.struct(F.col("truth").alias("class_id"), n.alias("row"), F.lit(0).cast("long").alias("col"), F.when(F.col("truth") == F.col("prediction"), n).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("class_id"), F.lit(0).cast("long").alias("row"), n.alias("col"), F.lit(0).cast("long").alias("tp")))))
    out = sides.groupBy(*keys, "class_id").agg(*[F.sum(c).alias(c) for c in ("tp", "row", "col")])
    return out.select(*keys, "class_id", "tp", (F.col("col") - F.col("tp")).alias("fp"), (F.col("row") - F.col("tp")).alias("fn"),
                      (F.col("tp") / F.nullif(F.col("row") + F.col("col") - F.col("tp"), F.lit(0))).alias("iou"))


def multilabel_confusion(a: DataFrame, b: DataFrame, pixels: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Cross counts of two multi-label maps with a background row and column; ``total`` is the row's pixel count."""
    pixel = [*keys, "y", "x"]
    names = F.array(*[F.lit(c) for c in classes])

    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*pixel).agg(F.collect_set("damage_class").alias(name))

    rows = pixels.select(*pixel).join(sets(a, "_a"), pixel, "left").join(sets(b, "_b"), pixel, "left")
    label = lambda c: F.when(F.coalesce(F.size(F.array_intersect(c, names)), F.lit(0)) > 0, F.col(c)).otherwise(F.array(F.lit("background")))
    rows = rows.select(*keys, label("_a").alias("_a"), label("_b").alias("_b")).groupBy(*keys, "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("truth", F.explode("_a"))
    totals = rows.groupBy(*keys, "truth").agg(F.sum("n").alias("total"))
    cross = rows.withColumn("prediction", F.explode("_b")).groupBy(*keys, "truth", "prediction").agg(F.sum("n").alias("n"))
    return cross.join(totals, [*keys, "truth"])


def mask_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], pixels: int) -> DataFrame:
    """Areas, IoU (1 when both empty) and pixel mismatch rate."""
    n = mask_overlap(a, b, keys)
    both, x, y = F.col("both"), F.col("only_a"), F.col("only_b")
    return n.select(*keys, (both + x).alias("a_px"), (both + y).alias("b_px"), F.coalesce(both / F.nullif(both + x + y, F.lit(0)), F.lit(1.0)).alias("iou"), ((x + y) / F.lit(float(pixels))).alias("pmr"))


def field_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest and mean absolute difference of two value planes."""
    rows = a.select(*keys, "y", "x", F.col(value).alias("_a")).join(b.select(*keys, "y", "x", F.col(value).alias("_b")), [*keys, "y", "x"])
    d = F.abs(F.col("_a") - F.col("_b"))
    return rows.groupBy(*keys).agg(F.max(d).alias("linf"), F.avg(d).alias("mae"))


def parity_report(stages: DataFrame, measures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst case per tolerance with pass flags and overall status.

    ``stages``: stage, iou, pmr, linf, dcc, nodes per case and class; ``measures``: a, b.
    """
    keys = list(keys)
    at = lambda s, c: F.when(F.col("stage").isin(*s), F.col(c))
    worst = stages.groupBy(*keys).agg(
        F.max(at(["gray"], "linf")).alias("gray_linf"), F.max(at(["response"], "linf")).alias("response_linf"), F.max(at(["raw_mask"], "pmr")).alias("raw_pmr"), F.max(at(["open_mask"], "pmr")).alias("open_pmr"),
        F.min(at(["clean_mask", "final_mask"], "iou")).alias("clean_iou"), F.sum(at(["final_mask"], "dcc")).alias("dcc"), F.max(at(["skeleton"], "nodes")).alias("skeleton_nodes"))
    rel = F.abs(F.col("a") - F.col("b")) / F.greatest(F.lit(1e-9), F.when(F.col("b") == 0, 1.0).otherwise(F.abs("b")))
    err = measures.where((F.col("a") != 0) | (F.col("b") != 0)).groupBy(*keys).agg(F.max(rel).alias("measure_rel"))
    both = worst.join(err, keys, "left") if keys else worst.withColumn("_k", F.lit(1)).join(err.withColumn("_k", F.lit(1)), "_k").drop("_k")
    defaults = {"clean_iou": 1.0}
    both = both.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(defaults.get(c, 0.0))).alias(c) for c in TOLERANCES])
    for c, (op, v) in TOLERANCES.items():
        both = both.withColumn(f"pass_{c}", F.col(c) >= v if op == ">=" else F.col(c) <= v)
    ok = functools.reduce(lambda a, b: a & b, [F.col(f"pass_{c}") for c in TOLERANCES])
    return both.withColumn("status", F.when(ok, "pass").when((F.col("clean_iou") >= WARN_IOU) & (F.col("measure_rel") <= WARN_REL), "warn").otherwise("fail"))


def model_consistency(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per image: error, binary IoU and area difference of two probability maps."""
    rows = a.select("image_id", "y", "x", F.col("prob").alias("_a")).join(b.select("image_id", "y", "x", F.col("prob").alias("_b")), ["image_id", "y", "x"])
    ma, mb, d = F.col("_a") >= threshold, F.col("_b") >= threshold, F.abs(F.col("_a") - F.col("_b"))
    out = rows.groupBy("image_id").agg(F.avg(d).alias("mean_abs_error"), F.max(d).alias("max_abs_error"), F.count_if(ma & mb).alias("_i"), F.count_if(ma | mb).alias("_u"),
                                       F.avg(ma.cast("double")).alias("area_a"), F.avg(mb.cast("double")).alias("area_b"))
    return out.select("image_id", "mean_abs_error", "max_abs_error", F.coalesce(F.col("_i") / F.nullif("_u", F.lit(0)), F.lit(1.0)).alias("iou"), "area_a", "area_b", F.abs(F.col("area_a") - F.col("area_b")).alias("area_delta"))


def consistency_summary(cases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.avg("mean_abs_error").alias("mean_abs_error"), F.max("max_abs_error").alias("max_abs_error"),
                                    F.avg("iou").alias("mean_iou"), F.min("iou").alias("min_iou"), F.max("area_delta").alias("max_area_delta"))


def bland_altman(measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = F.col("a") - F.col("b")
    out = measures.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))
    return out.withColumn("lower", F.col("bias") - 1.96 * F.col("sd")).withColumn("upper", F.col("bias") + 1.96 * F.col("sd"))


def manifest_check(assets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Presence, size and digest of each manifest entry."""
    rows = manifest.select("asset_id", F.col("bytes").alias("_b"), F.col("sha256").alias("_s")).join(assets.select("asset_id", "bytes", "sha256"), "asset_id", "left")
    return rows.select("asset_id", F.col("bytes").isNotNull().alias("present"), F.coalesce(F.col("bytes") == F.col("_b"), F.lit(False)).alias("size_ok"), F.coalesce(F.col("sha256") == F.col("_s"), F.lit(False)).alias("digest_ok"))


def engine_latency(runs: DataFrame) -> DataFrame:
    """Runs per status and latency mean, median and 95th percentile per engine; equal latencies are counted first."""
    counts = runs.groupBy("engine_id", "status", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95)), F.col("n"))
    out = counts.groupBy("engine_id").agg(F.sum("n").alias("runs"), F.sum(F.when(F.col("status") == "ok", F.col("n")).otherwise(0)).alias("ok"),
                                          (F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n")).alias("mean_ms"), q.alias("q"))
    return out.select("engine_id", "runs", "ok", "mean_ms", F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"))


def remap_labels(classes: DataFrame, column: str, mapping: Mapping[int, str] = EXTERNAL_CLASSES, vocabulary: Mapping[str, int] = VOCABULARY, ignore: int = IGNORE_INDEX) -> DataFrame:
    """External class index to own vocabulary index, else the ignore index."""
    table = literal_map({int(k): int(vocabulary[v]) for k, v in mapping.items()})
    return classes.withColumn(column, F.coalesce(F.element_at(table, F.col(column).cast("int")), F.lit(ignore)).cast("long"))
