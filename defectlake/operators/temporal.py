"""Change between two inspections: masks, registration, quality gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Registration and quality limits.
EDGE_MAX_SIDE = 160
QUALITY_MAX_SIDE = 320
MIN_IMPROVEMENT = 0.035
LIMITS = {"overlap": (0.85, 0.92), "illumination": (0.22, 0.12), "sharpness": (0.45, 0.65), "similarity": (0.35, 0.55),
          "clipped": (0.35, 0.20)}
LOW_TEXTURE = 3.0


def epoch_flags(masks: DataFrame) -> DataFrame:
    """One row per (pair, class, pixel) with membership in both epochs, from sparse masks of both epochs in one table."""
    return masks.groupBy("pair_id", "damage_class", "y", "x").agg(
        F.max((F.col("epoch") == "t1").cast("int")).alias("cur"), F.max((F.col("epoch") == "t0").cast("int")).alias("prev"))


def mask_change(masks: DataFrame, mm_per_px: float | None = None) -> DataFrame:
    """Growth, reduction and overlap areas per pair and class; rates are null when t0 is empty.

    Both epochs are shuffled once by pixel; the second aggregation starts with partial counts on the map side.
    """
    flags = epoch_flags(masks)
    cur, prev = F.col("cur") == 1, F.col("prev") == 1
    out = flags.groupBy("pair_id", "damage_class").agg(
        F.count_if(cur & prev).cast("double").alias("intersection_px2"), F.count(F.lit(1)).cast("double").alias("union_px2"),
        F.count_if(prev).cast("double").alias("previous_px2"), F.count_if(cur).cast("double").alias("current_px2"),
        F.count_if(cur & ~prev).cast("double").alias("growth_px2"), F.count_if(prev & ~cur).cast("double").alias("reduction_px2"))
    base = F.nullif("previous_px2", F.lit(0.0))
    out = (out.withColumn("net_px2", F.col("current_px2") - F.col("previous_px2"))
           .withColumn("iou", F.coalesce(F.col("intersection_px2") / F.nullif("union_px2", F.lit(0.0)), F.lit(1.0)))
           .withColumn("growth_pct", 100.0 * F.col("growth_px2") / base)
           .withColumn("reduction_pct", 100.0 * F.col("reduction_px2") / base)
           .withColumn("net_pct", 100.0 * F.col("net_px2") / base))
    factor = F.lit(float(mm_per_px) ** 2 if mm_per_px and mm_per_px > 0 else None).cast("double")
    for name in ("previous", "current", "growth", "reduction", "net"):
        out = out.withColumn(f"{name}_mm2", F.col(f"{name}_px2") * factor)
    return out


def change_pixels(masks: DataFrame) -> DataFrame:
    """Pixels that appeared (growth) or disappeared (reduction), labelled with their source class."""
    flags = epoch_flags(masks).where(F.col("cur") != F.col("prev"))
    change = F.when(F.col("cur") == 1, "growth").otherwise("reduction")
    return flags.select("pair_id", "damage_class", change.alias("change"), "y", "x")


def edge_map(gray: DataFrame, step: int = 1, keys: tuple[str, ...] = ("image_id",), value: str = "g") -> DataFrame:
    """Central-difference edge magnitude on every ``step``-th pixel; zero on the border of the subsampled grid."""
    small = gray.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    small = small.select(*keys, (F.col("y") / step).cast("long").alias("y"), (F.col("x") / step).cast("long").alias("x"), F.col(value).alias("_v"))
    row = Window.partitionBy(*keys, "y").orderBy("x")
    col = Window.partitionBy(*keys, "x").orderBy("y")
    dx = F.abs(F.lead("_v").over(row) - F.lag("_v").over(row))
    dy = F.abs(F.lead("_v").over(col) - F.lag("_v").over(col))
    return small.withColumn("_dx", dx).withColumn("_dy", dy).select(
        *keys, "y", "x", F.coalesce(F.col("_dx") + F.col("_dy"), F.lit(0)).cast("double").alias("edge"))


def registration_step(height: int, width: int) -> int:
    """Subsampling that keeps edge maps within ``EDGE_MAX_SIDE`` pixels on both sides."""
    return max(1, -(-max(height, width) // EDGE_MAX_SIDE))


def search_radius(height: int, width: int, step: int) -> int:
    full = min(96, max(6, round(min(height, width) * 0.12)))
    small = min(-(-height // step), -(-width // step))
    return min(max(1, -(-full // step)), max(1, (small - 6) // 2))


def shift_scores(edge_cur: DataFrame, edge_prev: DataFrame, height: int, width: int, step: int = 1) -> DataFrame:
    """Mean absolute edge difference of every integer shift on a fixed central region.

    Edge maps are at most 160 pixels wide and high (``step`` from :func:`registration_step`), so one pair fits in a single
    packed row; every pair is scored by an array operation instead of multiplying its pixels by all shifts in a join. A
    pair too small for a search gives one row without a score.
    """
    radius = search_radius(height, width, step)
    h, w = -(-height // step), -(-width // step)
    if max(h, w) > EDGE_MAX_SIDE:
        raise ValueError(f"edge maps exceed {EDGE_MAX_SIDE} pixels; take registration_step({height}, {width}) = {registration_step(height, width)}")
    if w - radius - 1 <= radius + 1 or h - radius - 1 <= radius + 1:
        zero = F.lit(0).cast("long")
        return edge_cur.select("image_id").union(edge_prev.select("image_id")).distinct().select("image_id", zero.alias("dx"), zero.alias("dy"), F.lit(None).cast("double").alias("score"))
    both = edge_cur.withColumnRenamed("edge", "cur").join(edge_prev.withColumnRenamed("edge", "prev"), ["image_id", "y", "x"], "full")
    packed = both.groupBy("image_id").agg(F.collect_list(F.struct("y", "x", "cur", "prev")).alias("pixels")).select(
        "image_id", F.transform("pixels", lambda p: (p["y"] * w + p["x"]).cast("int")).alias("at"),
        F.col("pixels.cur").alias("cur"), F.col("pixels.prev").alias("prev"))
    x0, x1, y0, y1 = radius + 1, w - radius - 1, radius + 1, h - radius - 1
    stride = 2 if min(x1 - x0, y1 - y0) >= 48 else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for image_id, at, cur, prev in zip(batch["image_id"], batch["at"], batch["cur"], batch["prev"]):
                a, b = np.full(h * w, np.nan), np.full(h * w, np.nan)
                a[at], b[at] = np.asarray(cur, dtype=float), np.asarray(prev, dtype=float)
                a, b = a.reshape(h, w), b.reshape(h, w)
                region = a[y0:y1:stride, x0:x1:stride]
                for dy in range(-radius, radius + 1):
                    for dx in range(-radius, radius + 1):
                        moved = b[y0 - dy:y1 - dy:stride, x0 - dx:x1 - dx:stride]
                        diff = np.abs(region - moved)
                        seen = np.count_nonzero(~np.isnan(diff))  # pixels missing from an incomplete image do not count
                        if seen:
                            out.append((image_id, dx, dy, float(np.nansum(diff) / seen)))
            yield pd.DataFrame(out, columns=["image_id", "dx", "dy", "score"])

    return packed.mapInPandas(run, "image_id long, dx long, dy long, score double")


def _shift_key() -> Column:
    dx, dy = F.col("dx"), F.col("dy")
    return F.struct(F.col("score").alias("s"), (F.abs(dx) + F.abs(dy)).alias("a"), F.abs(dy).alias("b"), F.abs(dx).alias("c"), dy.alias("dy"), dx.alias("dx"))


def best_shift(scores: DataFrame, radius: int, step: int = 1) -> DataFrame:
    """Coarse-to-fine best shift with its acceptance decision and reason."""
    coarse = 2 if radius >= 5 else 1
    on_grid = ((F.col("dx") + radius) % coarse == 0) & ((F.col("dy") + radius) % coarse == 0)
    zero = (F.col("dx") == 0) & (F.col("dy") == 0)
    first = scores.groupBy("image_id").agg(F.min(F.when(on_grid | zero, _shift_key())).alias("c"), F.min(F.when(zero, F.col("score"))).alias("score_zero"))
    near = scores.join(first, "image_id").where((F.abs(F.col("dx") - F.col("c.dx")) <= 2) & (F.abs(F.col("dy") - F.col("c.dy")) <= 2))
    best = near.groupBy("image_id").agg(F.min(_shift_key()).alias("b"), F.first("score_zero").alias("score_zero"))
    dx, dy, s, z = F.col("b.dx"), F.col("b.dy"), F.col("b.s"), F.col("score_zero")
    gain = (z - s) / F.greatest(z, F.lit(1e-6))
    boundary = (F.abs(dx) >= radius) | (F.abs(dy) >= radius)
    small = z.isNull()
    accepted = ((dx != 0) | (dy != 0)) & (gain >= MIN_IMPROVEMENT) & ~boundary & ~small
    return best.select(
        "image_id", (dx * step).alias("estimated_dx"), (dy * step).alias("estimated_dy"), accepted.alias("accepted"), boundary.alias("boundary_hit"),
        F.when(accepted, dx * step).otherwise(F.lit(0)).cast("long").alias("dx"), F.when(accepted, dy * step).otherwise(F.lit(0)).cast("long").alias("dy"),
        F.coalesce(z, F.lit(0.0)).alias("score_before"), F.coalesce(F.when(accepted, s).otherwise(z), F.lit(0.0)).alias("score_after"),
        F.coalesce(F.when(accepted, gain).otherwise(F.greatest(F.lit(0.0), gain)), F.lit(0.0)).alias("improvement"),
        F.when(small, "image_too_small").when(accepted, "translation_improved_edge_match").when(boundary, "search_boundary_hit").otherwise("no_reliable_translation_gain").alias("reason"))


def apply_shift(previous: DataFrame, current: DataFrame, shifts: DataFrame, value: str = "g") -> DataFrame:
    """Move t0 onto t1; pixels that t0 does not cover take the t1 value."""
    moved = previous.join(shifts.select("image_id", "dx", "dy"), "image_id").select(
        "image_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.col(value).alias("_prev"))
    return current.join(moved, ["image_id", "y", "x"], "left").select(
        "image_id", "y", "x", F.coalesce("_prev", F.col(value)).alias(value))


def pair_quality_metrics(current: DataFrame, previous: DataFrame, shifts: DataFrame, height: int, width: int, value: str = "g") -> DataFrame:
    """Acquisition comparability of an aligned pair."""
    step = max(1, -(-max(height, width) // QUALITY_MAX_SIDE))
    both = current.select("image_id", "y", "x", F.col(value).cast("double").alias("cur")).join(
        previous.select("image_id", "y", "x", F.col(value).cast("double").alias("prev")), ["image_id", "y", "x"])
    both = both.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    row = Window.partitionBy("image_id", "y").orderBy("x")
    col = Window.partitionBy("image_id", "x").orderBy("y")
    for name in ("cur", "prev"):
        both = both.withColumn(f"_r_{name}", F.abs(F.lead(name).over(row) - F.lag(name).over(row)))
    for name in ("cur", "prev"):
        both = both.withColumn(f"edge_{name}", F.col(f"_r_{name}") + F.abs(F.lead(name).over(col) - F.lag(name).over(col)))
    clip = lambda c: F.avg(((F.col(c) <= 5) | (F.col(c) >= 250)).cast("double"))
    m = both.groupBy("image_id").agg(
        F.avg("cur").alias("mean_luminance_t1"), F.avg("prev").alias("mean_luminance_t0"),
        F.avg("edge_cur").alias("sharpness_t1"), F.avg("edge_prev").alias("sharpness_t0"),
        F.avg(F.col("edge_cur") * F.col("edge_prev")).alias("_ab"), F.avg(F.col("edge_cur") * F.col("edge_cur")).alias("_aa"),
        F.avg(F.col("edge_prev") * F.col("edge_prev")).alias("_bb"), F.avg(F.abs(F.col("edge_cur") - F.col("edge_prev"))).alias("_diff"),
        F.count("edge_cur").alias("_n"), clip("cur").alias("clipped_t1"), clip("prev").alias("clipped_t0"))
    a, b = F.coalesce("sharpness_t1", F.lit(0.0)), F.coalesce("sharpness_t0", F.lit(0.0))
    cov, var = F.col("_ab") - a * b, F.sqrt(F.greatest(F.lit(0.0), (F.col("_aa") - a * a) * (F.col("_bb") - b * b)))
    similarity = (F.when(F.col("_n") == 0, 0.0).when(var * F.col("_n") > 1e-9, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.nullif(var, F.lit(0.0)))))
                  .when(F.col("_diff") < 1e-6, 1.0).otherwise(0.0))
    top = F.greatest(a, b)
    overlap = (F.greatest(F.lit(0), F.lit(width) - F.abs("dx")) * F.greatest(F.lit(0), F.lit(height) - F.abs("dy"))) / F.lit(float(width * height))
    return m.join(shifts.select("image_id", "dx", "dy", "reason"), "image_id").select(
        "image_id", "reason", F.greatest(F.lit(0.0), overlap).alias("overlap_ratio"),
        (F.abs(F.col("mean_luminance_t1") - F.col("mean_luminance_t0")) / 255.0).alias("illumination_delta"),
        "mean_luminance_t1", "mean_luminance_t0", a.alias("sharpness_t1"), b.alias("sharpness_t0"), top.alias("sharpness_max"),
        F.when(top > 1e-6, F.least(a, b) / F.nullif(top, F.lit(0.0))).otherwise(1.0).alias("sharpness_ratio"),
        similarity.alias("edge_similarity"), "clipped_t1", "clipped_t0", F.greatest("clipped_t1", "clipped_t0").alias("clipped_max"))


def temporal_gate(metrics: DataFrame) -> DataFrame:
    """Turn pair metrics into issues, warnings, status and whether change may be quantified."""
    low = lambda c, k: (F.col(c) < LIMITS[k][0], F.col(c) < LIMITS[k][1])
    high = lambda c, k: (F.col(c) > LIMITS[k][0], F.col(c) > LIMITS[k][1])
    rules = [(*low("overlap_ratio", "overlap"), "insufficient_overlap", "reduced_overlap"),
             (*high("illumination_delta", "illumination"), "illumination_mismatch", "illumination_difference"),
             (*low("sharpness_ratio", "sharpness"), "sharpness_mismatch", "sharpness_difference"),
             (*low("edge_similarity", "similarity"), "geometric_mismatch", "geometric_consistency_low"),
             (*high("clipped_max", "clipped"), "exposure_clipping", "exposure_warning")]
    unreliable = F.col("reason").isin("search_boundary_hit", "registration_grid_mismatch", "image_too_small")
    issues = F.array_compact(F.array(F.when(unreliable, "registration_unreliable"), *[F.when(bad, name) for bad, _, name, _ in rules]))
    warnings = F.array_compact(F.array(*[F.when(~bad & warn, name) for bad, warn, _, name in rules], F.when(F.col("sharpness_max") < LOW_TEXTURE, "low_texture")))
    out = metrics.withColumn("issues", issues).withColumn("warnings", warnings)
    status = F.when(F.size("issues") > 0, "fail").when(F.size("warnings") > 0, "warning").otherwise("pass")
    return out.withColumn("status", status).withColumn("validated", F.size("issues") == 0)


def change_totals(stats: DataFrame) -> DataFrame:
    """Total growth and reduction per pair in mm² where calibrated, else px²."""
    return stats.groupBy("pair_id").agg(
        F.sum(F.coalesce("growth_mm2", "growth_px2")).alias("growth_total"), F.sum(F.coalesce("reduction_mm2", "reduction_px2")).alias("reduction_total"),
        F.bool_or(F.col("growth_mm2").isNotNull()).alias("calibrated"))
