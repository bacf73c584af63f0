"""Damage records: physical units, severity, condition rating and roll-ups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rating as R
from ..functions.rating import RatingConfig
from .spatial import axis_islands, ordered_fold

# Region filters.
AREA_CLASSES = ["spalling_dark", "corrosion_rust", "efflorescence_white"]
AREA_REGION_FRACTION = 0.0005
AREA_LARGEST_FRACTION = 0.03
AREA_CONTAIN_FRACTION = 0.8
MIN_LENGTH_FRACTION = 0.04


def to_mm(records: DataFrame) -> DataFrame:
    """Add millimetre and square-centimetre columns; null without calibration."""
    k = F.col("mm_per_px")
    return (records.withColumn("area_mm2", F.col("area_px2") * k * k).withColumn("area_cm2", F.col("area_mm2") / 100.0)
            .withColumn("perimeter_mm", F.col("perimeter_px") * k).withColumn("length_mm", F.col("length_px") * k)
            .withColumn("width_mm", F.col("width_px") * k))


def rate_damages(records: DataFrame, reference_area: Column, cfg: RatingConfig = RatingConfig()) -> DataFrame:
    """Rate every current record of a known family."""
    ref = reference_area.cast("double")
    c = F.col
    rows = records.where((c("time_label") == "t1_current") & c("damage_class").isin(R.FAMILIES))
    rows = rows.withColumn("area_ratio", c("area_px2") / F.greatest(ref, F.lit(1.0)))
    rows = rows.withColumn("s_img", R.severity(c("damage_class"), c("area_ratio"), c("length_px"), c("width_px"), c("mm_per_px"), ref, cfg.environment))
    rows = rows.withColumn("fi", R.damage_factor(c("damage_class"), c("area_ratio"), c("length_px"), c("width_px"), c("mm_per_px"), ref))
    rows = rows.withColumn("fp", R.damage_weight(c("damage_class")))
    rows = rows.withColumn("d", R.damage_index(c("fi"), c("fp"))).withColumn("ec_rank", R.ordinal_rank(c("s_img"), cfg.taus))
    return (rows.withColumn("ec", R.ec_from_rank(c("ec_rank"))).withColumn("ec_label", R.ec_label(c("ec")))
            .withColumn("included", ~c("damage_class").isin(list(cfg.excluded)) if cfg.excluded else F.lit(True)))


def family_summary(images: DataFrame, rated: DataFrame, cfg: RatingConfig = RatingConfig()) -> DataFrame:
    """One row per image and family, also for families without damage."""
    grid = images.select("image_id", F.explode(F.array(*[F.lit(f) for f in R.FAMILIES])).alias("damage_class"))
    governing = F.min_by("record_id", F.struct(-F.col("ec_rank"), -F.col("s_img"), -F.col("d"), F.col("record_id"))) \
        if "record_id" in rated.columns else F.lit("").cast("string")
    stats = rated.groupBy("image_id", "damage_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("area_ratio").alias("area_ratio_sum"), F.max("s_img").alias("s_max"),
        F.avg("s_img").alias("s_mean"), F.max("ec_rank").alias("max_rank"), F.max("fi").alias("fi_max"),
        F.sum("d").alias("d_sum"), (F.max(governing) if "record_id" not in rated.columns else governing).alias("governing_record_id"))
    rows = grid.join(stats, ["image_id", "damage_class"], "left")
    zero = {"n": 0, "area_ratio_sum": 0.0, "s_max": 0.0, "s_mean": 0.0, "max_rank": 0, "fi_max": 0.0, "d_sum": 0.0, "governing_record_id": ""}
    rows = rows.na.fill(zero)
    delta = F.when(F.col("max_rank") > 0, R.extension_delta(F.col("n"), F.col("area_ratio_sum"), cfg)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("delta_family", delta)
    rows = rows.withColumn("family_rank", F.when(F.col("max_rank") > 0, F.least(F.lit(4), F.col("max_rank") + F.col("delta_family"))).otherwise(F.lit(0)).cast("long"))
    return (rows.withColumn("family_ec", R.ec_from_rank(F.col("family_rank"))).withColumn("family_ec_label", R.ec_label(F.col("family_ec")))
            .withColumn("included", ~F.col("damage_class").isin(list(cfg.excluded)) if cfg.excluded else F.lit(True)).drop("max_rank"))


def _image_sums(images: DataFrame, rated: DataFrame) -> DataFrame:
    sums = rated.where("included").groupBy("image_id").agg(
        F.max(F.when(F.col("d") > 0, F.col("d"))).alias("d_max"), F.sum(F.when(F.col("d") > 0, F.col("d"))).alias("d_sum"),
        F.max("ec_rank").alias("max_rank"), F.count(F.lit(1)).alias("n"), F.sum("area_ratio").alias("affected_area_ratio"),
        F.max("s_img").alias("s_max"), F.max("fi").alias("fi_max"),
        F.max(F.when(F.col("damage_class") == "exposed_rebar", F.col("s_img"))).alias("rebar_s"))
    return images.select("image_id").join(sums, "image_id", "left").na.fill(
        {"d_max": 0.0, "d_sum": 0.0, "max_rank": 0, "n": 0, "affected_area_ratio": 0.0, "s_max": 0.0, "fi_max": 0.0, "rebar_s": 0.0})


def gde(images: DataFrame, rated: DataFrame, cfg: RatingConfig = RatingConfig()) -> DataFrame:
    """Deterioration index per image with level, action and weighted index K."""
    rows = _image_sums(images, rated).withColumn("gde", R.gde_value(F.col("d_max"), F.col("d_sum")))
    level, action = R.gde_band(F.col("gde"))
    return rows.select("image_id", "d_max", "d_sum", "gde", level.alias("gde_level"), action.alias("gde_action"), (F.col("gde") * cfg.fr).alias("k"))


def element_rating(images: DataFrame, rated: DataFrame, cfg: RatingConfig = RatingConfig()) -> DataFrame:
    """Element rank, condition state and technical note per image."""
    critical = cfg.fr >= cfg.critical_weight
    rows = _image_sums(images, rated)
    delta = F.when(F.col("max_rank") > 0, R.extension_delta(F.col("n"), F.col("affected_area_ratio"), cfg)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("delta", delta)
    rows = rows.withColumn("element_rank", F.when(F.col("max_rank") > 0, F.least(F.lit(4), F.col("max_rank") + F.col("delta"))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("ec", R.ec_from_rank(F.col("element_rank"))).withColumn("ec_label", R.ec_label(F.col("ec")))
    rows = rows.withColumn("structure_rank", R.structure_rank(F.col("element_rank"), critical))
    emergency = F.lit(cfg.allow_emergency) & (F.col("s_max") >= 0.95) & (F.col("rebar_s") >= 0.90) & (F.col("affected_area_ratio") >= 0.003)
    nt = (F.when(F.col("element_rank") == 0, 5).when(emergency, 0)
          .otherwise(F.lit(5) - F.greatest(F.lit(1).cast("long"), F.least(F.lit(4).cast("long"), F.col("structure_rank")))).cast("long"))
    rows = rows.withColumn("nt", nt).withColumn("nt_label", R.nt_label(F.col("nt"))).withColumn("critical_element", F.lit(critical))
    return rows.select("image_id", "n", "affected_area_ratio", "s_max", "fi_max", "delta", "element_rank", "ec", "ec_label",
                       "critical_element", "structure_rank", "nt", "nt_label")


def summarize_records(records: DataFrame) -> DataFrame:
    """Counts per class and geometry totals per image."""
    cls = F.col("damage_class")
    crack = cls == "cracks"
    counts = [F.count_if(cls == f).alias(f"n_{f}") for f in R.FAMILIES]
    return records.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("total_objects"), *counts,
        F.coalesce(F.sum(F.when(cls == "spalling_dark", F.col("area_px2"))), F.lit(0.0)).alias("spalling_area_px2"),
        F.coalesce(F.sum(F.when(cls == "exposed_rebar", F.col("area_px2"))), F.lit(0.0)).alias("rebar_area_px2"),
        F.coalesce(F.sum(F.when(crack, F.col("length_px"))), F.lit(0.0)).alias("crack_length_total_px"),
        F.coalesce(F.avg(F.when(crack, F.col("length_px"))), F.lit(0.0)).alias("crack_length_mean_px"),
        F.coalesce(F.avg(F.when(crack & (F.col("width_px") > 0), F.col("width_px"))), F.lit(0.0)).alias("crack_width_mean_px"),
        F.coalesce(F.max(F.when(crack & (F.col("width_px") > 0), F.col("width_px"))), F.lit(0.0)).alias("crack_width_max_px"))


def significant_regions(records: DataFrame, image_area: Column, min_area: float = 30.0) -> DataFrame:
    """Area records that are not negligible within their image, epoch and class."""
    keys = ["image_id", "time_label", "damage_class"]
    rows = records.where(F.col("damage_class").isin(AREA_CLASSES))
    largest = rows.groupBy(*keys).agg(F.max("area_px2").alias("largest"))
    limit = F.greatest(F.lit(max(1.0, min_area)), AREA_REGION_FRACTION * image_area, AREA_LARGEST_FRACTION * F.col("largest"))
    return rows.join(largest, keys).where(F.col("area_px2") >= limit).drop("largest")


def consolidate_regions(records: DataFrame, image_area: Column, min_area: float = 30.0, cell: float = 128.0) -> DataFrame:
    """Drop negligible regions, then absorb boxes that lie at least 80 % inside a larger kept box of the same class.

    The absorbing host must overlap the box, so splitting a class into islands of overlapping boxes keeps the sequential
    result exact. Returns the kept records with their own and absorbed area.
    """
    keys = ["image_id", "time_label", "damage_class"]
    rows = significant_regions(records, image_area, min_area)
    for axis, size in (("x", "w"), ("y", "h")):
        low = F.col(f"bbox_{axis}").cast("double")
        rows = axis_islands(rows, [*keys, *(["island_x"] if axis == "y" else [])], low, low + F.col(f"bbox_{size}"), cell, f"island_{axis}")

    def step(kept: dict, arrays: list) -> list:
        out, ids = [], kept["ids"]
        for record_id, x, y, w, h in zip(*arrays):
            host = record_id
            if ids:
                boxes = kept["boxes"][:len(ids)]
                ix = np.maximum(0, np.minimum(x + w, boxes[:, 0] + boxes[:, 2]) - np.maximum(x, boxes[:, 0]))
                iy = np.maximum(0, np.minimum(y + h, boxes[:, 1] + boxes[:, 3]) - np.maximum(y, boxes[:, 1]))
                inside = np.flatnonzero(ix * iy >= AREA_CONTAIN_FRACTION * w * h)
                if len(inside):
                    host = ids[inside[0]]
            if host == record_id:
                if len(ids) == len(kept["boxes"]):  # room doubles, so a box is copied a bounded number of times
                    kept["boxes"] = np.vstack([kept["boxes"], np.zeros_like(kept["boxes"])])
                kept["boxes"][len(ids)] = (x, y, w, h)
                ids.append(record_id)
            out.append(host)
        return out

    folded = ordered_fold(rows, [*keys, "island_x", "island_y"], [F.col("area_px2").desc(), F.col("record_id").asc()], lambda: {"ids": [], "boxes": np.zeros((16, 4))}, step,
                          ["record_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h"], "host_id", T.StringType())
    own = F.col("record_id") == F.col("host_id")
    keep = {c: F.max(F.when(own, F.col(c))).alias(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h", "perimeter_px")}
    return folded.groupBy(*keys, F.col("host_id").alias("record_id")).agg(
        F.sum("area_px2").alias("area_px2"), (F.count(F.lit(1)) - 1).alias("absorbed"), *keep.values())


def classify_box_aspect(records: DataFrame, image_side: Column, cfg: RatingConfig = RatingConfig()) -> DataFrame:
    """Box aspect and the keep rule for exposed reinforcement (elongated, long enough, large enough)."""
    minor = F.greatest(F.lit(1), F.least("bbox_w", "bbox_h"))
    major = F.greatest("bbox_w", "bbox_h")
    rows = records.withColumn("major_px", major).withColumn("aspect_ratio", major / minor)
    keep = ((F.col("aspect_ratio") >= max(3.0, cfg.min_aspect)) & (F.col("major_px") >= MIN_LENGTH_FRACTION * image_side)
            & (F.col("area_px2") >= 2 * max(1.0, cfg.min_area)))
    return rows.where((F.col("damage_class") != "exposed_rebar") | keep)
