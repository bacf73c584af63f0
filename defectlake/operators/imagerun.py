"""The image run: masks of all damage families from pixels, their separation and the records that ratings start from.

Every family goes through response, candidates, opening and closing, and its own rules; classes are staged as tables of set
pixels, so that each step costs what its mask holds. Spalling grows from cores only inside its base, and rebar is looked
for inside the spalling that was accepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import components as C
from . import raster as R
from .spatial import tasks_for

KEY = ["image_id"]
PIXEL = ["image_id", "y", "x"]
# Families in the order of the run, kernel of their cleaning steps, least area and elongation of a record.
FAMILIES = ("cracks", "spalling_dark", "corrosion_rust", "efflorescence_white", "exposed_rebar")
CLEAN_RADIUS, REBAR_RADIUS, CRACK_RADIUS = 2, 1, 1


def base_table(pixels: DataFrame, kernel: int) -> tuple[DataFrame, DataFrame]:
    """Pixels with all measures that the rules read, percentiles over the content only, and the content rectangles.

    ``gray`` is stretched between percentiles of the content; pixels of a frame take the nearest content pixel.
    """
    rows = R.to_hsv(R.to_gray(pixels)).withColumnRenamed("gray", "lum")
    rows = checkpoint(rows.select(*PIXEL, "r", "g", "b", "lum", "hue", "sat", "val"))
    rects = checkpoint(R.frame_rect(rows, "lum"))
    inside = F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
    rows = rows.join(rects, KEY).withColumn("valid", inside).drop("x0", "y0", "x1", "y1")
    ps = R.image_percentiles(rows.where("valid"), "lum", [2, 98])
    flat = F.col("p98") <= F.col("p2") + 1e-6
    gain = F.least(F.lit(R.STRETCH_MAX_GAIN), 255.0 / F.when(~flat, F.col("p98") - F.col("p2")))
    rows = rows.join(ps, KEY).withColumn("gray", F.when(flat, F.col("lum")).otherwise(R.clamp((F.col("lum") - F.col("p2")) * gain, 0, 255))).drop("p2", "p98")
    framed = rows.where("framed")
    if not framed.isEmpty():
        content = R.clamp_to_rect(framed, rects, "gray")
        rows = rows.where("not framed").unionByName(framed.drop("gray").join(content, PIXEL))
    rows = checkpoint(rows.drop("framed"))
    # All windows are taken by tile with a margin, after one shuffle; a black hat reaches twice its radius.
    texture, by = max(5, min(R.odd(kernel), 21)), [*KEY, "_ty", "_tx"]
    rows = C.tiled(rows, KEY, max(R.odd(kernel), texture) - 1, tasks=tasks_for(rows))
    rows = R.roughness(R.blackhat(rows, "gray", kernel, "response", by), "lum", keys=by)
    rows = C.home(rows.withColumn("texture", F.col("response")) if texture == R.odd(kernel) else R.blackhat(rows, "gray", texture, "texture", by))
    return checkpoint(rows.join(R.image_percentiles(rows.where("valid"), "gray", [18, 45, 72]), KEY)), rects


def candidates(rows: DataFrame, family: str, threshold: float) -> DataFrame:
    """Content pixels that meet the rule of a family."""
    c = F.col
    red = (c("r") > c("g") + 12) & (c("r") > c("b") + 18) & (c("sat") > 0.22) & (c("val") > 0.16) & ((c("hue") < 55) | (c("hue") > 330))
    dark = c("gray") < F.least(F.lit(120.0), c("p18") + max(8.0, threshold * 0.25))
    rule = {"cracks": c("response") > threshold, "spalling_dark": dark | ((c("texture") > max(10.0, threshold * 0.55)) & (c("gray") < c("p45"))),
            "corrosion_rust": red, "efflorescence_white": (c("val") > 0.72) & (c("sat") < 0.28) & (c("gray") > c("p72"))}[family]
    return rows.where(c("valid") & rule).select(*PIXEL)


def cleaned(mask: DataFrame, height: int, width: int, radius: int) -> DataFrame:
    """Opening against isolated pixels, then closing over short gaps."""
    return C.morph(mask, KEY, height, width, (C.erode, radius), (C.dilate, 2 * radius), (C.erode, radius))


def grown_cores(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Cores that survive a wide opening, grown by a few pixels inside the mask."""
    grown = C.morph(mask, KEY, height, width, (C.erode, R.SPALL_CORE_PX // 2), (C.dilate, R.SPALL_CORE_PX // 2 + R.SPALL_GROW_PX))
    return mask.join(grown, PIXEL, "left_semi")


def contrasted(mask: DataFrame, rows: DataFrame, min_delta: float, sign: int, rough: str | None = None) -> DataFrame:
    """Components that differ enough from the content around them, and are rough enough where that is asked."""
    labels = checkpoint(C.label_components(mask, KEY))
    stats = R.filter_by_contrast(labels, rows, KEY, min_delta, sign, "gray", rough, R.SPALL_MIN_ROUGHNESS if rough else 0.0, ring=rows.where("valid"))
    return labels.join(stats.where("kept").select(*KEY, "label"), [*KEY, "label"], "left_semi").select(*PIXEL)


def without_border(mask: DataFrame, rects: DataFrame) -> DataFrame:
    return R.drop_small_border(C.label_components(mask, KEY), KEY, rects.select("image_id", "x0", "y0", "x1", "y1")).select(*PIXEL)


def family_masks(pixels: DataFrame, height: int, width: int, threshold: float = 35.0, kernel: int = 15) -> DataFrame:
    """Set pixels ``(image_id, damage_class, stage, y, x)`` of every family after its candidates, its cleaning and its own rules.

    Stages: ``candidate``, ``clean`` and ``mask``, the last before families are told apart.
    """
    rows, rects = base_table(pixels, kernel)
    out = []

    def stage(family: str, name: str, mask: DataFrame) -> DataFrame:
        mask = checkpoint(mask.select(*PIXEL))
        out.append(mask.select("image_id", F.lit(family).alias("damage_class"), F.lit(name).alias("stage"), "y", "x"))
        return mask

    first = {f: stage(f, "candidate", candidates(rows, f, threshold)) for f in FAMILIES[:4]}
    strong = R.reconstruct_by_opening(C.label_components(first["cracks"], KEY), KEY, height, width)
    stage("cracks", "mask", C.closing(stage("cracks", "clean", strong), KEY, height, width, CRACK_RADIUS))
    base = stage("spalling_dark", "clean", cleaned(first["spalling_dark"], height, width, CLEAN_RADIUS))
    spall = contrasted(grown_cores(base, height, width), rows, max(R.SPALL_MIN_CONTRAST, threshold * R.SPALL_CONTRAST_T), -1, "rough")
    spall = stage("spalling_dark", "mask", without_border(C.closing(spall, KEY, height, width, R.SPALL_SMOOTH_PX // 2), rects))
    rust = stage("corrosion_rust", "clean", cleaned(first["corrosion_rust"], height, width, CLEAN_RADIUS))
    stage("corrosion_rust", "mask", without_border(rust, rects))
    white = stage("efflorescence_white", "clean", cleaned(first["efflorescence_white"], height, width, CLEAN_RADIUS))
    stage("efflorescence_white", "mask", without_border(contrasted(white, rows, max(R.EFF_MIN_CONTRAST, threshold * R.EFF_CONTRAST_T), 1), rects))
    bars = stage("exposed_rebar", "candidate", R.rebar_candidates(rows, spall))
    stage("exposed_rebar", "mask", stage("exposed_rebar", "clean", cleaned(bars, height, width, REBAR_RADIUS)))
    masks = out[0]
    for part in out[1:]:
        masks = masks.unionByName(part)
    return masks


def image_run(pixels: DataFrame, height: int, width: int, threshold: float = 35.0, kernel: int = 15) -> DataFrame:
    """Final masks ``(image_id, damage_class, y, x)`` of all families of all images."""
    masks = family_masks(pixels, height, width, threshold, kernel).where("stage = 'mask'").drop("stage")
    return checkpoint(R.separate_families(masks, KEY, height, width))


def run_records(masks: DataFrame, height: int, width: int, min_area: int = 12) -> DataFrame:
    """Records of the components of at least ``min_area`` pixels, with the measures that ratings read, in pixels."""
    keys = [*KEY, "damage_class"]
    parts = C.component_features(C.label_components(masks, keys), keys, height, width).where(F.col("area") >= min_area)
    return parts.select(*keys, "label", F.lit("t1_current").alias("time_label"), F.col("area").cast("double").alias("area_px2"), F.col("axis_length").alias("length_px"),
                        F.col("width").alias("width_px"), F.lit(None).cast("double").alias("mm_per_px"))
