"""Scene context: exclude irrelevant surroundings and name what lies under a finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import components as C

# Scene class names by group and gating limits.
EXCLUDE = ["sky", "tree", "grass", "plant", "flower", "palm", "field", "earth", "land", "sand", "mountain", "hill", "dirt track",
           "water", "sea", "river", "lake", "waterfall", "fountain", "swimming pool", "person", "animal", "car", "truck", "bus", "van", "boat", "ship",
           "airplane", "bicycle", "minibike", "signboard", "trade name", "poster", "painting", "flag", "streetlight", "traffic light", "pole",
           "awning", "canopy", "tent", "apparel", "bag", "ashcan", "bulletin board"]
STRUCTURE = ["wall", "building", "floor", "ceiling", "road", "sidewalk", "path", "runway", "column", "pier", "bridge", "stairs", "stairway",
             "step", "railing", "bannister", "fence", "base", "tower", "skyscraper", "house", "hovel", "grandstand", "stage", "rock", "countertop"]
MIN_CONFIDENCE, SHARE = 0.35, 0.6
ABSTAIN_EXCLUDED, ABSTAIN_STRUCTURE = 0.9, 0.03
MIN_OBJECT_SHARE, MAX_PER_CLASS, MAX_OBJECTS = 0.004, 4, 24


def scene_group(label: Column) -> Column:
    """Group of a scene class; of a list of names, the one before the first comma or semicolon counts."""
    name = F.trim(F.regexp_extract(F.lower(label), "^[^,;]*", 0))
    return F.when(name.isin(STRUCTURE), "structure").when(name.isin(EXCLUDE), "irrelevant").otherwise("neutral")


def with_groups(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach class name and group; the class dictionary is broadcast by Spark when it is small."""
    return cells.join(labels.select("class_id", "label", scene_group(F.col("label")).alias("scene_group")), "class_id", "left") \
        .withColumn("scene_group", F.coalesce("scene_group", F.lit("neutral")))


def excluded(mode: str = "conservative", min_confidence: float = MIN_CONFIDENCE) -> Column:
    drop = F.col("scene_group") != "structure" if mode == "strict" else F.col("scene_group") == "irrelevant"
    return drop & (F.col("conf") >= min_confidence)


def exclusion_mask(cells: DataFrame, mode: str = "conservative", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return cells.where(excluded(mode, min_confidence)).select("image_id", "cell_y", "cell_x")


def gating_mask(cells: DataFrame, mode: str = "conservative", min_confidence: float = MIN_CONFIDENCE, abstain: bool = True) -> DataFrame:
    """The exclusion mask without the images on which gating abstains; for these nothing is removed or cut."""
    mask = exclusion_mask(cells, mode, min_confidence)
    if not abstain:
        return mask
    return mask.join(scene_summary(cells, mode, min_confidence).where("abstained").select("image_id"), "image_id", "left_anti")


def scene_summary(cells: DataFrame, mode: str = "conservative", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Excluded and structural share, the eight largest classes and whether gating should abstain."""
    per = cells.groupBy("image_id", "class_id", "label", "scene_group").agg(F.count(F.lit(1)).alias("n"), F.count_if(excluded(mode, min_confidence)).alias("_x"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("class_id"), F.col("label"), F.col("n")))), 1, 8)
    out = per.groupBy("image_id").agg(F.sum("n").alias("cells"), F.sum("_x").alias("_x"), F.sum(F.when(F.col("scene_group") == "structure", F.col("n")).otherwise(0)).alias("_s"), top.alias("_t"))
    out = out.withColumn("excluded_ratio", F.col("_x") / F.col("cells")).withColumn("structure_ratio", F.col("_s") / F.col("cells"))
    return (out.withColumn("abstained", (F.col("excluded_ratio") > ABSTAIN_EXCLUDED) & (F.col("structure_ratio") < ABSTAIN_STRUCTURE))
            .withColumn("top_classes", F.transform("_t", lambda t: F.struct(t["label"].alias("label"), (t["n"] / F.col("cells")).alias("share")))).drop("_x", "_s", "_t"))


def cell_of(axis: Column, cells: int, pixels: int) -> Column:
    return F.least(F.lit(cells - 1), F.floor((axis + 0.5) * cells / F.lit(float(pixels)))).cast("long")


def _at_cells(pixels: DataFrame, grid: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    return pixels.withColumn("cell_y", cell_of(F.col("y"), grid[0], size[0])).withColumn("cell_x", cell_of(F.col("x"), grid[1], size[1]))


def gate_components(labels: DataFrame, exclusion: DataFrame, keys: Sequence[str], grid: tuple[int, int], size: tuple[int, int], share: float = SHARE) -> DataFrame:
    """Per component: pixels inside the exclusion and whether the component is removed (keys start with image_id).

    ``exclusion`` is a :func:`gating_mask`, which leaves out the images on which gating abstains.
    """
    rows = _at_cells(labels, grid, size).join(exclusion.withColumn("_e", F.lit(1)), ["image_id", "cell_y", "cell_x"], "left")
    out = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("area"), F.count("_e").alias("inside"))
    return out.withColumn("removed", F.col("inside") >= share * F.col("area"))


def gate_summary(gated: DataFrame, keys: Sequence[str]) -> DataFrame:
    return gated.groupBy(*keys).agg(F.count_if("removed").alias("removed"), F.count_if(~F.col("removed")).alias("kept"),
                                    F.sum(F.when(F.col("removed"), F.col("area")).otherwise(0)).alias("removed_px"))


def clip_by_context(mask: DataFrame, exclusion: DataFrame, keys: Sequence[str], grid: tuple[int, int], size: tuple[int, int], include_cracks: bool = False) -> DataFrame:
    """Remove the interior of excluded cells (eroded by about 1.5 cells) from a mask, then open it 3x3 where it was cut.

    Cracks (by ``damage_class``, where the mask has it) are cut only with ``include_cracks`` and never opened.
    ``exclusion`` is a :func:`gating_mask`.
    """
    height, width = size
    sh, sw = height / grid[0], width / grid[1]
    full = exclusion.select("image_id", F.explode(F.sequence(F.ceil(F.col("cell_y") * sh - 0.5).cast("long"), F.ceil((F.col("cell_y") + 1) * sh - 0.5).cast("long") - 1)).alias("y"), "cell_x")
    full = full.select("image_id", "y", F.explode(F.sequence(F.ceil(F.col("cell_x") * sw - 0.5).cast("long"), F.ceil((F.col("cell_x") + 1) * sw - 0.5).cast("long") - 1)).alias("x"))
    r = -int(-1.5 * max(sh, sw) // 1)
    core = C.erode(full, ["image_id"], height, width, r)
    crack = F.coalesce(F.col("damage_class") == "cracks", F.lit(False)) if "damage_class" in keys else F.lit(False)
    whole = mask.where(crack & F.lit(not include_cracks)).select(*keys, "y", "x")
    area = mask.where(~crack | F.lit(include_cracks)).select(*keys, "y", "x")
    kept = area.join(core, ["image_id", "y", "x"], "left_anti").select(*keys, "y", "x")
    cut = area.where(~crack).join(core, ["image_id", "y", "x"], "left_semi").select(*keys).distinct()
    opened = C.opening(kept.join(cut, list(keys), "left_semi").select(*keys, "y", "x"), keys, height, width)
    return whole.unionByName(kept.join(cut, list(keys), "left_anti").select(*keys, "y", "x")).unionByName(opened.select(*keys, "y", "x"))


def scene_of(labels: DataFrame, cells: DataFrame, keys: Sequence[str], grid: tuple[int, int], size: tuple[int, int], mode: str = "conservative") -> DataFrame:
    """Dominant scene class under each component with its share and the excluded share."""
    rows = _at_cells(labels, grid, size).join(cells.withColumn("_x", excluded(mode).cast("int")), ["image_id", "cell_y", "cell_x"])
    per = rows.groupBy(*keys, rows["label_id"], "class_id", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("_x").alias("x"))
    best = F.min_by("label", F.struct(-F.col("k"), F.col("class_id")))
    return per.groupBy(*keys, "label_id").agg(best.alias("scene"), (F.max("k") / F.sum("k")).alias("share"), (F.sum("x") / F.sum("k")).alias("irrelevant_share"))


def scene_objects(cells: DataFrame, grid: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Connected regions of one class in the scene map, the largest few per class and image."""
    sy, sx = size[0] / grid[0], size[1] / grid[1]
    named = cells.select("image_id", "class_id", "label", "scene_group").distinct()
    lab = C.label_components(cells.select("image_id", "class_id", F.col("cell_y").alias("y"), F.col("cell_x").alias("x")), ["image_id", "class_id"], conn=4)
    total = cells.groupBy("image_id").agg(F.count(F.lit(1)).alias("cells"))
    obj = lab.groupBy("image_id", "class_id", F.col("label").alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    obj = obj.join(total, "image_id").withColumn("share", F.col("n") / F.col("cells")).where(F.col("share") >= MIN_OBJECT_SHARE)
    order = [F.col("share").desc(), F.col("region")]
    obj = obj.withColumn("_c", F.row_number().over(Window.partitionBy("image_id", "class_id").orderBy(*order))).where(F.col("_c") <= MAX_PER_CLASS)
    obj = obj.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(*order, "class_id")).cast("long")).where(F.col("rank") <= MAX_OBJECTS)
    return obj.join(named, ["image_id", "class_id"]).select(
        "image_id", "class_id", "label", "scene_group", "rank", "share", ((F.col("cx") + 0.5) * sx).alias("center_x"), ((F.col("cy") + 0.5) * sy).alias("center_y"),
        (F.col("x0") * sx).alias("bbox_x"), (F.col("y0") * sy).alias("bbox_y"), ((F.col("x1") - F.col("x0") + 1) * sx).alias("bbox_w"), ((F.col("y1") - F.col("y0") + 1) * sy).alias("bbox_h"))


def discarded_records(before: DataFrame, after: DataFrame, keys: Sequence[str], code_key: str = "image_id") -> DataFrame:
    """Components of what gating removed, coded by descending area per image."""
    gone = before.select(*keys, "y", "x").join(after.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    boxes = C.component_boxes(C.label_components(gone, keys), keys)
    order = Window.partitionBy(code_key).orderBy(F.col("area").desc(), *keys, "label")
    return boxes.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("code", F.concat(F.lit("IA"), F.col("rank").cast("string")))
