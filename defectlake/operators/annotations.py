"""Annotation datasets: rasterising, label maps, COCO rows, tiles and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounding_box, half_up
from ..functions.taxonomy import literal_map
from . import raster
from .evaluation import seg_metrics
from .ordered import ordered_positions
from .spans import union_pixels

# Annotation classes with level and label index, paint order, COCO categories of detector records.
CLASSES = {"structure": ("cena", 1), "irrelevant": ("cena", 2), "spalling_dark": ("regiao", 3), "exposed_rebar": ("regiao", 4), "corrosion_rust": ("regiao", 5),
           "efflorescence_white": ("regiao", 6), "cracks": ("detalhe", 7)}
PAINT_ORDER = ["structure", "irrelevant", "spalling_dark", "efflorescence_white", "corrosion_rust", "exposed_rebar", "cracks"]
COCO_CATEGORY = {"cracks": 1, "spalling_dark": 2, "exposed_rebar": 3, "corrosion_rust": 4, "efflorescence_white": 5, "growth": 6, "reduction": 7}
COCO_NAMES = {1: "crack", 2: "spalling", 3: "exposed_rebar", 4: "corrosion", 5: "efflorescence", 6: "temporal_growth", 7: "temporal_reduction"}


def usable_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.where(~F.coalesce("status", F.lit("manual")).isin("suggested", "rejected"))


def shapes_of(vertices: DataFrame, keys: Sequence[str], x: str = "px", y: str = "py", order: str = "seq") -> DataFrame:
    """Vertex rows to one row per shape with ordered ``points``."""
    packed = vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("_p"))
    return packed.select(*keys, F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def polygon_lines(shapes: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Even-odd fill at pixel centres: for each shape and scanline ``y`` the filled columns ``xs``.

    A shape crosses a scanline by its own edges alone, so nothing is shuffled: crossings are sorted within the row and pair up to spans.
    """
    before = F.concat(F.slice("points", -1, 1), F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))))
    ring = F.zip_with("points", before, lambda p, q: F.struct(p["x"].alias("xi"), p["y"].alias("yi"), q["x"].alias("xj"), q["y"].alias("yj")))
    low = F.greatest(F.lit(0), F.ceil(F.array_min(F.col("points.y")) - 0.5)).cast("long")
    high = F.least(F.lit(height - 1), F.ceil(F.array_max(F.col("points.y")) - 0.5) - 1).cast("long")
    rows = shapes.where(F.size("points") >= 3).select(*keys, ring.alias("_ring"), low.alias("_lo"), high.alias("_hi")).where("_hi >= _lo")
    rows = rows.withColumn("y", F.explode(F.sequence("_lo", "_hi")))
    mid = F.col("y") + 0.5
    crossed = F.filter("_ring", lambda e: (F.least(e["yi"], e["yj"]) <= mid) & (F.greatest(e["yi"], e["yj"]) > mid))
    rows = rows.withColumn("c", F.sort_array(F.transform(crossed, lambda e: e["xi"] + (mid - e["yi"]) * (e["xj"] - e["xi"]) / (e["yj"] - e["yi"]))))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda k: F.struct(
        F.greatest(F.lit(0), F.ceil(F.get("c", 2 * k) - 0.5)).cast("long").alias("a"), F.least(F.lit(width - 1), F.floor(F.get("c", 2 * k + 1) - 0.5)).cast("long").alias("b")))
    rows = rows.where(F.size("c") >= 2).select(*keys, "y", F.filter(spans, lambda s: s["b"] >= s["a"]).alias("s"))
    filled = F.transform("s", lambda s: F.sequence(s["a"], s["b"]))
    xs = F.when(F.size("s") == 1, F.sequence(F.get("s", F.lit(0))["a"], F.get("s", F.lit(0))["b"])).otherwise(F.array_distinct(F.flatten(filled)))
    return rows.where(F.size("s") > 0).select(*keys, "y", xs.alias("xs"))


def rasterize_polygons(shapes: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Pixels of every polygon, each once for a row of ``shapes``."""
    return polygon_lines(shapes, keys, height, width).select(*keys, "y", F.explode("xs").alias("x"))


def rasterize_strokes(shapes: DataFrame, keys: Sequence[str], height: int, width: int, stroke: Column) -> DataFrame:
    """Discs of half the stroke width stamped along each polyline."""
    keys = list(keys)
    r = F.greatest(F.lit(0.5), stroke / 2)
    rows = shapes.where(F.size("points") >= 1).withColumn("_r", r).withColumn("_step", F.greatest(F.lit(0.35), r / 2))
    ends = F.when(F.size("points") == 1, F.col("points")).otherwise(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(1))))
    seg = F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(1))), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.select(*keys, "_r", "_step", F.explode(seg).alias("s")).select(*keys, "_r", "_step", *[F.col(f"s.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / F.col("_step")))
    rows = rows.withColumn("_n", n.cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    t = F.col("_k") / F.col("_n")
    rows = rows.select(*keys, "_r", (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("cx"), (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("cy"))
    for axis, size in (("y", height), ("x", width)):
        low = F.greatest(F.lit(0), F.floor(F.col(f"c{axis}") - F.col("_r"))).cast("long")
        high = F.least(F.lit(size - 1), F.ceil(F.col(f"c{axis}") + F.col("_r"))).cast("long")
        rows = rows.withColumn("_lo", low).withColumn("_hi", high).where("_hi >= _lo").withColumn(axis, F.explode(F.sequence("_lo", "_hi")))
    dx, dy = F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy")
    return rows.where(dx * dx + dy * dy <= F.col("_r") * F.col("_r")).select(*keys, "y", "x").distinct()


def rasterize(shapes: DataFrame, keys: Sequence[str], height: int, width: int, is_polygon: Column, stroke: Column, union: bool = False) -> DataFrame:
    """Pixels of filled polygons and drawn polylines; with ``union`` each once for a key, however many shapes have that."""
    if union:
        return union_pixels(shapes, keys, height, width, is_polygon, stroke)
    return rasterize_polygons(shapes.where(is_polygon), keys, height, width).unionByName(rasterize_strokes(shapes.where(~is_polygon), keys, height, width, stroke))


def label_map(pixels: DataFrame) -> DataFrame:
    """Class index of the topmost class per pixel."""
    rank = F.array_position(F.array(*[F.lit(c) for c in PAINT_ORDER]), F.col("cls"))
    index = F.element_at(literal_map({k: v[1] for k, v in CLASSES.items()}), F.col("cls"))
    return pixels.groupBy("image_id", "y", "x").agg(F.max_by(index, rank).cast("long").alias("label"))


def coco_rows(shapes: DataFrame, height: int, width: int, is_polygon: Column, stroke: Column) -> DataFrame:
    """Annotation rows: category, raster area, padded box to two digits, flat polygon or run lengths, and the drawn shape."""
    keys = ["image_id", "ann_id"]
    lines = polygon_lines(shapes.where(is_polygon), keys, height, width)
    strokes = rasterize_strokes(shapes.where(~is_polygon), keys, height, width, stroke)
    area = lines.select(*keys, F.size("xs").alias("n")).unionByName(strokes.select(*keys, F.lit(1).alias("n"))).groupBy(*keys).agg(F.sum("n").alias("area"))
    rle = raster.rle(strokes, keys, height, width)
    pad = F.when(is_polygon, 0.0).otherwise(F.greatest(F.lit(1.0), stroke) / 2)
    flat = F.when(is_polygon, F.flatten(F.transform("points", lambda p: F.array(F.round(p["x"], 2), F.round(p["y"], 2)))))
    rows = shapes.join(area, keys).join(rle, keys, "left")
    category = F.element_at(literal_map({k: v[1] for k, v in CLASSES.items()}), F.col("cls"))
    level = F.element_at(literal_map({k: v[0] for k, v in CLASSES.items()}), F.col("cls"))
    box = bounding_box(F.col("points"), pad)
    line = F.when(~is_polygon, F.transform("points", lambda p: F.array(F.round(p["x"], 2), F.round(p["y"], 2))))
    shape = F.struct(F.when(is_polygon, "polygon").otherwise("polyline").alias("shape"), level.alias("level"), F.when(~is_polygon, F.round(stroke, 2)).alias("width_px"), line.alias("polyline"))
    return rows.select("ann_id", "image_id", category.cast("long").alias("category_id"), F.lit(0).alias("iscrowd"), "area", F.struct(*[F.round(box[k], 2).alias(k) for k in "xywh"]).alias("bbox"),
                       flat.alias("segmentation"), "counts", shape.alias("shm"))


def tile_windows(images: DataFrame, scales: Sequence[int] = (1, 2, 4), side: int = 512) -> DataFrame:
    """Grid windows of every image (``image_id, w, h``) per scale with their output size."""
    rows = images.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    rows = rows.withColumn("tw", F.ceil(F.col("w") / F.col("scale")).cast("long")).withColumn("th", F.ceil(F.col("h") / F.col("scale")).cast("long"))
    for k in "ij":
        rows = rows.withColumn(k, F.explode(F.sequence(F.lit(0), F.col("scale") - 1)))
    rows = rows.withColumn("x0", F.col("i") * F.col("tw")).withColumn("y0", F.col("j") * F.col("th"))
    rows = rows.withColumn("ww", F.least("tw", F.col("w") - F.col("x0"))).withColumn("hh", F.least("th", F.col("h") - F.col("y0"))).where("ww > 0 AND hh > 0")
    k = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest("ww", "hh"))
    return rows.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("scale", "i", "j", "x0", "y0", "ww", "hh")],
                       F.greatest(F.lit(1), half_up(F.col("ww") * k)).cast("long").alias("out_w"), F.greatest(F.lit(1), half_up(F.col("hh") * k)).cast("long").alias("out_h"))


def crop_tiles(labels: DataFrame, images: DataFrame, scales: Sequence[int] = (1, 2, 4), side: int = 512) -> DataFrame:
    """Nearest-neighbour tile pixels of a sparse label map; the window of a pixel follows from its position, per scale."""
    windows = tile_windows(images, scales, side)
    rows = labels.join(images, "image_id").withColumn("scale", F.explode(F.array(*[F.lit(s).cast("long") for s in scales])))
    for k, a, n in (("i", "x", "w"), ("j", "y", "h")):
        rows = rows.withColumn(k, F.floor(F.col(a) / F.ceil(F.col(n) / F.col("scale"))).cast("long"))
    rows = rows.drop("w", "h").join(windows, ["image_id", "scale", "i", "j"])
    for a, o, n, m in (("y", "y0", "hh", "out_h"), ("x", "x0", "ww", "out_w")):
        off = F.col(a) - F.col(o)
        low = F.greatest(F.lit(0), F.ceil(off * F.col(m) / F.col(n) - 0.5)).cast("long")
        high = F.least(F.col(m) - 1, F.ceil((off + 1) * F.col(m) / F.col(n) - 0.5) - 1).cast("long")
        rows = rows.withColumn("_lo", low).withColumn("_hi", high).where("_hi >= _lo").withColumn(f"out_{a}", F.explode(F.sequence("_lo", "_hi")))
    return rows.select("image_id", "scale", "i", "j", "out_y", "out_x", "label")


def tile_index(windows: DataFrame, tiles: DataFrame) -> DataFrame:
    """Windows to export: all whole images and every smaller window with a label in it."""
    seen = tiles.groupBy("image_id", "scale", "i", "j").agg(F.count(F.lit(1)).alias("labelled_px"))
    out = windows.join(seen, ["image_id", "scale", "i", "j"], "left").withColumn("labelled_px", F.coalesce("labelled_px", F.lit(0)).cast("long"))
    return out.where((F.col("scale") == 1) | (F.col("labelled_px") > 0))


def suggestions(records: DataFrame, scale: float = 1.0) -> DataFrame:
    """Detector records as suggested annotations in preview coordinates."""
    crack = (F.col("damage_class") == "cracks") | ~F.col("closed")
    rows = records.where(F.col("damage_class").isin(list(CLASSES)) & (F.size("points") > 0))
    pts = F.transform("points", lambda p: F.struct(F.round(p["x"] * scale, 2).alias("x"), F.round(p["y"] * scale, 2).alias("y")))
    level = F.element_at(literal_map({k: v[0] for k, v in CLASSES.items()}), F.col("damage_class"))
    return rows.select(F.concat(F.lit("cdm-"), "record_id").alias("ann_id"), F.col("damage_class").alias("cls"), level.alias("level"), F.when(crack, "crack").otherwise("polygon").alias("shape"), pts.alias("points"),
                       F.when(crack, F.greatest(F.lit(1.0), F.round(F.coalesce(F.nullif("width_px", F.lit(0.0)), F.lit(2.0)) * scale, 2))).alias("width"), F.lit("suggested").alias("status"), F.lit("cdm").alias("source"))


def evaluate_against_gt(gt_pixels: DataFrame, predicted_pixels: DataFrame) -> DataFrame:
    """Metrics per image and class for the non-scene classes that are annotated; a pixel may be given several times."""
    damage = [c for c, (level, _) in CLASSES.items() if level != "cena"]
    gt = gt_pixels.where(F.col("cls").isin(damage))
    # An annotated class has a pixel that is found or missed, so the annotations are drawn only once.
    return seg_metrics(gt, predicted_pixels, ["image_id", "cls"]).where(F.col("tp") + F.col("fn") > 0)


def pair_files(listing: DataFrame) -> DataFrame:
    """Image and mask paths of one scenario paired by file stem (``<scenario>/img/<stem>.<ext>`` and ``/gt/``)."""
    part = lambda i: F.regexp_extract("path", r"^([^/]+)/(img|gt)/([^/]+)\.(?i:png|jpg|jpeg)$", i)
    rows = listing.select(part(1).alias("scenario"), part(2).alias("kind"), part(3).alias("stem"), "path").where("stem <> ''")
    masks = rows.where("kind = 'gt'").groupBy("scenario", "stem").agg(F.max("path").alias("mask"))
    return rows.where("kind = 'img'").select("scenario", "stem", F.col("path").alias("image")).join(masks, ["scenario", "stem"])


def spread_sample(pairs: DataFrame, per: int, chunk: Column | None = None) -> DataFrame:
    """``per`` evenly spaced pairs of each scenario in path order (all of them when there are fewer)."""
    rows = ordered_positions(pairs, ["scenario"], ["image"], F.substring("image", 1, 12) if chunk is None else chunk)
    n = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("_n"))
    picks = n.select("scenario", "_n", F.explode(F.sequence(F.lit(0), F.lit(max(per, 1) - 1))).alias("_i"))
    at = F.when(F.lit(per) > 1, F.floor(F.col("_i") * (F.col("_n") - 1) / F.lit(float(max(per - 1, 1))))).otherwise(0)
    picks = picks.where(F.col("_n") > per).select("scenario", (at + 1).cast("long").alias("pos")).distinct()
    small = rows.join(n.where(F.col("_n") <= per).select("scenario"), "scenario", "left_semi")
    return rows.join(picks, ["scenario", "pos"], "left_semi").unionByName(small).drop("pos")


def hash_split(key: Column) -> Column:
    """Stable 70 / 15 / 15 split from the SHA-256 of the key."""
    bucket = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 70, "train").when(bucket < 85, "val").otherwise("test")


def augment_index(pixels: DataFrame, height: int, width: int, value: str = "g") -> DataFrame:
    """Deterministic variants of every image as pixel rows (crops, shifts, turns, flips and tone changes).

    Each pixel lists its own image in all variants, so the table is read once and nothing is joined.
    """
    v, x, y = F.col(value).cast("double"), F.col("x"), F.col("y")
    cw, ch = round(width * 0.7), round(height * 0.7)

    def crop(x0: int, y0: int, w: int, h: int):
        return (x >= x0) & (x < x0 + w) & (y >= y0) & (y < y0 + h), y - y0, x - x0, v

    yes = F.lit(True)
    moves = {"original": (yes, y, x, v), "recorte_se": crop(0, 0, cw, ch), "recorte_sd": crop(width - cw, 0, cw, ch), "recorte_ie": crop(0, height - ch, cw, ch), "recorte_id": crop(width - cw, height - ch, cw, ch),
             "fase_7_5": crop(7, 5, width - 7, height - 5), "rot_90": (yes, x, height - 1 - y, v), "rot_180": (yes, height - 1 - y, width - 1 - x, v), "rot_270": (yes, width - 1 - x, y, v),
             "espelho_h": (yes, y, width - 1 - x, v), "espelho_v": (yes, height - 1 - y, x, v), "brilho_p15": (yes, y, x, v + 15), "brilho_m15": (yes, y, x, v - 15),
             "contraste_115": (yes, y, x, (v - 128) * 1.15 + 128), "contraste_085": (yes, y, x, (v - 128) * 0.85 + 128), "gama_08": (yes, y, x, 255 * F.pow(v / 255, F.lit(0.8))), "gama_125": (yes, y, x, 255 * F.pow(v / 255, F.lit(1.25)))}
    made = F.array(*[F.struct(F.lit(n).alias("variant"), ok.alias("ok"), ny.cast("long").alias("ny"), nx.cast("long").alias("nx"), F.least(F.lit(255), F.greatest(F.lit(0), half_up(nv))).cast("long").alias("nv"))
                     for n, (ok, ny, nx, nv) in moves.items()])
    rows = pixels.select("image_id", F.inline(F.filter(made, lambda m: m["ok"])))
    return rows.select("image_id", "variant", F.col("ny").alias("y"), F.col("nx").alias("x"), F.col("nv").alias(value))

