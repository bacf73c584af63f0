"""Point clouds: summaries, local geometry, camera projection and multi-view fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import clamp, half_up, record_contains
from ..functions.taxonomy import literal_map
from ..session import broadcast_if_small, checkpoint, measured, stored
from .selection import select_pairs
from .spatial import cell_range, nearest_places, nearest_within, places

# ASPRS class names and environment limits.
ASPRS = {0: "created_never_classified", 1: "unclassified", 2: "ground", 3: "low_vegetation", 4: "medium_vegetation", 5: "high_vegetation",
         6: "building", 7: "low_point_noise", 9: "water", 10: "rail", 11: "road_surface", 13: "wire_guard", 17: "bridge_deck"}
VEGETATION_TAG, VEGETATION_HIGH, WATER_FLAG, BUILDING_TAG = 0.15, 0.4, 0.02, 0.05
GEOMETRY_CLASSES = ["low_support", "linear_edge", "planar_surface", "irregular_volume", "transitional"]
# Order in which damage classes claim a point.
PRIORITY = ["exposed_rebar", "corrosion_rust", "cracks", "spalling_dark", "efflorescence_white"]
STRUCTURAL = ["IFCBRIDGE", "IFCBRIDGEPART", "IFCSLAB", "IFCBEAM", "IFCCOLUMN", "IFCMEMBER", "IFCPLATE", "IFCWALL", "IFCFOOTING", "IFCPILE"]


def class_name(code: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(ASPRS), code.cast("int")), F.concat(F.lit("code_"), code.cast("string")))


def class_summary(points: DataFrame) -> DataFrame:
    """Count and fraction of every point class per cloud, with extent and channel presence of the class."""
    parts = points.groupBy("cloud_id", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("intensity") > 0).alias("has_intensity"),
        *[F.min(a).alias(f"min_{a}") for a in "xyz"], *[F.max(a).alias(f"max_{a}") for a in "xyz"])
    totals = parts.groupBy("cloud_id").agg(F.sum("n").alias("total"))
    return parts.join(totals, "cloud_id").withColumn("class_name", class_name(F.col("cls"))).withColumn("fraction", F.col("n") / F.greatest("total", F.lit(1)))


def environment_tags(summary: DataFrame) -> DataFrame:
    """Environment tags per cloud from its class fractions."""
    share = lambda *names: F.coalesce(F.sum(F.when(F.col("class_name").isin(*names), F.col("fraction"))), F.lit(0.0))
    s = summary.groupBy("cloud_id").agg(share("low_vegetation", "medium_vegetation", "high_vegetation").alias("vegetation_fraction"),
                                        share("water").alias("water_fraction"), share("building").alias("_building"))
    veg, water = F.col("vegetation_fraction"), F.col("water_fraction")
    tags = F.array_compact(F.array(F.when(veg >= VEGETATION_TAG, F.when(veg >= VEGETATION_HIGH, "vegetation_high").otherwise("vegetation_low")),
                                   F.when(water > 0, "water_proximity"), F.when(F.col("_building") > BUILDING_TAG, "built_environment_nearby")))
    return s.select("cloud_id", tags.alias("environment_tags"), (water >= WATER_FLAG).alias("flood_risk_flag"), "vegetation_fraction", "water_fraction")


def cloud_bounds(points: DataFrame) -> DataFrame:
    b = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"min_{a}") for a in "xyz"], *[F.max(a).alias(f"max_{a}") for a in "xyz"])
    for a in "xyz":
        b = b.withColumn(f"center_{a}", (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2)
    return b


def recenter(points: DataFrame) -> DataFrame:
    """Points relative to the centre of their cloud's bounds."""
    joined = points.join(measured(cloud_bounds(points).select("cloud_id", *[f"center_{a}" for a in "xyz"])), "cloud_id")
    for a in "xyz":
        joined = joined.withColumn(a, F.col(a) - F.col(f"center_{a}"))
    return joined.drop(*[f"center_{a}" for a in "xyz"])


def normalize_rgb(points: DataFrame, key: str) -> DataFrame:
    """Scale colours to [0, 1] by the observed value range of each source (1, 255 or 65535)."""
    top = points.groupBy(key).agg(F.max(F.greatest("r", "g", "b")).alias("_top"))
    divisor = F.when(F.col("_top") <= 1, 1.0).when(F.col("_top") <= 255, 255.0).otherwise(65535.0)
    rows = points.join(measured(top), key)
    for c in "rgb":
        rows = rows.withColumn(c, F.when(F.col("_top") > 0, clamp(F.col(c) / divisor, 0, 1)))
    return rows.drop("_top")


def voxel_size(points: DataFrame, per_voxel: int = 12) -> DataFrame:
    b = cloud_bounds(points)
    diagonal = F.sqrt(sum((F.col(f"max_{a}") - F.col(f"min_{a}")) * (F.col(f"max_{a}") - F.col(f"min_{a}")) for a in "xyz"))
    bins = F.greatest(F.lit(8), F.least(F.lit(72), half_up(F.cbrt(F.greatest(F.lit(1.0), F.col("n") / F.lit(float(per_voxel)))) * 2.6)))
    return b.select("cloud_id", "n", "min_x", "min_y", "min_z", diagonal.alias("diagonal"), bins.cast("long").alias("bins")) \
        .withColumn("voxel", F.greatest(F.col("diagonal") / F.col("bins"), F.lit(1e-9)))


MOMENTS = ["n", "sx", "sy", "sz", "sxx", "syy", "szz", "sxy", "sxz", "syz"]


def voxel_moments(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Count, sums and second-order sums per occupied voxel, of coordinates from the corner of the cloud.

    Map coordinates are large against the size of a voxel; their squares would cancel.
    """
    rows = points.join(sizes.select("cloud_id", "min_x", "min_y", "min_z", "voxel"), "cloud_id")
    cell = [F.floor((F.col(a) - F.col(f"min_{a}")) / F.col("voxel")).cast("long").alias(f"i{a}") for a in "xyz"]
    p = {a: F.col(a) - F.col(f"min_{a}") for a in "xyz"}
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(p[a]).alias(f"s{a}") for a in "xyz"],
            *[F.sum(p[a] * p[b]).alias(f"s{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]]
    return rows.groupBy("cloud_id", *cell).agg(*sums)


def neighborhood_moments(voxels: DataFrame) -> DataFrame:
    """Sums over the 27 surrounding voxels of every occupied voxel, plus the voxel's own count ``own``."""
    out = voxels
    for a in "xyz":
        out = out.withColumn(f"_d{a}", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    spread = out.select("cloud_id", *[(F.col(f"i{a}") + F.col(f"_d{a}")).alias(f"i{a}") for a in "xyz"], *MOMENTS,
                        F.when((F.col("_dx") == 0) & (F.col("_dy") == 0) & (F.col("_dz") == 0), F.col("n")).alias("own"))
    return spread.groupBy("cloud_id", "ix", "iy", "iz").agg(*[F.sum(m).alias(m) for m in MOMENTS], F.max("own").alias("own")).where(F.col("own").isNotNull())


def geometry_class(moments: DataFrame, minimum: int = 6) -> DataFrame:
    """Local shape class and surface normal from the covariance of each neighbourhood (closed-form eigenvalues)."""
    c = F.col
    m = moments
    for a in "xyz":
        m = m.withColumn(f"_m{a}", c(f"s{a}") / c("n"))
    for a, b in ("xx", "yy", "zz"):
        m = m.withColumn(f"_c{a}{b}", F.greatest(F.lit(0.0), c(f"s{a}{b}") / c("n") - c(f"_m{a}") * c(f"_m{b}")))
    for a, b in ("xy", "xz", "yz"):
        m = m.withColumn(f"_c{a}{b}", c(f"s{a}{b}") / c("n") - c(f"_m{a}") * c(f"_m{b}"))
    xx, yy, zz, xy, xz, yz = (c(f"_c{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz"))
    m = m.withColumn("_p1", xy * xy + xz * xz + yz * yz).withColumn("_q", (xx + yy + zz) / 3)
    q = c("_q")
    m = m.withColumn("_p", F.sqrt(F.greatest(F.lit(0.0), ((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * c("_p1")) / 6)))
    p = F.nullif("_p", F.lit(0.0))
    a_, d_, f_, b_, c_, e_ = (xx - q) / p, (yy - q) / p, (zz - q) / p, xy / p, xz / p, yz / p
    det = a_ * d_ * f_ + 2 * b_ * c_ * e_ - a_ * e_ * e_ - d_ * c_ * c_ - f_ * b_ * b_
    m = m.withColumn("_phi", F.acos(clamp(det / 2, -1, 1)) / 3)
    m = m.withColumn("_l1", q + 2 * c("_p") * F.cos("_phi")).withColumn("_l3", q + 2 * c("_p") * F.cos(c("_phi") + 2 * np.pi / 3))
    general = F.array(c("_l1"), 3 * q - c("_l1") - c("_l3"), c("_l3"))
    eig = F.when(c("_p1") <= 1e-24, F.array(xx, yy, zz)).when(c("_p") <= 1e-12, F.array(q, q, q)).otherwise(general)
    m = m.withColumn("_e", F.transform(F.reverse(F.array_sort(eig)), lambda v: F.greatest(F.lit(0.0), v)))
    l1, l2, l3 = c("_e")[0], c("_e")[1], c("_e")[2]
    m = m.withColumn("linearity", (l1 - l2) / F.nullif(l1, F.lit(0.0))).withColumn("planarity", (l2 - l3) / F.nullif(l1, F.lit(0.0))).withColumn("scattering", l3 / F.nullif(l1, F.lit(0.0)))
    cls = (F.when((c("n") < minimum) | (l1 <= 1e-14), 0).when(c("scattering") >= 0.16, 3).when((c("linearity") >= 0.58) & (c("planarity") < 0.36), 1)
           .when((c("planarity") >= 0.38) & (c("scattering") <= 0.12), 2).otherwise(4))
    rows = ([xx - l3, xy, xz], [xy, yy - l3, yz], [xz, yz, zz - l3])
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    best = F.array_max(F.array(*[F.struct(F.sqrt(k[0] * k[0] + k[1] * k[1] + k[2] * k[2]).alias("norm"), k[0].alias("x"), k[1].alias("y"), k[2].alias("z"))
                                 for k in (cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2]))]))
    m = m.withColumn("class_id", cls.cast("long")).withColumn("_n", best)
    flat = c("_n.norm") <= 1e-12
    for i, a in enumerate("xyz"):
        unit = F.when(flat, F.lit(1.0 if a == "z" else 0.0)).otherwise(c(f"_n.{a}") / F.nullif(c("_n.norm"), F.lit(0.0)))
        m = m.withColumn(f"normal_{a}", F.when(c("class_id") == 0, 0.0).otherwise(unit))
    return m.select("cloud_id", "ix", "iy", "iz", "n", "own", "linearity", "planarity", "scattering", "class_id", "normal_x", "normal_y", "normal_z")


def geometry_voxels(points: DataFrame) -> DataFrame:
    return geometry_class(neighborhood_moments(voxel_moments(points, measured(voxel_size(points)))))


def geometry_summary(points: DataFrame) -> DataFrame:
    """Points and fraction per local shape class and cloud; all five classes are listed."""
    counts = geometry_voxels(points).groupBy("cloud_id", "class_id").agg(F.sum("own").alias("n"))
    totals = counts.groupBy("cloud_id").agg(F.sum("n").alias("total"))
    grid = totals.select("cloud_id", "total", F.posexplode(F.array(*[F.lit(g) for g in GEOMETRY_CLASSES])).alias("class_id", "geometry"))
    grid = grid.withColumn("class_id", F.col("class_id").cast("long"))
    return grid.join(counts, ["cloud_id", "class_id"], "left").select(
        "cloud_id", "geometry", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1))).alias("fraction"))


def project_points(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Pinhole projection with radial and tangential distortion of every point into every view.

    The formula runs in steps over plain columns, one row for each point and view, which Spark compiles; lambdas over the
    packed poses would be interpreted.
    """
    c = F.col
    p = lambda name: F.col(f"_p.{name}")
    rows = _with_poses(points, poses).select(*points.columns, F.explode("_poses").alias("_p"))
    for i, a in enumerate("xyz"):
        rows = rows.withColumn(f"_{a}c", p(f"r{i}0") * c("x") + p(f"r{i}1") * c("y") + p(f"r{i}2") * c("z") + p(f"t{a}"))
    front = F.when(c("_zc") > 1e-9, c("_zc"))
    rows = rows.withColumn("_a", c("_xc") / front).withColumn("_b", c("_yc") / front)
    rows = rows.withColumn("_r2", c("_a") * c("_a") + c("_b") * c("_b"))
    rows = rows.withColumn("_k", 1 + p("k1") * c("_r2") + p("k2") * c("_r2") * c("_r2") + p("k3") * c("_r2") * c("_r2") * c("_r2"))
    a, b, r2, k = c("_a"), c("_b"), c("_r2"), c("_k")
    rows = rows.withColumn("u", p("fx") * (a * k + 2 * p("p1") * a * b + p("p2") * (r2 + 2 * a * a)) + p("cx"))
    rows = rows.withColumn("v", p("fy") * (b * k + p("p1") * (r2 + 2 * b * b) + 2 * p("p2") * a * b) + p("cy"))
    inside = F.coalesce((c("u") >= 0) & (c("u") < p("w")) & (c("v") >= 0) & (c("v") < p("h")), F.lit(False))
    # One array of the results keeps later filters above it: below, each would hold the whole formula, too long to compile.
    out = F.array(F.struct(p("view_id").alias("view_id"), p("w").alias("w"), p("h").alias("h"), c("_zc").alias("depth"), c("u").alias("u"), c("v").alias("v"), inside.alias("in_frame")))
    return rows.select(*points.columns, F.inline(out))


POSE_BATCH, POSE_SALTS = 256, 256


def _with_poses(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Attach the poses of a point's cloud (or all poses, without a common cloud) to the point as packed arrays.

    Poses are packed into arrays of at most 256 photos. The packed rows are counted: up to 400 are broadcast; more are
    copied once per salt, so the points stay spread over all tasks.
    """
    keys = ["cloud_id"] if "cloud_id" in poses.columns and "cloud_id" in points.columns else []
    packed = poses.groupBy(*keys, F.floor(F.col("view_id") / POSE_BATCH).alias("_batch")).agg(F.collect_list(F.struct(*[c for c in poses.columns if c not in keys])).alias("_poses"))
    packed = checkpoint(packed.drop("_batch"))
    small = packed.count() <= 400
    packed = packed.withColumn("_salt", F.lit(0)) if small else packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(POSE_SALTS - 1))))
    salt = F.lit(0) if small else F.pmod(F.hash(*points.columns), F.lit(POSE_SALTS))
    rows = points.withColumn("_salt", salt).join(F.broadcast(packed) if small else packed, [*keys, "_salt"]).drop("_salt")
    return rows.select(*points.columns, "_poses")


def zbuffer_visible(projected: DataFrame) -> DataFrame:
    """Points in frame with the nearest depth of their pixel and whether they are visible within the tolerance."""
    rows = projected.where("in_frame")
    px = F.greatest(F.lit(0), F.least(F.col("w") - 1, half_up(F.col("u"))))
    py = F.greatest(F.lit(0), F.least(F.col("h") - 1, half_up(F.col("v"))))
    rows = stored(rows.withColumn("px", px.cast("long")).withColumn("py", py.cast("long")))  # projected once for the front and the points
    front = rows.groupBy("view_id", "px", "py").agg(F.min("depth").alias("front"))
    rows = rows.join(front, ["view_id", "px", "py"])
    return rows.withColumn("visible", F.col("depth") <= F.col("front") + F.greatest(F.lit(0.005), F.abs("front") * 0.015)).drop("front")


def elevation_color(z: Column, low: Column, high: Column) -> list[Column]:
    t = clamp((z - low) / F.greatest(high - low, F.lit(1e-9)), 0, 1)
    return [0.12 + 0.78 * t, 0.35 + 0.48 * (1 - F.abs(t - 0.5) * 2), 0.82 - 0.62 * t]


def sample_colors(visible: DataFrame, pixels: DataFrame, photo_w: int, photo_h: int, bounds: DataFrame) -> DataFrame:
    """Colour of the photo pixel under every visible point; a dimmed elevation ramp where there is none.

    ``pixels`` has image_id = view_id at ``photo_w`` x ``photo_h``; projections are scaled to that grid.
    """
    px = half_up(F.col("u") * F.lit(float(photo_w)) / F.col("w")).alias("_x")
    py = half_up(F.col("v") * F.lit(float(photo_h)) / F.col("h")).alias("_y")
    photo = pixels.select(F.col("image_id").alias("view_id"), F.col("x").alias("_x"), F.col("y").alias("_y"),
                          *[(F.col(k) / 255.0).alias(f"_{k}") for k in "rgb"])
    rows = visible.select("*", F.when(F.col("visible"), px).alias("_x"), F.when(F.col("visible"), py).alias("_y")).join(photo, ["view_id", "_x", "_y"], "left")
    rows = rows.join(measured(bounds.select("cloud_id", "min_z", "max_z")), "cloud_id")
    ramp = elevation_color(F.col("z"), F.col("min_z"), F.col("max_z"))
    for k, base in zip("rgb", ramp):
        rows = rows.withColumn(k, F.coalesce(f"_{k}", base * 0.45))
    return rows.withColumn("colored", F.col("_r").isNotNull()).drop("_x", "_y", "_r", "_g", "_b", "min_z", "max_z")


def label_points(visible: DataFrame, records: DataFrame, scale_x: float, scale_y: float, cell: float = 32.0) -> DataFrame:
    """First class in priority order whose record covers the point; equal places and equal record shapes are looked at once.

    Classes are asked in order. A place leaves with the first record that covers it, and of the next class only the records in
    cells of places that are still open take part; so a place in a crowded cell meets a few records and not all of them.
    """
    pad = F.when(F.col("closed"), 0.0).otherwise(F.greatest(F.lit(1.5), F.coalesce("width_px", F.lit(1.0)) / 2 + 1))
    places, cells = ["view_id", "_px", "_py"], ["view_id", "_cx", "_cy"]
    points = visible.where("visible").select("view_id", "point_id", (F.col("u") * scale_x).alias("_px"), (F.col("v") * scale_y).alias("_py"))
    points = checkpoint(points)  # read for the places and for the points
    open_places = checkpoint(points.select(*places).distinct().select("*", *[F.floor(F.col(f"_p{a}") / cell).cast("long").alias(f"_c{a}") for a in "xy"]))
    left, parts = open_places.count(), []
    for rank, name in enumerate(PRIORITY):
        if not left:
            break
        shapes = records.where(F.col("damage_class") == name).select("view_id", "points", "closed", "width_px")
        for a in "xy":
            shapes = shapes.withColumn(f"_lo{a}", F.array_min(F.col(f"points.{a}")) - pad).withColumn(f"_hi{a}", F.array_max(F.col(f"points.{a}")) + pad)
            shapes = shapes.withColumn(f"_c{a}", F.explode(cell_range(F.col(f"_lo{a}"), F.col(f"_hi{a}"), cell)))
        wanted = broadcast_if_small(open_places.select(*cells).distinct())
        shapes = shapes.join(wanted, cells, "left_semi").distinct().alias("s").hint("merge")
        reached = (F.col("_px").between(F.col("_lox"), F.col("_hix")) & F.col("_py").between(F.col("_loy"), F.col("_hiy"))
                   & record_contains(F.col("_px"), F.col("_py"), F.col("points"), F.col("closed"), F.col("width_px")))
        same = [F.col(f"o.{c}") == F.col(f"s.{c}") for c in cells]
        hit = checkpoint(open_places.alias("o").join(shapes, [*same, reached], "left_semi"))
        parts.append(hit.select(*places, F.lit(rank).cast("long").alias("class_id")))
        open_places, left = checkpoint(open_places.join(hit.select(*places).hint("merge"), places, "left_anti")), left - hit.count()
    if not parts:
        return points.select("view_id", "point_id", F.lit(None).cast("long").alias("class_id")).limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return points.join(found.hint("merge"), places).select("view_id", "point_id", "class_id")


def fuse_votes(votes: DataFrame, views: int, confirmed: int = 2) -> DataFrame:
    """Weighted vote per point: winning class, its support, confidence and whether enough views confirm it."""
    per_class = votes.groupBy("point_id", "class_id").agg(F.sum(F.greatest(F.lit(0.001), "weight")).alias("weight"), F.count(F.lit(1)).alias("support"))
    best = F.max(F.struct(F.col("weight"), (-F.col("class_id")).alias("c"), F.col("support")))
    fused = per_class.groupBy("point_id").agg(best.alias("b"), F.sum("weight").alias("total"))
    need = min(max(1, confirmed), max(1, views))
    return fused.select("point_id", (-F.col("b.c")).cast("long").alias("class_id"), F.col("b.support").alias("support"),
                        (F.col("b.weight") / F.col("total")).alias("confidence"), (F.col("b.support") >= need).alias("confirmed"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def photometric_stats(pixels: DataFrame, step: int = 1) -> DataFrame:
    """Mean colour, luminance moments, shadow and highlight share and gradient sharpness per photo (0-255 input)."""
    small = pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    rows = small.select("image_id", "y", "x", *[(F.col(k) / 255.0).alias(k) for k in "rgb"])
    rows = rows.withColumn("l", luminance(F.col("r"), F.col("g"), F.col("b")))
    right = rows.select("image_id", "y", (F.col("x") - step).alias("x"), F.col("l").alias("lr"))
    down = rows.select("image_id", (F.col("y") - step).alias("y"), "x", F.col("l").alias("ld"))
    rows = rows.join(right, ["image_id", "y", "x"], "left").join(down, ["image_id", "y", "x"], "left")
    both = F.col("lr").isNotNull() & F.col("ld").isNotNull()
    grad = F.when(both, F.abs(F.col("lr") - F.col("l")) + F.abs(F.col("ld") - F.col("l")))
    return rows.groupBy("image_id").agg(
        *[F.avg(k).alias(f"mean_{k}") for k in "rgb"], F.avg("l").alias("luminance_mean"), F.stddev_pop("l").alias("luminance_std"),
        F.avg((F.col("l") < 0.08).cast("double")).alias("shadow_ratio"), F.avg((F.col("l") > 0.94).cast("double")).alias("highlight_ratio"),
        (F.coalesce(F.sum(grad), F.lit(0.0)) / F.greatest(F.lit(1), 2 * F.count(grad))).alias("sharpness"))


TARGET = ["mean_r", "mean_g", "mean_b", "luminance_mean", "luminance_std"]


def photometric_target(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median photometry of the views of one set (``keys``; a set holds the photos of one fusion)."""
    return stats.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(f"target_{c}") for c in TARGET])


def _or(value: Column, default: float) -> Column:
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, F.lit(default)).otherwise(value)


def normalize_photometric(rows: DataFrame) -> DataFrame:
    """Bring colours (0-1) with their view's statistics and target columns to the common photometry."""
    c = F.col
    gained = {k: clamp(c(k) * clamp(_or(c(f"target_mean_{k}"), 0.5) / F.greatest(F.lit(0.03), _or(c(f"mean_{k}"), 0.5)), 0.65, 1.6), 0, 1) for k in "rgb"}
    for k in "rgb":
        rows = rows.withColumn(f"_g{k}", gained[k])
    rows = rows.withColumn("_y", luminance(c("_gr"), c("_gg"), c("_gb")))
    contrast = clamp(_or(c("target_luminance_std"), 0.22) / F.greatest(F.lit(0.035), _or(c("luminance_std"), 0.18)), 0.72, 1.45)
    yn = F.pow(clamp(_or(c("target_luminance_mean"), 0.5) + (c("_y") - _or(c("luminance_mean"), 0.5)) * contrast, 0, 1), F.lit(0.96))
    rows = rows.withColumn("_s", F.when(c("_y") > 0.015, clamp(yn / F.nullif("_y", F.lit(0.0)), 0.45, 2.2)).otherwise(1.0))
    for k in "rgb":
        rows = rows.withColumn(k, clamp(c(f"_g{k}") * c("_s"), 0, 1))
    return rows.drop("_gr", "_gg", "_gb", "_y", "_s")


def view_weight(rmse: Column, inliers: Column, correspondences: Column, shadow: Column, highlight: Column, sharpness: Column) -> Column:
    ratio = clamp(inliers / F.greatest(F.lit(1), F.greatest(inliers, correspondences)), 0.15, 1)
    exposure = clamp(1 - shadow * 0.7 - highlight * 0.8, 0.2, 1)
    return clamp(ratio / (1 + F.greatest(F.lit(0.0), rmse) / 4) * exposure * clamp(sharpness / 0.08, 0.25, 1.25), 0.03, 1.4)


def incidence_weight(normal: Sequence[Column], point: Sequence[Column], camera: Sequence[Column]) -> Column:
    v = [c - p for c, p in zip(camera, point)]
    nm, vm = F.sqrt(sum(n * n for n in normal)), F.sqrt(sum(k * k for k in v))
    cosine = F.abs(sum(n * k for n, k in zip(normal, v)) / F.nullif(nm * vm, F.lit(0.0)))
    return F.when((nm < 0.5) | (vm <= 1e-9), 1.0).otherwise(F.pow(clamp((cosine - 0.08) / 0.92, 0.08, 1), F.lit(1.35)))


def depth_weight(depth: Column, reference: Column) -> Column:
    ratio = depth / F.nullif(reference, F.lit(0.0))
    return F.when(~((depth > 0) & (reference > 0)), 1.0).otherwise(clamp(1 / (1 + 0.7 * (ratio - 1) * (ratio - 1)), 0.2, 1))


def reference_depth(visible: DataFrame) -> DataFrame:
    """Median visible depth per view on millimetre bins: the bins are counted first, so memory depends on depth range only."""
    bins = visible.where(F.col("visible") & (F.col("depth") > 0)).groupBy("view_id", F.round("depth", 3).alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy("view_id").agg(F.percentile("depth", F.lit(0.5), F.col("n")).alias("reference_depth"))


def fuse_colors(samples: DataFrame) -> DataFrame:
    """Weighted mean colour, weight sum and number of views per point."""
    w = F.col("weight")
    out = samples.groupBy("point_id").agg(F.sum(w).alias("weight"), *[F.sum(F.col(k) * w).alias(f"_{k}") for k in "rgb"], F.count(F.lit(1)).alias("coverage"))
    return out.select("point_id", *[(F.col(f"_{k}") / F.nullif("weight", F.lit(0.0))).alias(k) for k in "rgb"], "weight", "coverage")


# Dimming of points without colour, and the confidence ramp (start and span per channel).
FALLBACK_SHARE = 0.55
CONFIDENCE_RAMP = {"r": (0.12, 0.18, False), "g": (0.18, 0.72, False), "b": (0.30, 0.58, True)}


def fused_points(points: DataFrame, samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """All points with their fused colour, or a dimmed elevation colour where no view sees them, and a confidence colour.

    Confidence is the weight of a point against the largest one, which is the only figure gathered.
    """
    fused = checkpoint(fuse_colors(samples))
    top = fused.agg(F.max("weight")).first()[0] or 0.0
    rows = points.select("point_id", "cloud_id", "z").join(fused, "point_id", "left").join(measured(bounds.select("cloud_id", "min_z", "max_z")), "cloud_id")
    seen, weight = F.coalesce(F.col("weight") > 0, F.lit(False)), F.coalesce("weight", F.lit(0.0))
    share = clamp(weight / F.lit(top), 0, 1) if top > 0 else F.lit(0.0)
    ramp = dict(zip("rgb", elevation_color(F.col("z"), F.col("min_z"), F.col("max_z"))))
    return rows.select("point_id", "cloud_id", *[F.when(seen, F.col(k)).otherwise(ramp[k] * FALLBACK_SHARE).alias(k) for k in "rgb"],
                       *[(F.lit(start) + F.lit(span) * (1 - share if turned else share)).alias(f"confidence_{k}") for k, (start, span, turned) in CONFIDENCE_RAMP.items()],
                       weight.alias("weight"), F.coalesce("coverage", F.lit(0)).alias("coverage"), seen.alias("colored"))


def fusion_views(samples: DataFrame) -> DataFrame:
    """Points that each view colours, its weight, mean incidence weight and reference depth."""
    return samples.groupBy("view_id").agg(F.max("view_weight").alias("weight"), F.count(F.lit(1)).alias("contributed_points"), F.avg("incidence").alias("mean_incidence_weight"), F.max("reference_depth").alias("reference_depth"))


def fusion_summary(fused: DataFrame) -> DataFrame:
    """Coverage of all points; views and weight are means over the coloured ones."""
    seen = F.col("colored")
    mean = lambda c: F.coalesce(F.avg(F.when(seen, F.col(c))), F.lit(0.0))
    return fused.agg(F.count_if(seen).alias("colored_points"), F.count(F.lit(1)).alias("total_points"), (F.count_if(seen) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("coverage_ratio"), mean("coverage").alias("mean_views"), mean("weight").alias("mean_weight"))


def nearest_point(queries: DataFrame, points: DataFrame, keys: Sequence[str], radius: float, query_id: str, point_id: str) -> DataFrame:
    """Exact nearest neighbour by a grid whose cell grows for the queries that found nothing yet.

    Points at equal coordinates take part once (smallest id). Every round resolves all queries with a neighbour within
    the radius; only the rest goes on, with twice the radius. ``radius`` should be about the point spacing: queries far
    outside a cloud need several rounds and meet more candidates.
    """
    found = nearest_within(queries, points, keys, ["x", "y", "z"], point_id, None, radius, 2.0)
    rows = queries.select(*keys, F.col(query_id).alias("query_id"), "x", "y", "z").join(found.hint("merge"), [*keys, "x", "y", "z"])
    return rows.select(*keys, "query_id", "point_id", "distance")


def rigid_transform(points: DataFrame, matrix: Sequence[Sequence[float]], translation: Sequence[float]) -> DataFrame:
    moved = [sum(F.lit(float(matrix[i][j])) * F.col("xyz"[j]) for j in range(3)) + F.lit(float(translation[i])) for i in range(3)]
    return points.select(*[c for c in points.columns if c not in "xyz"], *[m.alias(a) for m, a in zip(moved, "xyz")])


def fit_rigid(pairs: DataFrame, key: str) -> DataFrame:
    """Least-squares rotation and translation per key from paired points (``sx..tz``), with its RMSE.

    Means and covariances are distributed aggregates; only the 3x3 decomposition of each key runs in Python.
    """
    stats = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{s}{a}").alias(f"m{s}{a}") for s in "st" for a in "xyz"],
                                   *[F.covar_pop(f"s{a}", f"t{b}").alias(f"c{a}{b}") for a in "xyz" for b in "xyz"],
                                   *[F.covar_pop(f"{s}{a}", f"{s}{b}").alias(f"{s}{a}{b}") for s in "st" for a in "xyz" for b in "xyz" if a <= b])
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["dx", "dy", "dz"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                cov = np.array([[row[f"c{a}{b}"] for b in "xyz"] for a in "xyz"])
                sym = {s: np.array([[row[f"{s}{min(a, b)}{max(a, b)}"] for b in "xyz"] for a in "xyz"]) for s in "st"}
                flat = any(np.linalg.matrix_rank(m, tol=1e-12 * max(1.0, np.abs(m).max()), hermitian=True) < 2 for m in sym.values())
                if row["n"] < 3 or flat:
                    out.append([row[key], row["n"], "degenerate", *[None] * 12])
                    continue
                u, _, vt = np.linalg.svd(cov)
                d = np.sign(np.linalg.det(vt.T @ u.T))
                rot = vt.T @ np.diag([1.0, 1.0, d]) @ u.T
                move = np.array([row[f"mt{a}"] for a in "xyz"]) - rot @ np.array([row[f"ms{a}"] for a in "xyz"])
                out.append([row[key], row["n"], "ok", *rot.ravel().tolist(), *move.tolist()])
            yield pd.DataFrame(out, columns=[key, "n", "status", *names])

    kind = pairs.schema[key].dataType.simpleString()
    fits = checkpoint(stats.mapInPandas(solve, f"{key} {kind}, n long, status string, " + ", ".join(f"{k} double" for k in names)))
    err = sum((sum(F.col(f"r{i}{j}") * F.col(f"s{'xyz'[j]}") for j in range(3)) + F.col(f"d{'xyz'[i]}") - F.col(f"t{'xyz'[i]}")) ** 2 for i in range(3))
    rmse = pairs.join(measured(fits), key).groupBy(key).agg(F.sqrt(F.avg(err)).alias("rmse"))
    return fits.join(rmse, key, "left")


def icp(source: DataFrame, target: DataFrame, radius: float, max_iterations: int = 50, tolerance: float = 1e-6, max_distance: float | None = None) -> tuple[list[float], list[float], list[float]]:
    """Iterative closest points: returns the 3x3 rotation (row-major), the translation and the RMSE history.

    The driver only sees twelve numbers and one error per round; matching, fitting and moving are Spark jobs. A place keeps its
    neighbour without a search while it has moved too little for any other point to be as near.
    """
    rotation, shift, history, axes = np.eye(3), np.zeros(3), [], ["x", "y", "z"]
    target = stored(places(target, axes).select(*axes, "point_id"))
    n, spots = target.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*axes))).first()
    if spots < n / 2:  # few copies are left out in the tasks
        target = stored(target.groupBy(*axes).agg(F.min("point_id").alias("point_id")))
    # Points at one place share their neighbour and count as often as they are.
    current = places(source, axes).groupBy(*axes).agg(F.count(F.lit(1)).alias("copies"))
    near = nearest_places(stored(current.sortWithinPartitions(*axes)), target, [], axes, None, radius, 2.0, ids=False)
    for _ in range(max_iterations):
        used = near if max_distance is None else near.where(F.col("distance") <= max_distance)
        pairs = used.select(F.lit(1).alias("k"), *[F.col(a).alias(f"s{a}") for a in axes], *[F.col(f"to_{a}").alias(f"t{a}") for a in axes], F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        fit = fit_rigid(pairs, "k").first()
        if fit is None or fit["status"] != "ok":
            raise RuntimeError("fewer than 3 valid correspondences")
        r = np.array([fit[f"r{i}{j}"] for i in range(3) for j in range(3)]).reshape(3, 3)
        d = np.array([fit["dx"], fit["dy"], fit["dz"]])
        rotation, shift = r @ rotation, r @ shift + d
        history.append(float(fit["rmse"]))
        if len(history) > 1 and abs(history[-2] - history[-1]) < tolerance or len(history) == max_iterations:
            break
        near = _matched_again(rigid_transform(near.select("*", *[F.col(a).alias(f"was_{a}") for a in axes]), r.tolist(), d.tolist()), target, radius)
    return rotation.ravel().tolist(), shift.tolist(), history


def _matched_again(moved: DataFrame, target: DataFrame, radius: float) -> DataFrame:
    """Neighbours of moved places: the former one where all others stay farther, whichever way the place went, else by a search."""
    axes = ["x", "y", "z"]
    far = lambda name: F.sqrt(sum((F.col(a) - F.col(f"{name}_{a}")) * (F.col(a) - F.col(f"{name}_{a}")) for a in axes))
    moved = moved.withColumn("distance", far("to")).withColumn("other", F.col("other") - far("was"))
    sure = F.col("distance") < F.col("other") * (1 - 1e-9)
    kept = stored(moved.where(sure).drop(*[f"was_{a}" for a in axes]))
    open_places = stored(moved.where(~sure).select(*axes, "copies"))
    return kept if open_places.isEmpty() else kept.unionByName(nearest_places(open_places, target, [], axes, None, radius, 2.0, ids=False))


def knn_ratio_match(a: DataFrame, b: DataFrame, keys: Sequence[str], ratio: float = 0.76, block: int = 2048) -> DataFrame:
    """Two nearest descriptors of every ``a`` row among the ``b`` rows of the same key, kept if d1 < ratio·d2.

    Both sides are cut into blocks of about ``block`` rows; a task compares one pair of blocks as matrices and returns two
    candidates per row, so no list of all pairs exists and a large key is spread over many tasks.
    """
    keys = list(keys)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).alias("_blocks"))
        rows = df.join(sizes, keys).withColumn("_b", F.pmod(F.hash("vec_id"), F.col("_blocks")))
        return rows.groupBy(*keys, F.col("_b").alias(f"{name}_block")).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.collect_list("embedding").alias(f"{name}_vectors"))

    pairs = blocks(a, "a").join(blocks(b, "b"), keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                va = np.stack(row.a_vectors).astype(np.float64)
                vb = np.stack(row.b_vectors).astype(np.float64)
                # Differences row by row: the same figures whatever the blocks are, and one row's matrix at a time.
                d = np.stack([np.sqrt(((v - vb) ** 2).sum(-1)) for v in va])
                best = np.argsort(d, axis=1, kind="stable")[:, :2]
                ids_b = np.asarray(row.b_ids)
                out = {k: getattr(row, k) for k in keys}
                yield pd.DataFrame({**out, "a_id": np.repeat(np.asarray(row.a_ids), best.shape[1]), "b_id": ids_b[best].ravel(),
                                    "distance": np.take_along_axis(d, best, 1).ravel()})

    schema = T.StructType([*[a.schema[k] for k in keys], T.StructField("a_id", T.LongType()), T.StructField("b_id", T.LongType()), T.StructField("distance", T.DoubleType())])
    near = pairs.mapInPandas(run, schema).groupBy(*keys, "a_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "b_id"))), 1, 2).alias("n"))
    d1, d2 = F.col("n")[0], F.try_element_at("n", F.lit(2))
    return near.where(d1["distance"] < ratio * d2["distance"]).select(*keys, "a_id", d1["b_id"].alias("b_id"), d1["distance"].alias("distance"), d2["distance"].alias("second"))


def associate_matches(matches: DataFrame, projected: DataFrame, radius: float = 10.0, cap: int = 600) -> DataFrame:
    """Give image matches (``view_id, match_id, au, av, tu, tv, distance``) the world point projected nearest to them.

    Acceptance is greedy by score and unique per world point and per 12-pixel target cell, up to ``cap`` per view (the
    operator's own limit); see :mod:`.selection`.
    """
    seen = projected.where(F.col("in_frame")).groupBy("view_id", F.col("u").alias("x"), F.col("v").alias("y")).agg(F.min(F.struct("depth", "point_id")).alias("p"))
    left = matches.select("view_id", "match_id", F.col("au").alias("x"), F.col("av").alias("y"), "tu", "tv", F.col("distance").alias("d"))
    # The search grows from a small radius, so a match in a dense place meets a few points and not all within the radius.
    near = nearest_within(left, seen, ["view_id"], ["x", "y"], "p", radius, radius / 9).where(F.col("distance") < radius)
    best = left.join(near.hint("merge"), ["view_id", "x", "y"]).groupBy("view_id", "match_id").agg(
        F.min(F.struct(F.col("distance"), F.col("point_id.depth").alias("depth"), F.col("point_id.point_id").alias("point_id"))).alias("b"),
        F.first("tu").alias("tu"), F.first("tv").alias("tv"), F.first("d").alias("d"))
    rows = best.select("view_id", "match_id", F.col("b.point_id").alias("point_id"), F.col("b.distance").alias("association_px"), "tu", "tv",
                       (F.col("d") + F.col("b.distance") * 4.0).alias("score"), F.floor(F.col("tu") / 12).cast("long").alias("cell_u"), F.floor(F.col("tv") / 12).cast("long").alias("cell_v"))

    rows = rows.withColumn("_cell", F.struct("cell_u", "cell_v").cast("string"))
    kept = select_pairs(rows, ["view_id"], "point_id", "_cell", [F.col("score"), F.col("match_id")], F.struct(F.floor(F.col("cell_u") / 64).alias("u"), F.floor(F.col("cell_v") / 64).alias("v")).cast("string"))
    # The first kept matches are those that a run which stops at the cap would keep.
    place = Window.partitionBy("view_id").orderBy("score", "match_id")
    kept = kept.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= max(6, cap))
    return kept.drop("_place", "_cell", "cell_u", "cell_v")


def propagation_gate(views: DataFrame, reprojection_px: float = 5.0) -> DataFrame:
    """Accept or reject an automatic pose with the first failing reason."""
    ratio = F.col("inliers") / F.greatest(F.lit(1), F.col("correspondences"))
    reason = (F.when(F.col("correspondences") < 8, "too_few_correspondences").when(F.col("inliers") < 6, "too_few_inliers").when(ratio < 0.35, "low_inlier_ratio")
              .when(F.col("rmse_px").isNull() | F.isnan("rmse_px") | (F.col("rmse_px") > max(8.0, reprojection_px * 1.8)), "high_reprojection_error").otherwise("accepted"))
    return views.withColumn("inlier_ratio", ratio).withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted")


def element_counts(lines: DataFrame) -> DataFrame:
    """Entity type counts of STEP text lines (column ``value``), ranked, with the structural subset flagged."""
    types = lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?i)#\d+\s*=\s*(IFC[A-Z0-9_]+)"), F.lit(1))).alias("t"))
    counts = types.groupBy(F.upper("t").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("structural", F.col("entity").isin(STRUCTURAL))


def top_entities(counts: DataFrame, n: int = 20) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "entity").limit(n)


def step_schema(lines: DataFrame) -> DataFrame:
    name = F.regexp_extract("value", r"(?i)FILE_SCHEMA\s*\(\s*\(\s*['\"]([^'\"]+)", 1)
    return lines.select(F.nullif(name, F.lit("")).alias("schema_name")).where(F.col("schema_name").isNotNull()).distinct()
