"""Registered queries: point clouds and multi-view fusion (G)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import cloud as ops
from ..session import stored
from .base import query

NAMES = "CASE cls " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ops.ASPRS.items()) + " ELSE concat('code_', CAST(cls AS VARCHAR)) END"
SUMMARY = f"""summary AS (SELECT cloud_id, cls, {NAMES} class_name, count(*) n, bool_or(intensity>0) has_intensity, min(x) min_x, max(x) max_x, sum(count(*)) OVER (PARTITION BY cloud_id) total FROM fx_points_anon GROUP BY cloud_id, cls)"""
BOUNDS = "bounds AS (SELECT cloud_id, count(*) n, min(x) min_x, min(y) min_y, min(z) min_z, max(x) max_x, max(y) max_y, max(z) max_z FROM fx_points_anon GROUP BY 1)"
VOXEL = BOUNDS + """,
vs0 AS (SELECT *, sqrt((max_x-min_x)*(max_x-min_x)+(max_y-min_y)*(max_y-min_y)+(max_z-min_z)*(max_z-min_z)) diagonal, CAST(greatest(8, least(72, floor(cbrt(greatest(1, n/12.0::DOUBLE))*2.6+0.5))) AS BIGINT) bins FROM bounds),
vs AS (SELECT *, greatest(diagonal/bins, 1e-9) voxel FROM vs0)"""
CELLS = VOXEL + """,
vm AS (SELECT p.cloud_id, CAST(floor((x-min_x)/voxel) AS BIGINT) ix, CAST(floor((y-min_y)/voxel) AS BIGINT) iy, CAST(floor((z-min_z)/voxel) AS BIGINT) iz, count(*) n, sum(x-min_x) sx, sum(y-min_y) sy, sum(z-min_z) sz, sum((x-min_x)*(x-min_x)) sxx, sum((y-min_y)*(y-min_y)) syy, sum((z-min_z)*(z-min_z)) szz, sum((x-min_x)*(y-min_y)) sxy, sum((x-min_x)*(z-min_z)) sxz, sum((y-min_y)*(z-min_z)) syz FROM fx_points_anon p JOIN vs USING (cloud_id) GROUP BY 1,2,3,4)"""
NEAR = CELLS + """,
nm AS (SELECT a.cloud_id, a.ix, a.iy, a.iz, a.n own, sum(b.n)::BIGINT n, sum(b.sx) sx, sum(b.sy) sy, sum(b.sz) sz, sum(b.sxx) sxx, sum(b.syy) syy, sum(b.szz) szz, sum(b.sxy) sxy, sum(b.sxz) sxz, sum(b.syz) syz
 FROM vm a JOIN vm b ON a.cloud_id=b.cloud_id AND abs(a.ix-b.ix)<=1 AND abs(a.iy-b.iy)<=1 AND abs(a.iz-b.iz)<=1 GROUP BY 1,2,3,4,5)"""
CLASS = NEAR + f""",
cv AS (SELECT *, greatest(0, sxx/n-(sx/n)*(sx/n)) xx, greatest(0, syy/n-(sy/n)*(sy/n)) yy, greatest(0, szz/n-(sz/n)*(sz/n)) zz, sxy/n-(sx/n)*(sy/n) xy, sxz/n-(sx/n)*(sz/n) xz, syz/n-(sy/n)*(sz/n) yz FROM nm),
e0 AS (SELECT *, xy*xy+xz*xz+yz*yz p1, (xx+yy+zz)/3 q FROM cv),
e1 AS (SELECT *, sqrt(greatest(0, ((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*p1)/6)) p FROM e0),
e2 AS (SELECT *, CASE WHEN p>0 THEN acos(greatest(-1, least(1, ((xx-q)/p*((yy-q)/p)*((zz-q)/p) + 2*(xy/p)*(xz/p)*(yz/p) - (xx-q)/p*(yz/p)*(yz/p) - (yy-q)/p*(xz/p)*(xz/p) - (zz-q)/p*(xy/p)*(xy/p))/2)))/3 END phi FROM e1),
e3 AS (SELECT *, q+2*p*cos(phi) g1, q+2*p*cos(phi+2*{math.pi!r}::DOUBLE/3) g3 FROM e2),
e4 AS (SELECT *, list_reverse_sort(list_transform(CASE WHEN p1<=1e-24 THEN [xx,yy,zz] WHEN p<=1e-12 THEN [q,q,q] ELSE [g1, 3*q-g1-g3, g3] END, lambda v: greatest(0, v))) e FROM e3),
gc AS (SELECT *, (e[1]-e[2])/nullif(e[1],0) linearity, (e[2]-e[3])/nullif(e[1],0) planarity, e[3]/nullif(e[1],0) scattering FROM e4),
cls AS (SELECT *, (CASE WHEN n<6 OR e[1]<=1e-14 THEN 0 WHEN scattering>=0.16 THEN 3 WHEN linearity>=0.58 AND planarity<0.36 THEN 1 WHEN planarity>=0.38 AND scattering<=0.12 THEN 2 ELSE 4 END)::BIGINT class_id FROM gc)"""

PROJ = """pj0 AS (SELECT point_id, cloud_id, x, y, z, view_id, w, h, fx, fy, cx, cy, k1, r00*x+r01*y+r02*z+tx xc, r10*x+r11*y+r12*z+ty yc, r20*x+r21*y+r22*z+tz zc FROM fx_points CROSS JOIN fx_poses),
pj1 AS (SELECT *, xc/zc a, yc/zc b FROM pj0), pj2 AS (SELECT *, a*a+b*b r2 FROM pj1),
pj AS (SELECT point_id, cloud_id, x, y, z, view_id, w, h, zc depth, fx*(a*(1+k1*r2))+cx u, fy*(b*(1+k1*r2))+cy v FROM pj2),
fr AS (SELECT *, u>=0 AND u<w AND v>=0 AND v<h in_frame FROM pj),
zb0 AS (SELECT *, CAST(greatest(0, least(w-1, floor(u+0.5))) AS BIGINT) px, CAST(greatest(0, least(h-1, floor(v+0.5))) AS BIGINT) py FROM fr WHERE in_frame),
zb AS (SELECT *, depth <= min(depth) OVER (PARTITION BY view_id, px, py) + greatest(0.005, abs(min(depth) OVER (PARTITION BY view_id, px, py))*0.015) visible FROM zb0)"""
COLORS = PROJ + """,
bz AS (SELECT cloud_id, min(z) min_z, max(z) max_z FROM fx_points GROUP BY 1),
sc AS (SELECT zb.point_id, zb.view_id, zb.cloud_id, zb.visible, zb.depth, c.image_id IS NOT NULL colored, greatest(0, least(1, (zb.z-min_z)/greatest(max_z-min_z, 1e-9))) t, c.r/255 cr, c.g/255 cg, c.b/255 cb
 FROM zb JOIN bz USING (cloud_id) LEFT JOIN fx_rgb c ON zb.visible AND c.image_id=zb.view_id AND c.x=CAST(floor(zb.u*32/zb.w+0.5) AS BIGINT) AND c.y=CAST(floor(zb.v*32/zb.h+0.5) AS BIGINT)),
col AS (SELECT *, coalesce(cr, (0.12+0.78*t)*0.45) r, coalesce(cg, (0.35+0.48*(1-abs(t-0.5)*2))*0.45) g, coalesce(cb, (0.82-0.62*t)*0.45) b FROM sc)"""
STATS = """l AS (SELECT image_id, y, x, r/255 r, g/255 g, b/255 b, 0.2126*(r/255)+0.7152*(g/255)+0.0722*(b/255) l FROM fx_rgb),
ll AS (SELECT l.*, a.l lr, d.l ld FROM l LEFT JOIN l a ON a.image_id=l.image_id AND a.y=l.y AND a.x=l.x+1 LEFT JOIN l d ON d.image_id=l.image_id AND d.y=l.y+1 AND d.x=l.x),
ps AS (SELECT image_id, avg(r) mean_r, avg(g) mean_g, avg(b) mean_b, avg(l) luminance_mean, stddev_pop(l) luminance_std, avg((l<0.08)::INT) shadow_ratio, avg((l>0.94)::INT) highlight_ratio,
 coalesce(sum(abs(lr-l)+abs(ld-l)), 0)/greatest(1, 2*count(lr+ld)) sharpness FROM ll GROUP BY 1),
tg AS (SELECT image_id//8 set_id, """ + ", ".join(f"median({c}) target_{c}" for c in ops.TARGET) + " FROM ps GROUP BY 1)"
NUM = ["mean_r", "mean_g", "mean_b", "luminance_mean", "luminance_std", "shadow_ratio", "highlight_ratio", "sharpness"]
LUM = "(0.2126*{0}r+0.7152*{0}g+0.0722*{0}b)"
NORM = STATS + """,
n0 AS (SELECT l.image_id, l.y, l.x, ps.*, tg.*, least(1, greatest(0, l.r*least(1.6, greatest(0.65, target_mean_r/greatest(0.03, mean_r))))) gr, least(1, greatest(0, l.g*least(1.6, greatest(0.65, target_mean_g/greatest(0.03, mean_g))))) gg, least(1, greatest(0, l.b*least(1.6, greatest(0.65, target_mean_b/greatest(0.03, mean_b))))) gb
 FROM l JOIN ps USING (image_id) JOIN tg ON tg.set_id=l.image_id//8),
n1 AS (SELECT *, """ + LUM.format("g") + """ yy FROM n0),
n2 AS (SELECT *, pow(least(1, greatest(0, target_luminance_mean+(yy-luminance_mean)*least(1.45, greatest(0.72, target_luminance_std/greatest(0.035, luminance_std))))), 0.96) yn FROM n1),
n3 AS (SELECT image_id, y, x, CASE WHEN yy>0.015 THEN least(2.2, greatest(0.45, yn/yy)) ELSE 1 END s, gr, gg, gb FROM n2)"""
WEIGHT = """vw AS (SELECT p.view_id, least(1.4, greatest(0.03, least(1, greatest(0.15, inliers/greatest(1, inliers, correspondences)))/(1+rmse_px/4) * least(1, greatest(0.2, 1-shadow_ratio*0.7-highlight_ratio*0.8)) * least(1.25, greatest(0.25, sharpness/0.08)))) weight FROM fx_poses p JOIN ps ON ps.image_id=p.view_id)"""


@query("g1_class_summary", "SELECT cloud_id, cls, class_name, n, has_intensity, min_x, max_x, round(n/total, 9) fraction FROM summary", "fx_points_anon", SUMMARY)
def g1(fx):
    return ops.class_summary(fx.points_anon).select("cloud_id", "cls", "class_name", "n", "has_intensity", "min_x", "max_x", F.round("fraction", 9).alias("fraction"))


@query("g2_environment_tags", """
SELECT cloud_id, array_to_string(list_filter([CASE WHEN v>=0.15 THEN CASE WHEN v>=0.4 THEN 'vegetation_high' ELSE 'vegetation_low' END END, CASE WHEN w>0 THEN 'water_proximity' END, CASE WHEN b>0.05 THEN 'built_environment_nearby' END], lambda e: e IS NOT NULL), ',') environment_tags, w>=0.02 flood_risk_flag, round(v, 9) vegetation_fraction, round(w, 9) water_fraction
FROM (SELECT cloud_id, coalesce(sum(n/total) FILTER (class_name IN ('low_vegetation','medium_vegetation','high_vegetation')), 0) v, coalesce(sum(n/total) FILTER (class_name='water'), 0) w, coalesce(sum(n/total) FILTER (class_name='building'), 0) b FROM summary GROUP BY 1) q""", "fx_points_anon", SUMMARY)
def g2(fx):
    out = ops.environment_tags(ops.class_summary(fx.points_anon))
    return out.select("cloud_id", F.array_join("environment_tags", ",").alias("environment_tags"), "flood_risk_flag", F.round("vegetation_fraction", 9).alias("vegetation_fraction"), F.round("water_fraction", 9).alias("water_fraction"))


@query("g3_bounds_and_center", "SELECT point_id, p.cloud_id, x-(min_x+max_x)/2 x, y-(min_y+max_y)/2 y, z-(min_z+max_z)/2 z FROM fx_points p JOIN bounds b USING (cloud_id)", "fx_points fx_points_anon", BOUNDS)
def g3(fx):
    return ops.recenter(fx.points.select("point_id", "cloud_id", "x", "y", "z"))


@query("g4_normalize_rgb", "SELECT c.image_id, y, x, round(r/d, 9) r, round(g/d, 9) g, round(b/d, 9) b FROM fx_rgb c JOIN (SELECT image_id, CASE WHEN max(greatest(r,g,b))<=1 THEN 1 WHEN max(greatest(r,g,b))<=255 THEN 255 ELSE 65535 END d FROM fx_rgb GROUP BY 1) q USING (image_id)", "fx_rgb")
def g4(fx):
    return ops.normalize_rgb(fx.rgb, "image_id").select("image_id", "y", "x", *[F.round(k, 9).alias(k) for k in "rgb"])


@query("g5_voxel_size", "SELECT cloud_id, n, bins, round(diagonal, 9) diagonal, round(voxel, 9) voxel FROM vs", "fx_points_anon", VOXEL)
def g5(fx):
    return ops.voxel_size(fx.points_anon).select("cloud_id", "n", "bins", F.round("diagonal", 9).alias("diagonal"), F.round("voxel", 9).alias("voxel"))


SUMS = [m for m in ops.MOMENTS if m != "n"]


@query("g6_voxel_moments", "SELECT cloud_id, ix, iy, iz, n, " + ", ".join(f"round({c}, 5) {c}" for c in SUMS) + " FROM vm", "fx_points_anon", CELLS)
def g6(fx):
    out = ops.voxel_moments(fx.points_anon, ops.measured(ops.voxel_size(fx.points_anon)))
    return out.select("cloud_id", "ix", "iy", "iz", "n", *[F.round(c, 5).alias(c) for c in SUMS])


@query("g7_neighborhood_moments", "SELECT cloud_id, ix, iy, iz, own, n, " + ", ".join(f"round({c}, 5) {c}" for c in SUMS) + " FROM nm", "fx_points_anon", NEAR)
def g7(fx):
    out = ops.neighborhood_moments(ops.voxel_moments(fx.points_anon, ops.measured(ops.voxel_size(fx.points_anon))))
    return out.select("cloud_id", "ix", "iy", "iz", "own", "n", *[F.round(c, 5).alias(c) for c in SUMS])


@query("g8_geometry_class", "SELECT cloud_id, ix, iy, iz, own, n, class_id, round(linearity, 6) linearity, round(planarity, 6) planarity, round(scattering, 6) scattering FROM cls", "fx_points_anon", CLASS)
def g8(fx):
    out = ops.geometry_voxels(fx.points_anon)
    return out.select("cloud_id", "ix", "iy", "iz", "own", "n", "class_id", *[F.round(c, 6).alias(c) for c in ("linearity", "planarity", "scattering")])


@query("g9_geometry_summary", """
SELECT t.cloud_id, g.geometry, coalesce(c.n, 0)::BIGINT n, round(coalesce(c.n, 0)/t.total, 9) fraction FROM (SELECT cloud_id, sum(own) total FROM cls GROUP BY 1) t
CROSS JOIN (SELECT unnest(range(0,5)) class_id, unnest(['low_support','linear_edge','planar_surface','irregular_volume','transitional']) geometry) g LEFT JOIN (SELECT cloud_id, class_id, sum(own) n FROM cls GROUP BY 1,2) c ON c.cloud_id=t.cloud_id AND c.class_id=g.class_id""", "fx_points_anon", CLASS)
def g9(fx):
    return ops.geometry_summary(fx.points_anon).withColumn("fraction", F.round("fraction", 9))


def projected(fx):
    return ops.project_points(fx.points.select("point_id", "cloud_id", "x", "y", "z"), fx.poses)


def visible(fx):
    return ops.zbuffer_visible(projected(fx))


@query("g10_project_points", "SELECT point_id, view_id, round(u + 1.234e-8, 6) u, round(v + 1.234e-8, 6) v, round(depth, 6) depth, in_frame FROM fr", "fx_points fx_poses", PROJ)
def g10(fx):
    return projected(fx).select("point_id", "view_id", *[F.round(F.col(c) + 1.234e-8, 6).alias(c) for c in ("u", "v")], F.round("depth", 6).alias("depth"), "in_frame")


@query("g11_zbuffer_visible", "SELECT point_id, view_id, px, py, visible FROM zb", "fx_points fx_poses", PROJ)
def g11(fx):
    return visible(fx).select("point_id", "view_id", "px", "py", "visible")


@query("g12_sample_colors", "SELECT point_id, view_id, colored, round(r, 9) r, round(g, 9) g, round(b, 9) b FROM col", "fx_points fx_poses fx_rgb", COLORS)
def g12(fx):
    out = ops.sample_colors(visible(fx), fx.rgb, 32, 32, ops.cloud_bounds(fx.points_anon))
    return out.select("point_id", "view_id", "colored", *[F.round(k, 9).alias(k) for k in "rgb"])


def shapes(fx):
    """Records as shapes: the box ring for regions, its diagonal for cracks."""
    r = fx.records_anon
    x, y, w, h = (F.col(f"bbox_{k}").cast("double") for k in "xywh")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    closed = F.col("damage_class") != "cracks"
    return r.select((F.col("image_id") % 4).alias("view_id"), "damage_class", closed.alias("closed"), "width_px",
                    F.when(closed, F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))).otherwise(F.array(p(x, y), p(x + w, y + h))).alias("points"))


LABELS = PROJ + """,
rec AS (SELECT DISTINCT image_id % 4 view_id, damage_class, width_px, bbox_x::DOUBLE x, bbox_y::DOUBLE y, bbox_w::DOUBLE w, bbox_h::DOUBLE h, CASE damage_class WHEN 'exposed_rebar' THEN 0 WHEN 'corrosion_rust' THEN 1 WHEN 'cracks' THEN 2 WHEN 'spalling_dark' THEN 3 ELSE 4 END pr FROM fx_records_anon),
rt AS (SELECT *, unnest(range(CAST(floor((x-7)/64) AS BIGINT), CAST(floor((x+w+7)/64) AS BIGINT)+1)) tx FROM rec),
pt AS (SELECT point_id, view_id, u*2 a, v*2 b, CAST(floor(u*2/64) AS BIGINT) tx FROM zb WHERE visible),
lab AS (SELECT p.view_id, p.point_id, min(pr)::BIGINT class_id FROM pt p JOIN rt r ON r.view_id=p.view_id AND r.tx=p.tx AND b BETWEEN y-7 AND y+h+7
 WHERE CASE WHEN pr<>2 THEN a>=x AND a<x+w AND b>=y AND b<y+h ELSE sqrt(pow(a-(x+least(1, greatest(0, ((a-x)*w+(b-y)*h)/(w*w+h*h)))*w), 2) + pow(b-(y+least(1, greatest(0, ((a-x)*w+(b-y)*h)/(w*w+h*h)))*h), 2)) <= greatest(1.5, width_px/2+1) END GROUP BY 1,2)"""


@query("g13_record_contains", """
SELECT damage_class, time_label, count(*) FILTER (px>=bbox_x AND px<bbox_x+bbox_w AND py>=bbox_y AND py<bbox_y+bbox_h) inside, count(*) n FROM (SELECT *, 400+(bbox_x*7)%800 px, 300+(bbox_y*11)%600 py FROM fx_records_anon) q GROUP BY 1,2""", "fx_records_anon")
def g13(fx):
    from ..functions.geometry import point_in_polygon
    x, y, w, h = (F.col(f"bbox_{k}").cast("double") for k in "xywh")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))
    hit = point_in_polygon(400 + (F.col("bbox_x") * 7) % 800, 300 + (F.col("bbox_y") * 11) % 600, ring)
    return fx.records_anon.groupBy("damage_class", "time_label").agg(F.count_if(hit).alias("inside"), F.count(F.lit(1)).alias("n"))


@query("g14_label_points", "SELECT * FROM lab", "fx_points fx_poses fx_records_anon", LABELS)
def g14(fx):
    return ops.label_points(visible(fx), shapes(fx), 2.0, 2.0)


@query("g15_fuse_votes", """
SELECT point_id, class_id, support, round(weight/total, 9) confidence, support>=2 confirmed FROM (SELECT *, sum(weight) OVER (PARTITION BY point_id) total, row_number() OVER (PARTITION BY point_id ORDER BY weight DESC, class_id) rn
 FROM (SELECT point_id, class_id, sum(greatest(0.001, weight)) weight, count(*) support FROM fx_votes GROUP BY 1,2) a) b WHERE rn=1""", "fx_votes")
def g15(fx):
    return ops.fuse_votes(fx.votes, views=4).withColumn("confidence", F.round("confidence", 9))


@query("g16_photometric_stats", "SELECT image_id, " + ", ".join(f"round({c}, 9) {c}" for c in NUM) + " FROM ps", "fx_rgb", STATS)
def g16(fx):
    return ops.photometric_stats(fx.rgb).select("image_id", *[F.round(c, 9).alias(c) for c in NUM])


def target(fx):
    return ops.photometric_target(ops.photometric_stats(fx.rgb).withColumn("set_id", F.floor(F.col("image_id") / 8)), ["set_id"])


@query("g17_photometric_target", "SELECT set_id, " + ", ".join(f"round(target_{c}, 9) target_{c}" for c in ops.TARGET) + " FROM tg", "fx_rgb", STATS)
def g17(fx):
    return target(fx).select("set_id", *[F.round(f"target_{c}", 9).alias(f"target_{c}") for c in ops.TARGET])


@query("g18_normalize_photometric", "SELECT image_id, y, x, round(least(1, greatest(0, gr*s)), 8) r, round(least(1, greatest(0, gg*s)), 8) g, round(least(1, greatest(0, gb*s)), 8) b FROM n3", "fx_rgb", NORM)
def g18(fx):
    stats = ops.photometric_stats(fx.rgb).withColumn("set_id", F.floor(F.col("image_id") / 8))
    rows = fx.rgb.select("image_id", "y", "x", *[(F.col(k) / 255.0).alias(k) for k in "rgb"])
    rows = rows.join(stats.join(ops.photometric_target(stats, ["set_id"]), "set_id"), "image_id")
    return ops.normalize_photometric(rows).select("image_id", "y", "x", *[F.round(k, 8).alias(k) for k in "rgb"])


def weights(fx):
    c = F.col
    stats = ops.photometric_stats(fx.rgb).withColumnRenamed("image_id", "view_id")
    return fx.poses.join(stats, "view_id").select("view_id", ops.view_weight(c("rmse_px"), c("inliers"), c("correspondences"), c("shadow_ratio"), c("highlight_ratio"), c("sharpness")).alias("weight"))


@query("g19_view_weights", """
SELECT v.view_id, round(v.weight, 9) weight, round(sum(iw), 4) incidence, round(sum(dw), 4) depth_weight, count(*) n FROM vw v JOIN (SELECT view_id, CASE WHEN vm<=1e-9 THEN 1 ELSE pow(least(1, greatest(0.08, (abs(camz-z)/vm-0.08)/0.92)), 1.35) END iw, least(1, greatest(0.2, 1/(1+0.7*(depth/70-1)*(depth/70-1)))) dw
 FROM (SELECT fr.*, -tz camz, sqrt((-tx-x)*(-tx-x)+(-ty-y)*(-ty-y)+(-tz-z)*(-tz-z)) vm FROM fr JOIN (SELECT view_id, tx, ty, tz FROM fx_poses) p USING (view_id)) q WHERE depth>0) w USING (view_id) GROUP BY 1,2""", "fx_points fx_poses fx_rgb", STATS + ",\n" + WEIGHT + ",\n" + PROJ)
def g19(fx):
    c = F.col
    cam = fx.poses.select("view_id", *[(-c(f"t{a}")).alias(f"cam_{a}") for a in "xyz"])
    rows = projected(fx).where("depth > 0").join(cam, "view_id")
    inc = ops.incidence_weight([F.lit(0.0), F.lit(0.0), F.lit(1.0)], [c(a) for a in "xyz"], [c(f"cam_{a}") for a in "xyz"])
    sums = rows.groupBy("view_id").agg(F.round(F.sum(inc), 4).alias("incidence"), F.round(F.sum(ops.depth_weight(c("depth"), F.lit(70.0))), 4).alias("depth_weight"), F.count(F.lit(1)).alias("n"))
    return weights(fx).join(sums, "view_id").withColumn("weight", F.round("weight", 9))


@query("g20_fuse_colors", """
SELECT point_id, round(sum(r*w)/sum(w), 8) r, round(sum(g*w)/sum(w), 8) g, round(sum(b*w)/sum(w), 8) b, round(sum(w), 8) weight, count(*) coverage FROM (
 SELECT c.point_id, r, g, b, v.weight * CASE WHEN depth>0 AND rd>0 THEN least(1, greatest(0.2, 1/(1+0.7*(depth/rd-1)*(depth/rd-1)))) ELSE 1 END w FROM col c JOIN vw v USING (view_id) JOIN (SELECT view_id, median(round(depth, 3)) rd FROM zb WHERE visible AND depth>0 GROUP BY 1) d USING (view_id) WHERE colored) q GROUP BY 1""",
       "fx_points fx_poses fx_rgb", STATS + ",\n" + WEIGHT + ",\n" + COLORS)
def g20(fx):
    seen = visible(fx)
    colored = ops.sample_colors(seen, fx.rgb, 32, 32, ops.cloud_bounds(fx.points_anon)).where("colored")
    rows = colored.join(ops.measured(weights(fx)), "view_id").join(ops.measured(ops.reference_depth(seen)), "view_id")
    rows = rows.withColumn("weight", F.col("weight") * ops.depth_weight(F.col("depth"), F.col("reference_depth")))
    return ops.fuse_colors(rows).select("point_id", *[F.round(k, 8).alias(k) for k in "rgb"], F.round("weight", 8).alias("weight"), "coverage")


FUSED = STATS + ",\n" + WEIGHT + ",\n" + COLORS + """,
rdp AS (SELECT view_id, median(round(depth, 3)) rd FROM zb WHERE visible AND depth>0 GROUP BY 1),
smp AS (SELECT view_id, point_id, r, g, b, vwt, rd, iw, vwt*iw*dw w FROM (SELECT *, CASE WHEN vm<=1e-9 THEN 1 ELSE pow(least(1, greatest(0.08, (abs(camz-pz)/vm-0.08)/0.92)), 1.35) END iw, CASE WHEN depth>0 AND rd>0 THEN least(1, greatest(0.2, 1/(1+0.7*(depth/rd-1)*(depth/rd-1)))) ELSE 1 END dw
 FROM (SELECT c.point_id, c.view_id, r, g, b, c.depth, v.weight vwt, rd, p.z pz, -o.tz camz, sqrt((-o.tx-p.x)*(-o.tx-p.x)+(-o.ty-p.y)*(-o.ty-p.y)+(-o.tz-p.z)*(-o.tz-p.z)) vm FROM col c JOIN vw v USING (view_id) JOIN rdp USING (view_id) JOIN fx_points p ON p.point_id=c.point_id JOIN fx_poses o ON o.view_id=c.view_id WHERE colored) a) b),
fp AS (SELECT p.point_id, p.cloud_id, coalesce(f.r, (0.12+0.78*t)*0.55) r, coalesce(f.g, (0.35+0.48*(1-abs(t-0.5)*2))*0.55) g, coalesce(f.b, (0.82-0.62*t)*0.55) b, coalesce(f.w, 0) weight, coalesce(n, 0) coverage, f.w IS NOT NULL colored, coalesce(f.w, 0)/max(f.w) OVER () share
 FROM (SELECT *, least(1, greatest(0, (z-min(z) OVER (PARTITION BY cloud_id))/greatest(max(z) OVER (PARTITION BY cloud_id)-min(z) OVER (PARTITION BY cloud_id), 1e-9))) t FROM fx_points) p LEFT JOIN (SELECT point_id, sum(r*w)/sum(w) r, sum(g*w)/sum(w) g, sum(b*w)/sum(w) b, sum(w) w, count(*) n FROM smp GROUP BY 1) f USING (point_id))"""


def samples(fx):
    """Colours of all views with the weights of view, depth and incidence on a horizontal surface."""
    c = F.col
    seen = visible(fx)
    cam = fx.poses.select("view_id", *[(-c(f"t{a}")).alias(f"cam_{a}") for a in "xyz"])
    rows = ops.sample_colors(seen, fx.rgb, 32, 32, ops.cloud_bounds(fx.points_anon)).where("colored")
    rows = rows.join(ops.measured(weights(fx)), "view_id").join(ops.measured(ops.reference_depth(seen)), "view_id").join(cam, "view_id").withColumnRenamed("weight", "view_weight")
    rows = rows.withColumn("incidence", ops.incidence_weight([F.lit(0.0), F.lit(0.0), F.lit(1.0)], [c(a) for a in "xyz"], [c(f"cam_{a}") for a in "xyz"]))
    return rows.withColumn("weight", c("view_weight") * c("incidence") * ops.depth_weight(c("depth"), c("reference_depth")))


@query("g20_fused_points", "SELECT point_id, colored, coverage, round(weight, 8) weight, round(r, 8) r, round(g, 8) g, round(b, 8) b, round(0.12+0.18*share, 8) confidence_r, round(0.18+0.72*share, 8) confidence_g, round(0.30+0.58*(1-share), 8) confidence_b FROM fp", "fx_points fx_poses fx_rgb", FUSED)
def g20b(fx):
    out = ops.fused_points(fx.points, samples(fx), ops.cloud_bounds(fx.points_anon))
    return out.select("point_id", "colored", "coverage", *[F.round(c, 8).alias(c) for c in ("weight", "r", "g", "b", "confidence_r", "confidence_g", "confidence_b")])


@query("g20_fusion_views", "SELECT view_id, round(max(vwt), 9) weight, count(*) contributed_points, round(avg(iw), 8) mean_incidence_weight, round(max(rd), 6) reference_depth FROM smp GROUP BY 1", "fx_points fx_poses fx_rgb", FUSED)
def g20c(fx):
    return ops.fusion_views(samples(fx)).select("view_id", F.round("weight", 9).alias("weight"), "contributed_points", F.round("mean_incidence_weight", 8).alias("mean_incidence_weight"), F.round("reference_depth", 6).alias("reference_depth"))


@query("g20_fusion_summary", "SELECT count(*) FILTER (colored) colored_points, count(*) total_points, round(count(*) FILTER (colored)/count(*), 9) coverage_ratio, round(coalesce(avg(coverage) FILTER (colored), 0), 8) mean_views, round(coalesce(avg(weight) FILTER (colored), 0), 8) mean_weight FROM fp", "fx_points fx_poses fx_rgb", FUSED)
def g20d(fx):
    out = ops.fusion_summary(ops.fused_points(fx.points, samples(fx), ops.cloud_bounds(fx.points_anon)))
    return out.select("colored_points", "total_points", *[F.round(c, n).alias(c) for c, n in (("coverage_ratio", 9), ("mean_views", 8), ("mean_weight", 8))])


@query("g21_nearest_point", """
SELECT query_id, round(min(sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)+(q.z-p.z)*(q.z-p.z))), 9) distance FROM (SELECT record_id query_id, record_id % 4 cloud_id, x, y - 50*floor(y/50) y, z FROM fx_spatial_records) q JOIN (SELECT DISTINCT cloud_id, x, y, z FROM fx_points_anon) p USING (cloud_id) GROUP BY 1""", "fx_spatial_records fx_points_anon")
def g21(fx):
    q = fx.spatial_records.select("record_id", (F.col("record_id") % 4).alias("cloud_id"), "x", (F.col("y") - 50 * F.floor(F.col("y") / 50)).alias("y"), "z")  # y folded into the extent of the clouds
    points = fx.points_anon.groupBy("cloud_id", "x", "y", "z").agg(F.min("code").alias("code"))
    out = ops.nearest_point(q, points, ["cloud_id"], 0.5, "record_id", "code")
    return out.select("query_id", F.round("distance", 9).alias("distance"))


@query("g22_rigid_transform", "SELECT point_id, round(0.8*x-0.6*y+0.0*z+2.5, 6) x, round(0.6*x+0.8*y+0.0*z-1.25, 6) y, round(0.0*x+0.0*y+z+0.75, 6) z FROM fx_points", "fx_points")
def g22(fx):
    out = ops.rigid_transform(fx.points.select("point_id", "x", "y", "z"), [[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1]], [2.5, -1.25, 0.75])
    return out.select("point_id", *[F.round(a, 6).alias(a) for a in "xyz"])


@query("g23_fit_rigid", """
SELECT cloud_id, n, 'ok' status, 0.8 r00, -0.6 r01, 0.6 r10, 2.5 dx, -1.25 dy, 0.75 dz, 0.0 rmse FROM (SELECT cloud_id, count(*) n FROM fx_points_anon GROUP BY 1) q""".replace("0.8 ", "0.8::DOUBLE ").replace("-0.6 ", "-0.6::DOUBLE ").replace(" 0.6 ", " 0.6::DOUBLE ").replace("2.5 ", "2.5::DOUBLE ").replace("-1.25 ", "-1.25::DOUBLE ").replace("0.75 ", "0.75::DOUBLE ").replace("0.0 ", "0.0::DOUBLE "), "fx_points_anon")
def g23(fx):
    s = fx.points_anon.select("cloud_id", *[F.col(a).alias(f"s{a}") for a in "xyz"])
    x, y, z = F.col("sx"), F.col("sy"), F.col("sz")
    pairs = s.withColumn("tx", 0.8 * x - 0.6 * y + 2.5).withColumn("ty", 0.6 * x + 0.8 * y - 1.25).withColumn("tz", z + 0.75)
    out = ops.fit_rigid(pairs, "cloud_id")
    return out.select("cloud_id", "n", "status", *[(F.round(c, 6) + 0.0).alias(c) for c in ("r00", "r01", "r10", "dx", "dy", "dz", "rmse")])


@query("g24_icp", "SELECT count(*) n, -0.01::DOUBLE dx, 0.015::DOUBLE dy, -0.02::DOUBLE dz, 0.0::DOUBLE rmse FROM (SELECT DISTINCT x, y, z FROM fx_points_anon) q", "fx_points_anon")
def g24(fx):
    """The whole cloud, moved by a known shift, finds its place again."""
    cloud = stored(fx.points_anon.select("x", "y", "z").distinct().sortWithinPartitions("x", "y", "z"))
    cloud = cloud.withColumn("point_id", F.concat_ws("/", "x", "y", "z"))
    moved = ops.rigid_transform(cloud, [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [0.01, -0.015, 0.02])
    rotation, shift, history = ops.icp(moved, cloud, radius=0.25, max_iterations=10)
    return cloud.agg(F.count(F.lit(1)).alias("n")).select("n", *[F.lit(round(v, 6)).alias(f"d{a}") for a, v in zip("xyz", shift)], F.lit(round(history[-1], 6)).alias("rmse"))


@query("g25_knn_ratio_match", """
SELECT image_id, a_id, b_id, round(d, 6) distance, round(d2, 6) AS second FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) rn, lead(d) OVER (PARTITION BY a_id ORDER BY d, b_id) d2 FROM (
 SELECT a.vec_id//16 image_id, a.vec_id a_id, b.vec_id b_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) d FROM embeddings a JOIN embeddings b ON a.vec_id//16=b.vec_id//16 AND a.vec_id%2=0 AND b.vec_id%2=1) p) q WHERE rn=1 AND d<0.97*d2""")
def g25(fx):
    rows = fx.embeddings.select(F.floor(F.col("vec_id") / 16).alias("image_id"), "vec_id", "embedding")
    out = ops.knn_ratio_match(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), ["image_id"], 0.97)
    return out.select("image_id", "a_id", "b_id", F.round("distance", 6).alias("distance"), F.round("second", 6).alias("second"))


# Greedy choice in order of score, as a recursion over the candidates of a view.
ASSOCIATED = PROJ + """,
mm AS (SELECT image_id % 4 view_id, bbox_x/2.0::DOUBLE au, bbox_y/2.0::DOUBLE av, min(length_px) d FROM fx_records_anon GROUP BY 1,2,3),
ss AS (SELECT view_id, u, v, arg_min(point_id, (depth, point_id)) point_id, min(depth) depth FROM fr WHERE in_frame GROUP BY 1,2,3),
mc AS (SELECT *, CAST(floor(au/10) AS BIGINT)+dx gx, CAST(floor(av/10) AS BIGINT)+dy gy FROM mm CROSS JOIN (SELECT unnest(range(-1,2)) dx) a CROSS JOIN (SELECT unnest(range(-1,2)) dy) b),
nn AS (SELECT m.view_id, m.au, m.av, any_value(m.d) d, min(dist) dist, arg_min(point_id, (dist, depth, point_id)) point_id FROM (SELECT m.*, p.point_id, p.depth, sqrt((m.au-p.u)*(m.au-p.u)+(m.av-p.v)*(m.av-p.v)) dist FROM mc m JOIN ss p ON p.view_id=m.view_id AND CAST(floor(p.u/10) AS BIGINT)=m.gx AND CAST(floor(p.v/10) AS BIGINT)=m.gy) m WHERE dist<10 GROUP BY 1,2,3),
ca AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score, match_id) k FROM (SELECT view_id, au::VARCHAR || '/' || av::VARCHAR match_id, point_id, dist, d+dist*4.0 score, CAST(floor((au*0.9+3)/12) AS BIGINT)*100000+CAST(floor((av*1.1-2)/12) AS BIGINT) cell FROM nn) q),
gf AS /* RECURSIVE */ (SELECT view_id, k, true ok, [point_id] points, [cell] cells FROM ca WHERE k=1 UNION ALL SELECT c.view_id, c.k, NOT list_contains(f.points, c.point_id) AND NOT list_contains(f.cells, c.cell),
 CASE WHEN NOT list_contains(f.points, c.point_id) AND NOT list_contains(f.cells, c.cell) THEN list_append(f.points, c.point_id) ELSE f.points END, CASE WHEN NOT list_contains(f.points, c.point_id) AND NOT list_contains(f.cells, c.cell) THEN list_append(f.cells, c.cell) ELSE f.cells END
 FROM gf f JOIN ca c ON c.view_id=f.view_id AND c.k=f.k+1 WHERE len(f.points)<600)"""


@query("g26_associate_matches", "SELECT view_id, match_id, point_id, round(dist, 6) association_px, round(score, 6) score FROM ca JOIN (SELECT view_id, k FROM gf WHERE ok) g USING (view_id, k)", "fx_points fx_poses fx_records_anon", ASSOCIATED)
def g26(fx):
    matches = fx.records_anon.groupBy((F.col("image_id") % 4).alias("view_id"), (F.col("bbox_x") / 2).alias("au"), (F.col("bbox_y") / 2).alias("av")).agg(F.min("length_px").alias("distance"))
    matches = matches.select("view_id", F.concat_ws("/", "au", "av").alias("match_id"), "au", "av", (F.col("au") * 0.9 + 3).alias("tu"), (F.col("av") * 1.1 - 2).alias("tv"), "distance")
    out = ops.associate_matches(matches, projected(fx))
    return out.select("view_id", "match_id", "point_id", F.round("association_px", 6).alias("association_px"), F.round("score", 6).alias("score"))


@query("g27_propagation_gate", """
SELECT image_id, engine_id, correspondences, inliers, CASE WHEN correspondences<8 THEN 'too_few_correspondences' WHEN inliers<6 THEN 'too_few_inliers' WHEN inliers/correspondences<0.35 THEN 'low_inlier_ratio' WHEN rmse_px>9 THEN 'high_reprojection_error' ELSE 'accepted' END reason
FROM (SELECT image_id, engine_id, CAST(latency_ms AS BIGINT)%40 correspondences, CAST(floor(latency_ms/9) AS BIGINT)%20 inliers, latency_ms/80 rmse_px FROM fx_runs) q""", "fx_runs")
def g27(fx):
    v = fx.runs.selectExpr("image_id", "engine_id", "CAST(latency_ms AS BIGINT)%40 correspondences", "CAST(floor(latency_ms/9) AS BIGINT)%20 inliers", "latency_ms/80 rmse_px")
    return ops.propagation_gate(v).select("image_id", "engine_id", "correspondences", "inliers", "reason")


LINES = "SELECT concat('#', CAST(p_partkey AS STRING), ' = IFC', CASE p_size % 5 WHEN 0 THEN 'SLAB' WHEN 1 THEN 'Beam' WHEN 2 THEN 'BRIDGE' WHEN 3 THEN 'CARTESIANPOINT' ELSE 'REL_VOIDS' END, '((', CAST(p_size AS STRING), '.,0.));') value FROM {part}"


@query("g28_element_counts", "SELECT entity, count(*) n, entity IN ('IFCSLAB','IFCBEAM','IFCBRIDGE') structural FROM (SELECT upper(regexp_extract(value, '#\\d+ = (IFC\\w+)', 1)) entity FROM (" + LINES.format(part="part") + ") l) q GROUP BY 1")
def g28(fx):
    return ops.element_counts(fx.spark.sql(LINES, part=fx.part))
