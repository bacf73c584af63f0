"""Registered queries: damage in space and time (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracking as ops
from .base import query
from .g_cloud import PROJ, visible

# Regions as box rings, cracks as their diagonal; view = image modulo 4.
VERTS = """rv AS (SELECT image_id % 4 view_id, record_id, damage_class, damage_class<>'cracks' closed, bbox_x::DOUBLE x, bbox_y::DOUBLE y, bbox_w::DOUBLE w, bbox_h::DOUBLE h FROM fx_records),
vt AS (SELECT view_id, record_id, damage_class, closed, 0 seq, x, y FROM rv UNION ALL SELECT view_id, record_id, damage_class, closed, 1, x+w, CASE WHEN closed THEN y ELSE y+h END FROM rv
 UNION ALL SELECT view_id, record_id, damage_class, closed, 2, x+w, y+h FROM rv WHERE closed UNION ALL SELECT view_id, record_id, damage_class, closed, 3, x, y+h FROM rv WHERE closed)"""
LIFT = PROJ + ",\n" + VERTS + """,
vp AS (SELECT view_id, u*2.0::DOUBLE x, v*2.0::DOUBLE y, min(point_id) point_id FROM zb WHERE visible GROUP BY 1,2,3),
vd AS (SELECT DISTINCT view_id, x, y FROM vt),
vc AS (SELECT *, CAST(floor(x/36) AS BIGINT)+dx gx, CAST(floor(y/36) AS BIGINT)+dy gy FROM vd CROSS JOIN (SELECT unnest(range(-1,2)) dx) a CROSS JOIN (SELECT unnest(range(-1,2)) dy) b),
nb AS (SELECT v.view_id, v.x, v.y, min(sqrt((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y))) d, arg_min(p.point_id, (sqrt((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)), p.point_id)) point_id FROM vc v JOIN vp p ON p.view_id=v.view_id AND CAST(floor(p.x/36) AS BIGINT)=v.gx AND CAST(floor(p.y/36) AS BIGINT)=v.gy WHERE (v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y) < 1296 GROUP BY 1,2,3),
mt AS (SELECT t.view_id, t.record_id, t.damage_class, t.closed, n.point_id, arg_min(n.d, t.seq) d FROM vt t JOIN nb n ON n.view_id=t.view_id AND n.x=t.x AND n.y=t.y GROUP BY 1,2,3,4,5)"""


def outlines(fx):
    r = fx.records
    x, y, w, h = (F.col(f"bbox_{k}").cast("double") for k in "xywh")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    closed = F.col("damage_class") != "cracks"
    return r.select((F.col("image_id") % 4).alias("view_id"), "record_id", "damage_class", closed.alias("closed"),
                    F.when(closed, F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))).otherwise(F.array(p(x, y), p(x + w, y + h))).alias("points"))


@query("h1_lift_records", "SELECT view_id, record_id, damage_class, closed, count(*) matches, round(sqrt(avg(d*d)), 6) reprojection_rmse FROM mt GROUP BY 1,2,3,4 HAVING count(*)>=2", "fx_points fx_poses fx_records", LIFT)
def h1(fx):
    out = ops.lift_records(outlines(fx), visible(fx), 2.0, 2.0)
    return out.select("view_id", "record_id", "damage_class", "closed", "matches", F.round("reprojection_rmse", 6).alias("reprojection_rmse"))


VERTEX = "vx AS (SELECT element_id, ax x, ay y, az z FROM fx_triangles UNION ALL SELECT element_id, bx, by_, bz FROM fx_triangles UNION ALL SELECT element_id, cx, cy, cz FROM fx_triangles)"


@query("h2_record_centroid", "SELECT element_id, round(avg(x), 9) x, round(avg(y), 9) y, round(avg(z), 9) z, count(*) vertices FROM vx GROUP BY 1", "fx_triangles", VERTEX)
def h2(fx):
    t = fx.triangles
    rows = t.select("element_id", F.inline(F.array(*[F.struct(*[F.col(c).alias(a) for c, a in zip(names, "xyz")]) for names in ops.TRI])))
    return ops.record_centroid(rows, "element_id").select("element_id", *[F.round(a, 9).alias(a) for a in "xyz"], "vertices")


RECT = "rc AS (SELECT element_id, global_id, min(least(ax,bx,cx)) x0, max(greatest(ax,bx,cx)) x1, min(least(ay,by_,cy)) y0, max(greatest(ay,by_,cy)) y1, min(az) z0 FROM fx_triangles GROUP BY 1,2)"


@query("h3_nearest_element", """
SELECT r.record_id, CASE WHEN r.host_id IS NOT NULL THEN 'already_had_host' WHEN b.record_id IS NOT NULL THEN 'resolved' ELSE 'no_match_within_threshold' END status, b.g host_global_id, round(b.d, 9) host_distance FROM fx_spatial_records r LEFT JOIN (
 SELECT record_id, min(d) d, arg_min(global_id, (round(d, 12), element_id)) g FROM (SELECT record_id, element_id, global_id, sqrt(pow(greatest(x0-x, 0, x-x1), 2)+pow(greatest(y0-y, 0, y-y1), 2)+pow(z-z0, 2)) d FROM fx_spatial_records JOIN rc ON x BETWEEN x0-0.6 AND x1+0.6 WHERE host_id IS NULL) q WHERE d<=0.5 GROUP BY 1) b USING (record_id)""", "fx_spatial_records fx_triangles", RECT)
def h3(fx):
    return ops.nearest_element(fx.spatial_records, fx.triangles).withColumn("host_distance", F.round("host_distance", 9))


@query("h4_axis_ray_bind", """
SELECT r.record_id, CASE WHEN b.record_id IS NOT NULL THEN 'bound' ELSE 'unbound' END status, b.g global_id, round(b.d, 9) distance FROM fx_spatial_records r LEFT JOIN (
 SELECT record_id, min(abs(z-z0)) d, arg_min(global_id, (abs(z-z0), global_id)) g FROM fx_spatial_records JOIN rc ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND abs(z-z0)<=1.5 GROUP BY 1) b USING (record_id)""", "fx_spatial_records fx_triangles", RECT)
def h4(fx):
    v = fx.spatial_records.select("record_id", F.lit(0).alias("seq"), "x", "y", "z")
    return ops.axis_ray_bind(v, fx.triangles, 1.5).withColumn("distance", F.round("distance", 9))


SEG = """sg AS (SELECT *, coalesce(sum(len) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) walked, sum(len) OVER () total FROM (SELECT a.seq, a.x sx, a.y sy, a.z sz, b.x ex, b.y ey, b.z ez, sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)+pow(b.z-a.z,2)) len FROM fx_alignment a JOIN fx_alignment b ON b.seq=a.seq+1) q)"""


@query("h5_station_on_alignment", """
SELECT record_id, round(arg_min(walked+len*t, (o, seq)), 6) station, round(arg_min((walked+len*t)/total, (o, seq)), 9) ratio, round(min(o), 6) AS "offset" FROM (SELECT *, sqrt(pow(x-(sx+t*(ex-sx)),2)+pow(y-(sy+t*(ey-sy)),2)+pow(z-(sz+t*(ez-sz)),2)) o FROM (
 SELECT r.record_id, r.x, r.y, r.z, s.*, least(1, greatest(0, ((r.x-sx)*(ex-sx)+(r.y-sy)*(ey-sy)+(r.z-sz)*(ez-sz))/(len*len))) t FROM fx_spatial_records r CROSS JOIN sg s) a) b GROUP BY 1""", "fx_spatial_records fx_alignment", SEG)
def h5(fx):
    out = ops.station_on_alignment(fx.spatial_records, ops.alignment_segments(fx.alignment), "record_id")
    return out.select("record_id", F.round("station", 6).alias("station"), F.round("ratio", 9).alias("ratio"), F.round("offset", 6).alias("offset"))


@query("h6_point_at_station", """
SELECT supp, round(tg, 8) distance, round(sx+t*(ex-sx), 8) x, round(sy+t*(ey-sy), 8) y, round((ex-sx)/len, 8) tangent_x, round((ey-sy)/len, 8) tangent_y FROM (
SELECT supp, tg, s.*, least(1, greatest(0, (tg-walked)/len)) t, row_number() OVER (PARTITION BY supp ORDER BY seq) rn FROM (SELECT s_suppkey supp, least(1, greatest(0, s_acctbal/8000))*(SELECT max(total) FROM sg) tg FROM supplier) q JOIN sg s ON s.walked+s.len>=tg OR s.seq=(SELECT max(seq) FROM sg)) z WHERE rn=1""", "fx_alignment", SEG)
def h6(fx):
    st = fx.supplier.select(F.col("s_suppkey").alias("supp"), (F.col("s_acctbal") / 8000).alias("ratio"))
    out = ops.point_at_station(st, ops.alignment_segments(fx.alignment), "supp")
    return out.select("supp", *[F.round(c, 8).alias(c) for c in ("distance", "x", "y", "tangent_x", "tangent_y")])


@query("h7_to_brim_dataset", """
SELECT r.damage_class, count(*) total, count(b.record_id) bound, count(*)-count(b.record_id) unbound, count(DISTINCT b.g) hosts FROM fx_spatial_records r LEFT JOIN (SELECT record_id, arg_min(global_id, (abs(z-z0), global_id)) g FROM fx_spatial_records JOIN rc ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND abs(z-z0)<=1.5 GROUP BY 1) b USING (record_id) GROUP BY 1""", "fx_spatial_records fx_triangles", RECT)
def h7(fx):
    v = fx.spatial_records.select("record_id", F.lit(0).alias("seq"), "x", "y", "z")
    data = ops.to_brim_dataset(ops.axis_ray_bind(v, fx.triangles, 1.5).join(fx.spatial_records.select("record_id", "damage_class"), "record_id"))
    return ops.brim_counts(data).join(data.groupBy("damage_class").agg(F.countDistinct("host.global_id").alias("hosts")), "damage_class")


def pairs(fx):
    cur = fx.spatial_records.withColumn("pair", F.col("campaign_id"))
    prev = fx.spatial_records.withColumn("pair", F.col("campaign_id") + 1)
    return prev, cur


@query("h8_candidate_pairs", """
SELECT c.campaign_id pair, c.record_id, p.record_id previous_id, round(sqrt(pow(c.x-p.x,2)+pow(c.y-p.y,2)+pow(c.z-p.z,2)), 9) distance FROM fx_spatial_records c JOIN fx_spatial_records p ON p.campaign_id=c.campaign_id-1 AND p.damage_class=c.damage_class AND (c.host_id IS NULL OR p.host_id IS NULL OR c.host_id=p.host_id)
WHERE sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)+(c.z-p.z)*(c.z-p.z)) <= 0.5""", "fx_spatial_records")
def h8a(fx):
    out = ops.candidate_pairs(*pairs(fx), ["pair"])
    return out.select(F.col("l_pair").alias("pair"), F.col("l_record_id").alias("record_id"), F.col("r_record_id").alias("previous_id"), F.round("distance", 9).alias("distance"))


def fold_cte(order: str) -> str:
    """CTEs of the sequential match between neighbouring campaigns; ``order`` is a CTE (campaign_id, previous_campaign)."""
    return order + """,
sr AS (SELECT *, CASE WHEN metric_value > 0 AND metric_comparable AND trim(metric_unit) <> '' AND trim(metric_kind) <> '' THEN metric_value END mv FROM fx_spatial_records),
cand AS (SELECT *, row_number() OVER (PARTITION BY pair, damage_class ORDER BY record_id, distance, previous_id) k FROM (
 SELECT c.campaign_id pair, c.damage_class, c.record_id, p.record_id previous_id, c.mv, p.mv pmv, c.metric_kind kind, p.metric_kind pkind, sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)+(c.z-p.z)*(c.z-p.z)) distance
 FROM sr c JOIN co ON co.campaign_id=c.campaign_id JOIN sr p ON p.campaign_id=co.previous_campaign AND p.damage_class=c.damage_class AND (c.host_id IS NULL OR p.host_id IS NULL OR c.host_id=p.host_id)) q WHERE distance<=0.5),
fold AS /* RECURSIVE */ (SELECT pair, damage_class, k, record_id, previous_id, true ok, [record_id] done, [previous_id] used FROM cand WHERE k=1
 UNION ALL SELECT c.pair, c.damage_class, c.k, c.record_id, c.previous_id, NOT list_contains(f.done, c.record_id) AND NOT list_contains(f.used, c.previous_id),
 CASE WHEN NOT list_contains(f.done, c.record_id) AND NOT list_contains(f.used, c.previous_id) THEN list_append(f.done, c.record_id) ELSE f.done END,
 CASE WHEN NOT list_contains(f.done, c.record_id) AND NOT list_contains(f.used, c.previous_id) THEN list_append(f.used, c.previous_id) ELSE f.used END
 FROM fold f JOIN cand c ON c.pair=f.pair AND c.damage_class=f.damage_class AND c.k=f.k+1),
hit AS (SELECT c.* FROM cand c JOIN fold f ON f.pair=c.pair AND f.damage_class=c.damage_class AND f.k=c.k WHERE f.ok),
mt AS (SELECT c.campaign_id pair, c.record_id, c.damage_class, h.previous_id, h.distance, CASE WHEN h.kind=h.pkind THEN (h.mv-h.pmv)/h.pmv END ratio, c.x FROM fx_spatial_records c LEFT JOIN hit h ON h.pair=c.campaign_id AND h.record_id=c.record_id),
st AS (SELECT *, CASE WHEN x IS NULL THEN 'not_comparable' WHEN previous_id IS NULL THEN 'unmatched' WHEN ratio IS NULL THEN 'matched_not_quantified' WHEN abs(ratio)<=0.05 THEN 'stable' WHEN ratio>0 THEN 'grown' ELSE 'reduced' END change_status FROM mt)"""


BY_YEAR = "co AS (SELECT DISTINCT campaign_id, campaign_id-1 previous_campaign FROM fx_spatial_records)"
BY_DATE = """co AS (SELECT campaign_id, lag(campaign_id) OVER (ORDER BY observed_at ASC NULLS LAST, campaign_id) previous_campaign FROM (SELECT campaign_id, min(observed_at) observed_at FROM fx_spatial_records GROUP BY 1) q)"""
TRACKS = fold_cte(BY_DATE) + """,
up AS /* RECURSIVE */ (SELECT record_id, previous_id root FROM st WHERE previous_id IS NOT NULL UNION ALL SELECT u.record_id, s.previous_id FROM up u JOIN st s ON s.record_id=u.root WHERE s.previous_id IS NOT NULL),
roots AS (SELECT u.record_id, u.root FROM up u JOIN st s ON s.record_id=u.root WHERE s.previous_id IS NULL),
tl AS (SELECT s.pair campaign_id, s.record_id, s.damage_class, s.previous_id, CASE WHEN co.previous_campaign IS NULL THEN 'baseline' ELSE s.change_status END change_status,
 CASE WHEN co.previous_campaign IS NULL THEN concat('cdm3-track-', s.record_id) WHEN r.root IS NOT NULL THEN concat('cdm3-track-', r.root) END track_id FROM st s JOIN co ON co.campaign_id=s.pair LEFT JOIN roots r ON r.record_id=s.record_id)"""


@query("h8_match_campaigns", "SELECT pair, record_id, damage_class, previous_id, change_status, round(ratio, 9) change_ratio, round(distance, 9) distance FROM st", "fx_spatial_records", fold_cte(BY_YEAR))
def h8(fx):
    out = ops.match_campaigns(*pairs(fx), ["pair"])
    return out.withColumn("change_ratio", F.round("change_ratio", 9)).withColumn("distance", F.round("distance", 9))


@query("h9_damage_timeline", "SELECT * FROM tl", "fx_spatial_records", TRACKS)
def h9(fx):
    return ops.damage_timeline(fx.spatial_records).drop("observed_at")


@query("h10_damage_tracks", "SELECT track_id, count(*) observation_count, string_agg(record_id::VARCHAR, ',' ORDER BY observed_at ASC NULLS LAST, campaign_id, record_id) records FROM tl JOIN (SELECT record_id, observed_at FROM fx_spatial_records) o USING (record_id) WHERE track_id IS NOT NULL GROUP BY 1", "fx_spatial_records", TRACKS)
def h10(fx):
    out = ops.damage_tracks(ops.damage_timeline(fx.spatial_records))
    return out.select("track_id", "observation_count", F.array_join(F.transform("observations", lambda o: o["record_id"].cast("string")), ",").alias("records"))
