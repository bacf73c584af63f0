"""Registered queries: temporal change (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as ops
from .base import query

# t0 of a pair: the t1 image moved by (2, 1) pixels for most images, and brightened for some.
PREV_SQL = "SELECT image_id, (y+1)%32 y, (x+CASE WHEN image_id%5=0 THEN 6 ELSE 2 END)%32 x, least(255, g + CASE WHEN image_id%4=1 THEN 70 ELSE 0 END) g FROM {px}"
PREV = "prev AS (" + PREV_SQL.format(px="fx_pixels") + ")"


def previous(fx):
    return fx.spark.sql(PREV_SQL.format(px="{px}"), px=fx.pixels)


def edge_cte(name: str, source: str) -> str:
    return f"""{name} AS (SELECT image_id, y, x, coalesce(abs(lead(g) OVER r - lag(g) OVER r) + abs(lead(g) OVER c - lag(g) OVER c), 0)::DOUBLE edge FROM {source}
 WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"""


FLAGS = """flags AS (SELECT coalesce(c.pair_id,p.pair_id) pair_id, coalesce(c.damage_class,p.damage_class) damage_class, coalesce(c.y,p.y) y, coalesce(c.x,p.x) x, c.y IS NOT NULL cur, p.y IS NOT NULL prev
 FROM (SELECT DISTINCT pair_id, damage_class, y, x FROM fx_masks WHERE epoch='t1') c FULL JOIN (SELECT DISTINCT pair_id, damage_class, y, x FROM fx_masks WHERE epoch='t0') p
 ON c.pair_id=p.pair_id AND c.damage_class=p.damage_class AND c.y=p.y AND c.x=p.x)"""
STATS = """stats AS (SELECT pair_id, damage_class, count(*) FILTER (cur AND prev)::DOUBLE intersection_px2, count(*)::DOUBLE union_px2, count(*) FILTER (prev)::DOUBLE previous_px2, count(*) FILTER (cur)::DOUBLE current_px2,
 count(*) FILTER (cur AND NOT prev)::DOUBLE growth_px2, count(*) FILTER (prev AND NOT cur)::DOUBLE reduction_px2 FROM flags GROUP BY 1,2)"""


@query("c1_mask_change", """
SELECT *, current_px2-previous_px2 net_px2, round(intersection_px2/union_px2, 9) iou, round(100*growth_px2/nullif(previous_px2,0), 9) growth_pct, round(100*reduction_px2/nullif(previous_px2,0), 9) reduction_pct, round(100*(current_px2-previous_px2)/nullif(previous_px2,0), 9) net_pct,
 previous_px2*0.0625 previous_mm2, current_px2*0.0625 current_mm2, growth_px2*0.0625 growth_mm2, reduction_px2*0.0625 reduction_mm2, (current_px2-previous_px2)*0.0625 net_mm2 FROM stats""", "fx_masks", FLAGS + ",\n" + STATS)
def c1(fx):
    out = ops.mask_change(fx.masks, 0.25)
    for c in ("iou", "growth_pct", "reduction_pct", "net_pct"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query("c2_change_pixels", "SELECT pair_id, damage_class, CASE WHEN cur THEN 'growth' ELSE 'reduction' END change, y, x FROM flags WHERE cur <> prev", "fx_masks", FLAGS)
def c2(fx):
    return ops.change_pixels(fx.masks)


@query("c4_edge_map", "SELECT * FROM e", "fx_pixels", edge_cte("e", "(SELECT image_id, y//2 y, x//2 x, g FROM fx_pixels WHERE y%2=0 AND x%2=0) s"))
def c4(fx):
    return ops.edge_map(fx.pixels, 2)


SCORES = (PREV + ",\n" + edge_cte("ec", "fx_pixels") + ",\n" + edge_cte("ep", "prev") + """,
sh AS (SELECT dx, dy FROM (SELECT unnest(range(-6,7)) dx) a CROSS JOIN (SELECT unnest(range(-6,7)) dy) b),
scores AS (SELECT ec.image_id, sh.dx, sh.dy, sum(abs(ec.edge-ep.edge))/count(*) score FROM ec CROSS JOIN sh JOIN ep ON ep.image_id=ec.image_id AND ep.y=ec.y-sh.dy AND ep.x=ec.x-sh.dx WHERE ec.y>=7 AND ec.y<25 AND ec.x>=7 AND ec.x<25 GROUP BY 1,2,3)""")
BEST = """z AS (SELECT image_id, score z FROM scores WHERE dx=0 AND dy=0),
co AS (SELECT image_id, arg_min((dx,dy), (score, abs(dx)+abs(dy), abs(dy), abs(dx), dy, dx)) c FROM scores WHERE (dx%2=0 AND dy%2=0) GROUP BY 1),
fi AS (SELECT s.image_id, arg_min((s.dx,s.dy,s.score), (score, abs(dx)+abs(dy), abs(dy), abs(dx), dy, dx)) b FROM scores s JOIN co USING (image_id) WHERE abs(s.dx-c[1])<=2 AND abs(s.dy-c[2])<=2 GROUP BY 1),
be0 AS (SELECT image_id, b[1] edx, b[2] edy, b[3] s, z, (z-b[3])/greatest(z, 1e-6) gain, abs(b[1])>=6 OR abs(b[2])>=6 boundary FROM fi JOIN z USING (image_id)),
be AS (SELECT *, (edx<>0 OR edy<>0) AND gain>=0.035 AND NOT boundary acc FROM be0),
shifts AS (SELECT image_id, edx estimated_dx, edy estimated_dy, acc accepted, boundary boundary_hit, CASE WHEN acc THEN edx ELSE 0 END dx, CASE WHEN acc THEN edy ELSE 0 END dy, z score_before, CASE WHEN acc THEN s ELSE z END score_after, CASE WHEN acc THEN gain ELSE greatest(0, gain) END improvement,
 CASE WHEN acc THEN 'translation_improved_edge_match' WHEN boundary THEN 'search_boundary_hit' ELSE 'no_reliable_translation_gain' END reason FROM be)"""


def scores(fx):
    return ops.shift_scores(ops.edge_map(fx.pixels), ops.edge_map(previous(fx)), 32, 32)


def shifts(fx):
    return ops.best_shift(scores(fx), 6)


@query("c5_shift_scores", "SELECT image_id, dx, dy, round(score, 9) score FROM scores", "fx_pixels", SCORES)
def c5(fx):
    return scores(fx).withColumn("score", F.round("score", 9))


@query("c6_best_shift", "SELECT * REPLACE (round(score_before,9) AS score_before, round(score_after,9) AS score_after, round(improvement,9) AS improvement) FROM shifts", "fx_pixels", SCORES + ",\n" + BEST)
def c6(fx):
    out = shifts(fx)
    for c in ("score_before", "score_after", "improvement"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query("c6_small_pairs", "SELECT DISTINCT image_id, 0::BIGINT dx, 0::BIGINT dy, false accepted, 0.0::DOUBLE score_before, 0.0::DOUBLE improvement, 'image_too_small' reason FROM fx_pixels", "fx_pixels")
def c6b(fx):
    """Corners of 4 x 4 pixels leave no search region."""
    corner = lambda rows: ops.edge_map(rows.where("y < 4 and x < 4"))
    out = ops.best_shift(ops.shift_scores(corner(fx.pixels), corner(previous(fx)), 4, 4), ops.search_radius(4, 4, 1))
    return out.select("image_id", "dx", "dy", "accepted", "score_before", "improvement", "reason")


ALIGNED = """aligned AS (SELECT c.image_id, c.y, c.x, coalesce(p.g, c.g) g FROM fx_pixels c JOIN shifts s USING (image_id) LEFT JOIN prev p ON p.image_id=c.image_id AND p.y=c.y-s.dy AND p.x=c.x-s.dx)"""


@query("c7_apply_shift", "SELECT * FROM aligned", "fx_pixels", SCORES + ",\n" + BEST + ",\n" + ALIGNED)
def c7(fx):
    return ops.apply_shift(previous(fx), fx.pixels, shifts(fx))


METRICS = ALIGNED + """,
pe AS (SELECT image_id, cur, prev, abs(lead(cur) OVER r - lag(cur) OVER r)+abs(lead(cur) OVER c - lag(cur) OVER c) e1, abs(lead(prev) OVER r - lag(prev) OVER r)+abs(lead(prev) OVER c - lag(prev) OVER c) e0
 FROM (SELECT f.image_id, f.y, f.x, f.g::DOUBLE cur, a.g::DOUBLE prev FROM fx_pixels f JOIN aligned a USING (image_id, y, x)) b WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
m0 AS (SELECT image_id, avg(cur) l1, avg(prev) l0, avg(e1) a, avg(e0) b, corr(e1, e0) sim, avg(((cur<=5) OR (cur>=250))::INT) k1, avg(((prev<=5) OR (prev>=250))::INT) k0 FROM pe GROUP BY 1),
metrics AS (SELECT m0.image_id, s.reason, greatest(0, 32-abs(dx))*greatest(0, 32-abs(dy))/1024.0::DOUBLE overlap_ratio, abs(l1-l0)/255 illumination_delta, l1 mean_luminance_t1, l0 mean_luminance_t0, a sharpness_t1, b sharpness_t0, greatest(a,b) sharpness_max, least(a,b)/greatest(a,b) sharpness_ratio, sim edge_similarity, k1 clipped_t1, k0 clipped_t0, greatest(k1,k0) clipped_max FROM m0 JOIN shifts s USING (image_id))"""


def metrics(fx):
    s = shifts(fx)
    return ops.pair_quality_metrics(fx.pixels, ops.apply_shift(previous(fx), fx.pixels, s), s, 32, 32)


NUM = ["overlap_ratio", "illumination_delta", "mean_luminance_t1", "mean_luminance_t0", "sharpness_t1", "sharpness_t0", "sharpness_max", "sharpness_ratio", "edge_similarity", "clipped_t1", "clipped_t0", "clipped_max"]


@query("c8_pair_quality_metrics", "SELECT image_id, reason, " + ", ".join(f"round({c}, 8) {c}" for c in NUM) + " FROM metrics", "fx_pixels", SCORES + ",\n" + BEST + ",\n" + METRICS)
def c8(fx):
    return metrics(fx).select("image_id", "reason", *[F.round(c, 8).alias(c) for c in NUM])


@query("c9_temporal_gate", """
SELECT image_id, array_to_string(issues, ',') issues, array_to_string(warnings, ',') warnings, CASE WHEN len(issues)>0 THEN 'fail' WHEN len(warnings)>0 THEN 'warning' ELSE 'pass' END status, len(issues)=0 validated FROM (
SELECT image_id, list_filter([CASE WHEN reason IN ('search_boundary_hit','registration_grid_mismatch','image_too_small') THEN 'registration_unreliable' END, CASE WHEN overlap_ratio<0.85 THEN 'insufficient_overlap' END, CASE WHEN illumination_delta>0.22 THEN 'illumination_mismatch' END,
 CASE WHEN sharpness_ratio<0.45 THEN 'sharpness_mismatch' END, CASE WHEN edge_similarity<0.35 THEN 'geometric_mismatch' END, CASE WHEN clipped_max>0.35 THEN 'exposure_clipping' END], lambda e: e IS NOT NULL) issues,
 list_filter([CASE WHEN overlap_ratio>=0.85 AND overlap_ratio<0.92 THEN 'reduced_overlap' END, CASE WHEN illumination_delta<=0.22 AND illumination_delta>0.12 THEN 'illumination_difference' END, CASE WHEN sharpness_ratio>=0.45 AND sharpness_ratio<0.65 THEN 'sharpness_difference' END,
 CASE WHEN edge_similarity>=0.35 AND edge_similarity<0.55 THEN 'geometric_consistency_low' END, CASE WHEN clipped_max<=0.35 AND clipped_max>0.2 THEN 'exposure_warning' END, CASE WHEN sharpness_max<3 THEN 'low_texture' END], lambda e: e IS NOT NULL) warnings FROM metrics) q""", "fx_pixels", SCORES + ",\n" + BEST + ",\n" + METRICS)
def c9(fx):
    out = ops.temporal_gate(metrics(fx))
    return out.select("image_id", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"), "status", "validated")


@query("c10_change_totals", "SELECT pair_id, sum(growth_px2)*0.0625 growth_total, sum(reduction_px2)*0.0625 reduction_total, true calibrated FROM stats GROUP BY 1", "fx_masks", FLAGS + ",\n" + STATS)
def c10(fx):
    return ops.change_totals(ops.mask_change(fx.masks, 0.25))
