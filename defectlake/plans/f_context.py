"""Registered queries: scene context (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import context as ops
from ..operators.raster import mask_algebra
from .base import query
from .e_raster import K, KEYS, erode_sql, labels_cte

# Fixed scene dictionary of the derived scene maps.
LABELS = "SELECT 0 class_id, 'wall; brick' label UNION ALL SELECT 1, 'Sky, clouds' UNION ALL SELECT 2, 'Bridge' UNION ALL SELECT 3, 'tree' UNION ALL SELECT 4, 'person ' UNION ALL SELECT 5, 'glass'"
CELLS = f"""lbl AS ({LABELS}),
scn AS (SELECT image_id, cell_y, cell_x, CASE WHEN image_id % 7 = 3 OR (image_id % 7 = 5 AND cell_y < 6) THEN 1 WHEN image_id % 7 = 5 THEN 0 ELSE class_id END class_id, CASE WHEN image_id % 7 IN (3, 5) THEN 1.0::DOUBLE ELSE conf END conf FROM fx_scene),
cells AS (SELECT s.*, l.label, CASE WHEN trim(regexp_extract(lower(label), '^[^,;]*')) IN ('wall','bridge') THEN 'structure' WHEN trim(regexp_extract(lower(label), '^[^,;]*')) IN ('sky','tree','person') THEN 'irrelevant' ELSE 'neutral' END scene_group FROM scn s JOIN lbl l USING (class_id)),
exc AS (SELECT image_id, cell_y, cell_x FROM cells WHERE scene_group='irrelevant' AND conf>=0.35),
abst AS (SELECT image_id FROM cells GROUP BY 1 HAVING count(*) FILTER (scene_group='irrelevant' AND conf>=0.35) > 0.9*count(*) AND count(*) FILTER (scene_group='structure') < 0.03*count(*)),
gexc AS (SELECT * FROM exc ANTI JOIN abst USING (image_id))"""
MASK = "mk AS (SELECT DISTINCT pair_id image_id, damage_class, epoch, y, x FROM fx_masks)"
MK = "image_id, damage_class, epoch"
MKEYS = ["image_id", "damage_class", "epoch"]
GRID, SIZE = (8, 8), (32, 32)


def cells(fx):
    labels = fx.spark.sql(LABELS).withColumn("class_id", F.col("class_id").cast("long"))
    # Every seventh scene is all sky, so that gating abstains there; another seventh is wall below sky, which leaves an interior to cut.
    turn = F.col("image_id") % 7
    sky = (turn == 3) | ((turn == 5) & (F.col("cell_y") < 6))
    cls = F.when(sky, 1).when(turn == 5, 0).otherwise(F.col("class_id")).cast("long")
    scene = fx.scene.withColumn("class_id", cls).withColumn("conf", F.when(turn.isin(3, 5), 1.0).otherwise(F.col("conf")))
    return ops.with_groups(scene, labels)


def masks(fx):
    return fx.masks.withColumnRenamed("pair_id", "image_id")


def labelled(fx):
    return C.label_components(masks(fx), MKEYS)


@query("f1_scene_group", "SELECT image_id, label, scene_group, count(*) n FROM cells GROUP BY 1,2,3", "fx_scene", CELLS)
def f1(fx):
    return cells(fx).groupBy("image_id", "label", "scene_group").agg(F.count(F.lit(1)).alias("n"))


@query("f2_exclusion_mask", "SELECT 'conservative' AS \"mode\", * FROM exc UNION ALL SELECT 'strict', image_id, cell_y, cell_x FROM cells WHERE scene_group<>'structure' AND conf>=0.35", "fx_scene", CELLS)
def f2(fx):
    part = lambda m: ops.exclusion_mask(cells(fx), m).select(F.lit(m).alias("mode"), "image_id", "cell_y", "cell_x")
    return part("conservative").unionByName(part("strict"))


@query("f3_scene_summary", """
SELECT image_id, cells, round(x/cells, 9) excluded_ratio, round(s/cells, 9) structure_ratio, x/cells>0.9 AND s/cells<0.03 abstained, top FROM (SELECT image_id, sum(n)::BIGINT cells, sum(x) x, sum(s) s, array_to_string(list(concat(label, ':', n) ORDER BY -n, class_id)[:8], ',') top FROM (
 SELECT image_id, class_id, label, count(*) n, count(*) FILTER (scene_group='irrelevant' AND conf>=0.35) x, count(*) FILTER (scene_group='structure') s FROM cells GROUP BY 1,2,3) p GROUP BY 1) q""", "fx_scene", CELLS)
def f3(fx):
    out = ops.scene_summary(cells(fx))
    top = F.transform("top_classes", lambda t: F.concat(t["label"], F.lit(":"), F.round(t["share"] * F.col("cells")).cast("long").cast("string")))
    return out.select("image_id", "cells", F.round("excluded_ratio", 9).alias("excluded_ratio"), F.round("structure_ratio", 9).alias("structure_ratio"), "abstained", F.array_join(top, ",").alias("top"))


GATE = MASK + ",\n" + labels_cte("mk", MK) + f""",
gate AS (SELECT {", ".join("l." + k.strip() for k in MK.split(","))}, l.label, count(*) area, count(e.image_id) inside, count(e.image_id) >= 0.6*count(*) removed FROM lab l LEFT JOIN gexc e ON e.image_id=l.image_id AND e.cell_y=least(7, CAST(floor((l.y+0.5)*8/32) AS BIGINT)) AND e.cell_x=least(7, CAST(floor((l.x+0.5)*8/32) AS BIGINT)) GROUP BY 1,2,3,4)"""


@query("f4_gate_components", "SELECT * FROM gate", "fx_masks fx_scene", CELLS + ",\n" + GATE)
def f4(fx):
    return ops.gate_components(labelled(fx), ops.gating_mask(cells(fx)), MKEYS, GRID, SIZE)


@query("f4_gate_summary", f"SELECT {MK}, count(*) FILTER (removed) removed, count(*) FILTER (NOT removed) kept, coalesce(sum(area) FILTER (removed), 0)::BIGINT removed_px FROM gate GROUP BY {MK}", "fx_masks fx_scene", CELLS + ",\n" + GATE)
def f4b(fx):
    return ops.gate_summary(ops.gate_components(labelled(fx), ops.gating_mask(cells(fx)), MKEYS, GRID, SIZE), MKEYS)


# Coarse scene grid (2 x 2 blocks of 16 pixels) so the erosion by 1.5 cells leaves an interior only where blocks join.
CLIP = CELLS + ",\n" + MASK + """,
ep AS (SELECT image_id, cell_y*4+dy y, cell_x*4+dx x FROM gexc CROSS JOIN (SELECT unnest(range(0,4)) dy) a CROSS JOIN (SELECT unnest(range(0,4)) dx) b),
""" + erode_sql("ep", "image_id", "core", 6) + f""",
area AS (SELECT * FROM mk WHERE damage_class<>'cracks'),
kept AS (SELECT m.* FROM area m ANTI JOIN core c USING (image_id, y, x)),
cut AS (SELECT DISTINCT {MK} FROM area m SEMI JOIN core c USING (image_id, y, x)),
kc AS (SELECT k.* FROM kept k SEMI JOIN cut USING ({MK})),
""" + erode_sql("kc", MK, "ke") + f""",
clip AS (SELECT {MK}, y, x FROM mk WHERE damage_class='cracks' UNION ALL SELECT {MK}, y, x FROM kept k ANTI JOIN cut USING ({MK}) UNION ALL SELECT DISTINCT {MK}, y+dy, x+dx FROM ke CROSS JOIN (SELECT unnest(range(-1,2)) dy) a CROSS JOIN (SELECT unnest(range(-1,2)) dx) b WHERE y+dy BETWEEN 0 AND 31 AND x+dx BETWEEN 0 AND 31)"""


@query("f5_clip_by_context", f"SELECT {MK}, y, x FROM clip", "fx_masks fx_scene", CLIP)
def f5(fx):
    return ops.clip_by_context(masks(fx).select(*MKEYS, "y", "x").distinct(), ops.gating_mask(cells(fx)), MKEYS, GRID, SIZE).select(*MKEYS, "y", "x")


@query("f6_scene_of", f"""
SELECT {MK}, label_id, arg_min(label, (-k, class_id)) scene, round(max(k)/sum(k), 9) share, round(sum(x)/sum(k), 9) irrelevant_share FROM (SELECT {", ".join("l." + k.strip() for k in MK.split(","))}, l.label label_id, c.class_id, c.label, count(*) k, count(*) FILTER (c.scene_group='irrelevant' AND c.conf>=0.35) x
 FROM lab l JOIN cells c ON c.image_id=l.image_id AND c.cell_y=l.y//4 AND c.cell_x=l.x//4 GROUP BY 1,2,3,4,5,6) q GROUP BY {MK}, label_id""", "fx_masks fx_scene", CELLS + ",\n" + MASK + ",\n" + labels_cte("mk", MK))
def f6(fx):
    out = ops.scene_of(labelled(fx).withColumnRenamed("label", "label_id"), cells(fx), MKEYS, GRID, SIZE)
    return out.withColumn("share", F.round("share", 9)).withColumn("irrelevant_share", F.round("irrelevant_share", 9))


@query("f7_scene_objects", """
SELECT image_id, class_id, scene_label AS label, scene_group, rank, round(share, 9) share, round((cx+0.5)*100, 6) center_x, round((cy+0.5)*75, 6) center_y, x0*100.0::DOUBLE bbox_x, y0*75.0::DOUBLE bbox_y, (x1-x0+1)*100.0::DOUBLE bbox_w, (y1-y0+1)*75.0::DOUBLE bbox_h FROM (
SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY share DESC, region, class_id) rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY share DESC, region) rc FROM (
SELECT l.image_id, l.class_id, l.label region, count(*)/any_value(t.cells) share, avg(x) cx, avg(y) cy, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM lab l JOIN (SELECT image_id, count(*) cells FROM cells GROUP BY 1) t USING (image_id) GROUP BY 1,2,3) a WHERE share>=0.004) b WHERE rc<=4) c
JOIN (SELECT DISTINCT image_id, class_id, label scene_label, scene_group FROM cells) n USING (image_id, class_id) WHERE rank<=24""", "fx_scene", CELLS + ",\nsm AS (SELECT image_id, class_id, cell_y y, cell_x x FROM cells),\n" + labels_cte("sm", "image_id, class_id", 4))
def f7(fx):
    out = ops.scene_objects(cells(fx), GRID, (600, 800))
    return out.withColumn("share", F.round("share", 9)).withColumn("center_x", F.round("center_x", 6)).withColumn("center_y", F.round("center_y", 6))


@query("f8_discarded_records", f"""
SELECT {MK}, label, area, rank, concat('IA', rank) code FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, {MK}, label) rank FROM (SELECT {MK}, label, count(*) area FROM lab GROUP BY {MK}, label) a) b""", "fx_masks fx_scene",
       CELLS + ",\n" + MASK + f",\ngone AS (SELECT m.* FROM mk m SEMI JOIN gexc e ON e.image_id=m.image_id AND e.cell_y=m.y//4 AND e.cell_x=m.x//4),\n" + labels_cte("gone", MK))
def f8(fx):
    before = masks(fx).select(*MKEYS, "y", "x").distinct()
    full = ops.gating_mask(cells(fx)).withColumn("y", F.explode(F.sequence(F.col("cell_y") * 4, F.col("cell_y") * 4 + 3))).withColumn("x", F.explode(F.sequence(F.col("cell_x") * 4, F.col("cell_x") * 4 + 3)))
    after = mask_algebra(before, full, "and_not", ["image_id"]).select("image_id", "y", "x")
    kept = before.join(after, ["image_id", "y", "x"], "left_semi")
    return ops.discarded_records(before, kept, MKEYS).select(*MKEYS, "label", "area", "rank", "code")
