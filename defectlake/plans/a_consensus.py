"""Registered queries: catalog (P), taxonomy and consensus (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.taxonomy import ALIASES, DISPLAY, canonicalize, clean_label, display_name
from ..operators import catalog as cat
from ..operators import consensus as con
from .base import query

CLEAN = "regexp_replace(translate(regexp_replace(lower(coalesce(label,'')), '^\\s+|\\s+$', '', 'g'), '-_', '  '), '\\s+', ' ', 'g')"
CANON = ("CASE " + " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " "
         + " ".join(f"WHEN contains(c, '{k}') THEN '{v}'" for k, v in ALIASES.items() if "_" not in k)
         + " WHEN c = '' THEN 'unknown' ELSE replace(c, ' ', '_') END")
SHOW = ("CASE canonical_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY.items())
        + " ELSE array_to_string(list_transform(string_split(canonical_label, '_'), lambda w: concat(upper(w[1]), w[2:])), ' ') END")


def det_ctes(source: str = "fx_detections") -> str:
    return (f"cleaned AS (SELECT *, {CLEAN} c FROM {source}),\n"
            f"dets AS (SELECT *, {CANON} canonical_label FROM cleaned)")


OK = "ok AS (SELECT image_id, count(DISTINCT engine_id) successful_engine_count FROM fx_runs WHERE status='ok' GROUP BY image_id)"


@query("p1_rank_engines", "SELECT id, name, CASE WHEN id='cdm_1' THEN 0 WHEN catalog_owned THEN 1 WHEN catalog_visibility='always' THEN 2 WHEN browser_ready THEN 3 WHEN recommended THEN 4 ELSE 5 END::BIGINT priority FROM fx_catalog", "fx_catalog")
def p1(fx):
    return cat.rank_engines(fx.catalog).select("id", "name", "priority")


@query("p2_filter_engines", """
SELECT 'all' AS "mode", id FROM fx_catalog UNION ALL SELECT 'owned', id FROM fx_catalog WHERE catalog_owned
UNION ALL SELECT 'recommended', id FROM fx_catalog WHERE recommended UNION ALL SELECT 'verified', id FROM fx_catalog WHERE cloud_verified
UNION ALL SELECT 'browser', id FROM fx_catalog WHERE browser_ready UNION ALL SELECT 'public', id FROM fx_catalog WHERE domain_mode='public_shm_checkpoint'
UNION ALL SELECT 'optional', id FROM fx_catalog WHERE domain_mode IN ('optional_runtime','shm_checkpoint','generic_pretrained')""", "fx_catalog")
def p2(fx):
    out = None
    for mode in ("all", "owned", "recommended", "verified", "browser", "public", "optional"):
        part = cat.filter_engines(fx.catalog, mode).select(F.lit(mode).alias("mode"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("p3_search_engines", "SELECT id, name FROM fx_catalog WHERE contains(lower(concat_ws(' ', nullif(name,''), nullif(family,''), task, nullif(description,''), domain_mode, catalog_group)), 'segmentation') OR contains(lower(concat_ws(' ', nullif(name,''), nullif(family,''), task, nullif(description,''), domain_mode, catalog_group)), 'steel')", "fx_catalog")
def p3(fx):
    both = cat.search_engines(fx.catalog, " Segmentation ").unionByName(cat.search_engines(fx.catalog, "STEEL"))
    return both.select("id", "name").distinct()


@query("p4_engine_kpis", """
SELECT r.*, coalesce(d.n, 0) detections FROM (SELECT image_id, count(*) engines_total, count(*) FILTER (status='ok') engines_ok, count(*) FILTER (status<>'ok') engines_failed FROM fx_runs GROUP BY 1) r
LEFT JOIN (SELECT image_id, count(*) n FROM fx_detections_anon GROUP BY 1) d USING (image_id)""", "fx_runs fx_detections_anon")
def p4(fx):
    return cat.engine_kpis(fx.runs, fx.detections_anon)


@query("a1_clean_label", f"SELECT label, {CLEAN} clean, count(*) n FROM fx_detections_anon GROUP BY 1, 2", "fx_detections_anon")
def a1(fx):
    return fx.detections_anon.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", clean_label(F.col("label")).alias("clean"), "n")


@query("a2_canonicalize", "SELECT image_id, canonical_label, count(*) n FROM dets GROUP BY 1, 2", "fx_detections_anon", det_ctes("fx_detections_anon"))
def a2(fx):
    return fx.detections_anon.groupBy("image_id", canonicalize(F.col("label")).alias("canonical_label")).agg(F.count(F.lit(1)).alias("n"))


@query("a3_display_name", f"SELECT canonical_label, {SHOW} label, count(*) n FROM dets GROUP BY 1, 2", "fx_detections_anon", det_ctes("fx_detections_anon"))
def a3(fx):
    rows = fx.detections_anon.groupBy(canonicalize(F.col("label")).alias("canonical_label")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("canonical_label", display_name(F.col("canonical_label")).alias("label"), "n")


@query("a4_label_consensus", f"""
SELECT g.image_id, canonical_label, {SHOW} label, engines, engine_count, successful_engine_count, round(engine_count/successful_engine_count, 9) agreement_ratio, detections, mean_score
FROM (SELECT d.image_id, canonical_label, array_to_string(list_sort(list(DISTINCT d.engine_id)), ',') engines, count(DISTINCT d.engine_id) engine_count, count(*) detections, round(avg(score), 9) mean_score
 FROM dets d JOIN fx_runs r ON d.image_id=r.image_id AND d.engine_id=r.engine_id AND r.status='ok' GROUP BY 1, 2) g JOIN ok USING (image_id)""",
       "fx_runs fx_detections_anon", det_ctes("fx_detections_anon") + ",\n" + OK)
def a4(fx):
    out = con.label_consensus(fx.runs, fx.detections_anon)
    return (out.withColumn("engines", F.array_join("engines", ",")).withColumn("agreement_ratio", F.round("agreement_ratio", 9))
            .withColumn("mean_score", F.round("mean_score", 9)))


_IOU = """(greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)))"""
_AREA = "(greatest(0,{t}.x2-{t}.x1)*greatest(0,{t}.y2-{t}.y1))"
IOU_SQL = f"{_IOU}/nullif({_AREA.format(t='a')}+{_AREA.format(t='b')}-{_IOU}, 0)"


@query("a5_box_iou", f"""
SELECT image_id, count(*) n, round(sum(coalesce({IOU_SQL}, 0)), 6) iou_sum FROM fx_detections_anon a, (SELECT 100.0::DOUBLE x1, 60.0::DOUBLE y1, 180.0::DOUBLE x2, 130.0::DOUBLE y2) b GROUP BY 1""", "fx_detections_anon")
def a5(fx):
    from ..functions.geometry import box_iou
    iou = box_iou([F.col(c) for c in con.BOX], [F.lit(v) for v in (100.0, 60.0, 180.0, 130.0)])
    return fx.detections_anon.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(iou), 6).alias("iou_sum"))


@query("a6_pairwise_iou", f"""
SELECT image_id, canonical_label, count(*) pairs, round(sum(iou), 6) iou_sum, round(max(iou), 9) iou_max FROM (
 SELECT a.image_id, a.canonical_label, {IOU_SQL} iou FROM dets a JOIN dets b ON a.image_id=b.image_id AND a.canonical_label=b.canonical_label AND a.det_id<b.det_id) p
WHERE iou >= 0.25 GROUP BY 1, 2""", "fx_detections", det_ctes())
def a6(fx):
    totals = con.iou_totals(fx.detections_anon, 0.25)
    return totals.select("image_id", "canonical_label", "pairs", F.round("iou_sum", 6).alias("iou_sum"), F.round("iou_max", 9).alias("iou_max"))


# Sequential clustering row by row: a cluster is its sums and its mean box to two digits.
_OVER = "(greatest(0, least(c.m[3], {b}.x2)-greatest(c.m[1], {b}.x1))*greatest(0, least(c.m[4], {b}.y2)-greatest(c.m[2], {b}.y1)))"
_FIT = "list_transform(f.cl, lambda c: coalesce(" + _OVER.format(b="n") + "/nullif(greatest(0, c.m[3]-c.m[1])*greatest(0, c.m[4]-c.m[2])+greatest(0, n.x2-n.x1)*greatest(0, n.y2-n.y1)-" + _OVER.format(b="n") + ", 0), 0))"
_MEAN = "{{'n': {n}, 's': {s}, 'm': list_transform({s}, lambda v: round_even(v/({n}), 2))}}"
CLUSTERS = """sq AS (SELECT d.image_id, canonical_label, det_id, d.engine_id, score, x1, y1, x2, y2, row_number() OVER (PARTITION BY d.image_id, canonical_label ORDER BY coalesce(score, -1) DESC, det_id) k
 FROM dets d JOIN fx_runs r ON d.image_id=r.image_id AND d.engine_id=r.engine_id AND r.status='ok'),
cf AS /* RECURSIVE */ (SELECT image_id, canonical_label, k, 1::BIGINT cluster, [""" + _MEAN.format(n="1::BIGINT", s="[x1, y1, x2, y2]") + """] cl FROM sq WHERE k=1
 UNION ALL SELECT image_id, canonical_label, k, CASE WHEN hit > 0 THEN hit ELSE len(cl)+1 END,
  CASE WHEN hit > 0 THEN list_transform(cl, lambda c, i: CASE WHEN i=hit THEN """ + _MEAN.format(n="c.n+1", s="[c.s[1]+x1, c.s[2]+y1, c.s[3]+x2, c.s[4]+y2]") + """ ELSE c END) ELSE list_append(cl, """ + _MEAN.format(n="1::BIGINT", s="[x1, y1, x2, y2]") + """) END
  FROM (SELECT *, CASE WHEN list_max(fit) > 0 AND list_max(fit) >= 0.25 THEN list_position(fit, list_max(fit)) ELSE 0 END::BIGINT hit FROM (
   SELECT n.*, f.cl, """ + _FIT + """ fit FROM cf f JOIN sq n ON n.image_id=f.image_id AND n.canonical_label=f.canonical_label AND n.k=f.k+1) a) b)"""


@query("a7_spatial_consensus", """
SELECT image_id, canonical_label, round(g.x1, 6) x1, round(g.y1, 6) y1, round(g.x2, 6) x2, round(g.y2, 6) y2, engines, detections, round(mean_score, 9) mean_score, engine_count, successful_engine_count,
 round(engine_count/successful_engine_count, 9) agreement_ratio, row_number() OVER (PARTITION BY image_id ORDER BY seed_s, seed_d) cluster_id
FROM (SELECT image_id, canonical_label, cluster, avg(x1) x1, avg(y1) y1, avg(x2) x2, avg(y2) y2, array_to_string(list_sort(list(DISTINCT engine_id)), ',') engines, count(DISTINCT engine_id) engine_count, count(*) detections, avg(score) mean_score,
 min(-coalesce(score,-1)) seed_s, arg_min(det_id, (-coalesce(score,-1), det_id)) seed_d FROM sq JOIN cf USING (image_id, canonical_label, k) GROUP BY 1,2,3) g JOIN ok USING (image_id)""",
       "fx_runs fx_detections", det_ctes() + ",\n" + OK + ",\n" + CLUSTERS)
def a7(fx):
    out = con.spatial_consensus(fx.runs, fx.detections).withColumn("engines", F.array_join("engines", ",")).withColumn("mean_score", F.round("mean_score", 9))
    for c in con.BOX:
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("agreement_ratio", F.round("agreement_ratio", 9))


@query("a8_cluster_summary", """
SELECT image_id, canonical_label, gx, gy, round(g.x1, 6) x1, round(g.y1, 6) y1, round(g.x2, 6) x2, round(g.y2, 6) y2, engines, detections, round(mean_score, 9) mean_score, engine_count, successful_engine_count,
 round(engine_count/successful_engine_count, 9) agreement_ratio, row_number() OVER (PARTITION BY image_id ORDER BY seed_s, seed_d) cluster_id
FROM (SELECT image_id, canonical_label, gx, gy, avg(x1) x1, avg(y1) y1, avg(x2) x2, avg(y2) y2, array_to_string(list_sort(list(DISTINCT engine_id)), ',') engines, count(DISTINCT engine_id) engine_count, count(*) detections, avg(score) mean_score,
 min(-coalesce(score,-1)) seed_s, arg_min(det_id, (-coalesce(score,-1), det_id)) seed_d
 FROM (SELECT d.*, CAST(floor(x1/100) AS BIGINT) gx, CAST(floor(y1/90) AS BIGINT) gy FROM dets d JOIN fx_runs r ON d.image_id=r.image_id AND d.engine_id=r.engine_id AND r.status='ok') m GROUP BY 1,2,3,4) g JOIN ok USING (image_id)""",
       "fx_runs fx_detections", det_ctes() + ",\n" + OK)
def a8(fx):
    members = con.with_canonical(fx.detections).join(con.successful(fx.runs), ["image_id", "engine_id"], "left_semi")
    members = members.withColumn("gx", F.floor(F.col("x1") / 100)).withColumn("gy", F.floor(F.col("y1") / 90))
    out = con.cluster_summary(members, fx.runs, ["image_id", "canonical_label", "gx", "gy"])
    out = out.withColumn("engines", F.array_join("engines", ",")).withColumn("mean_score", F.round("mean_score", 9))
    for c in con.BOX:
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("agreement_ratio", F.round("agreement_ratio", 9))


@query("a9_top_detections", """
SELECT image_id, det_id, engine_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY coalesce(score,0) DESC, det_id) rank FROM fx_detections) t WHERE rank <= 20""", "fx_detections")
def a9(fx):
    return con.top_detections(fx.detections, 20).select("image_id", "det_id", "engine_id", "label", "score", "rank")
