"""Registered queries: damage records and condition rating (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rating as R
from ..functions.rating import RatingConfig
from ..operators import rating as ops
from .base import query

AREA = 1600 * 1200
ENV = RatingConfig(environment="high", excluded=("efflorescence_white",), relevance=0.0, allow_emergency=True)


def rated_cte(source: str, ident: str, env: float = 1.0, excluded: str = "") -> str:
    inc = f"damage_class NOT IN ({excluded})" if excluded else "true"
    return f"""rated0 AS (SELECT {ident} image_id, damage_class, area_px2, length_px, width_px, mm_per_px, area_px2/{AREA}.0::DOUBLE area_ratio,
 length_px/sqrt({AREA}.0::DOUBLE) density, width_px*mm_per_px w_mm FROM {source} WHERE time_label='t1_current'),
rated1 AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, {env}::DOUBLE * CASE damage_class
  WHEN 'cracks' THEN 0.65::DOUBLE*least(1.0::DOUBLE, coalesce(w_mm, width_px/8)) + 0.35::DOUBLE*least(1.0::DOUBLE, density/0.30::DOUBLE)
  WHEN 'spalling_dark' THEN least(1.0::DOUBLE, area_ratio/0.0150::DOUBLE) WHEN 'exposed_rebar' THEN greatest(0.35::DOUBLE, least(1.0::DOUBLE, area_ratio/0.0015::DOUBLE))
  WHEN 'corrosion_rust' THEN least(1.0::DOUBLE, area_ratio/0.0150::DOUBLE) ELSE least(1.0::DOUBLE, area_ratio/0.0100::DOUBLE) END)) s_img,
 CASE damage_class WHEN 'spalling_dark' THEN CASE WHEN area_ratio<=0.0005 THEN 1 WHEN area_ratio<=0.003 THEN 2 WHEN area_ratio<=0.015 THEN 3 ELSE 4 END
  WHEN 'exposed_rebar' THEN CASE WHEN area_ratio<=0.0002 THEN 2 WHEN area_ratio<=0.0015 THEN 3 ELSE 4 END
  WHEN 'corrosion_rust' THEN CASE WHEN area_ratio<=0.0005 THEN 1 WHEN area_ratio<=0.003 THEN 2 WHEN area_ratio<=0.015 THEN 3 ELSE 4 END
  WHEN 'efflorescence_white' THEN CASE WHEN area_ratio<=0.001 THEN 1 WHEN area_ratio<=0.01 THEN 2 ELSE 3 END
  ELSE CASE WHEN w_mm IS NOT NULL THEN CASE WHEN w_mm<=0.2 AND density<=0.05 THEN 1 WHEN w_mm<=0.4 AND density<=0.12 THEN 2 WHEN w_mm<=1 AND density<=0.3 THEN 3 ELSE 4 END
   ELSE CASE WHEN width_px<=2 AND density<=0.05 THEN 1 WHEN width_px<=4 AND density<=0.12 THEN 2 WHEN width_px<=8 AND density<=0.3 THEN 3 ELSE 4 END END END::DOUBLE fi,
 CASE damage_class WHEN 'cracks' THEN 3 WHEN 'spalling_dark' THEN 4 WHEN 'exposed_rebar' THEN 5 WHEN 'corrosion_rust' THEN 5 ELSE 2 END::DOUBLE fp FROM rated0),
rated AS (SELECT *, CASE WHEN fi<=2 THEN 0.8::DOUBLE*fi*fp ELSE (12*fi-28)*fp END d, (1 + (s_img>=0.25)::INT + (s_img>=0.5)::INT + (s_img>=0.75)::INT)::BIGINT ec_rank, {inc} included FROM rated1)"""


EC_NAME = "CASE {0} WHEN 4 THEN 'Bom' WHEN 3 THEN 'Razoável' WHEN 2 THEN 'Ruim' ELSE 'Severo' END"
SUMS = """sums AS (SELECT i.image_id, coalesce(max(d) FILTER (included AND d>0), 0) d_max, coalesce(sum(d) FILTER (included AND d>0), 0) d_sum, coalesce(max(ec_rank) FILTER (included), 0) max_rank,
 count(*) FILTER (included) n, coalesce(sum(area_ratio) FILTER (included), 0) aar, coalesce(max(s_img) FILTER (included), 0) s_max, coalesce(max(fi) FILTER (included), 0) fi_max,
 coalesce(max(s_img) FILTER (included AND damage_class='exposed_rebar'), 0) rebar_s FROM (SELECT DISTINCT image_id FROM fx_records_anon) i LEFT JOIN rated r USING (image_id) GROUP BY 1)"""


def images(fx):
    return fx.records_anon.select("image_id").distinct()


def rated(fx, cfg=RatingConfig(), ids=False):
    return ops.rate_damages(fx.records if ids else fx.records_anon, F.lit(AREA), cfg)


@query("b1_resolve_scale", """
SELECT mm_per_px, round(CASE WHEN mm_per_px > 0 THEN mm_per_px ELSE bbox_w/nullif(length_px, 0) END, 9) scale, count(*) n FROM fx_records_anon GROUP BY 1, 2""", "fx_records_anon")
def b1(fx):
    mode = F.when(F.col("mm_per_px") > 0, "manual_mm_per_px").otherwise("reference_length")
    scale = R.resolve_scale(mode, F.col("mm_per_px"), F.col("length_px"), F.col("bbox_w").cast("double"))
    return fx.records_anon.groupBy("mm_per_px", F.round(scale, 9).alias("scale")).agg(F.count(F.lit(1)).alias("n"))


@query("b2_to_mm", """
SELECT record_id, round(area_px2*mm_per_px*mm_per_px, 6) area_mm2, round(area_px2*mm_per_px*mm_per_px/100, 6) area_cm2, round(perimeter_px*mm_per_px, 6) perimeter_mm, round(length_px*mm_per_px, 6) length_mm, round(width_px*mm_per_px, 6) width_mm FROM fx_records""", "fx_records")
def b2(fx):
    out = ops.to_mm(fx.records)
    return out.select("record_id", *[F.round(c, 6).alias(c) for c in ("area_mm2", "area_cm2", "perimeter_mm", "length_mm", "width_mm")])


@query("b3_damage_factor", "SELECT image_id, damage_class, fi, count(*) n FROM rated GROUP BY 1,2,3", "fx_records_anon", rated_cte("fx_records_anon", ""))
def b3(fx):
    return rated(fx).groupBy("image_id", "damage_class", "fi").agg(F.count(F.lit(1)).alias("n"))


@query("b4_damage_index", "SELECT damage_class, fi, fp, round(d, 6) d, count(*) n FROM rated GROUP BY 1,2,3,4", "fx_records_anon", rated_cte("fx_records_anon", ""))
def b4(fx):
    return rated(fx).groupBy("damage_class", "fi", "fp", F.round("d", 6).alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("b5_severity", "SELECT image_id, damage_class, round(sum(s_img), 12) s_sum, round(max(s_img), 9) s_max, round(min(s_img), 9) s_min FROM rated GROUP BY 1,2", "fx_records_anon", rated_cte("fx_records_anon", "", 1.10))
def b5(fx):
    return rated(fx, ENV).groupBy("image_id", "damage_class").agg(F.round(F.sum("s_img"), 12).alias("s_sum"), F.round(F.max("s_img"), 9).alias("s_max"), F.round(F.min("s_img"), 9).alias("s_min"))


@query("b6_ordinal_rank", f"SELECT damage_class, ec_rank, 5-ec_rank ec, {EC_NAME.format('5-ec_rank')} ec_label, count(*) n FROM rated GROUP BY 1,2,3,4", "fx_records_anon", rated_cte("fx_records_anon", ""))
def b6(fx):
    return rated(fx).groupBy("damage_class", "ec_rank", "ec", "ec_label").agg(F.count(F.lit(1)).alias("n"))


@query("b7_rate_damages", f"SELECT record_id, image_id, damage_class, round(area_ratio, 12) area_ratio, round(s_img, 9) s_img, ec_rank, 5-ec_rank ec, {EC_NAME.format('5-ec_rank')} ec_label, fi, fp, round(d, 6) d, included FROM rated", "fx_records", rated_cte("fx_records", "record_id,", 1.10, "'efflorescence_white'"))
def b7(fx):
    return rated(fx, ENV, True).select("record_id", "image_id", "damage_class", F.round("area_ratio", 12).alias("area_ratio"), F.round("s_img", 9).alias("s_img"),
                                       "ec_rank", "ec", "ec_label", "fi", "fp", F.round("d", 6).alias("d"), "included")


@query("b8_family_summary", f"""
SELECT *, 5-greatest(family_rank, 1) family_ec, {EC_NAME.format('5-greatest(family_rank,1)')} family_ec_label, true included FROM (
SELECT image_id, damage_class, n, round(ars, 12) area_ratio_sum, round(s_max, 9) s_max, round(s_mean, 12) s_mean, fi_max, round(d_sum, 6) d_sum, governing_record_id,
 CASE WHEN mr>0 AND (n>=5 OR ars>=0.015) THEN 1 ELSE 0 END::BIGINT delta_family, CASE WHEN mr>0 THEN least(4, mr + CASE WHEN n>=5 OR ars>=0.015 THEN 1 ELSE 0 END) ELSE 0 END::BIGINT family_rank FROM (
 SELECT g.image_id, g.damage_class, count(r.record_id) n, coalesce(sum(area_ratio), 0) ars, coalesce(max(s_img), 0) s_max, coalesce(avg(s_img), 0) s_mean, coalesce(max(fi), 0) fi_max, coalesce(sum(d), 0) d_sum, coalesce(max(ec_rank), 0) mr,
  coalesce(arg_min(record_id, (-ec_rank, -s_img, -d, record_id)), '') governing_record_id
 FROM (SELECT DISTINCT image_id, unnest(['cracks','spalling_dark','exposed_rebar','corrosion_rust','efflorescence_white']) damage_class FROM fx_records) g LEFT JOIN rated r ON g.image_id=r.image_id AND g.damage_class=r.damage_class GROUP BY 1,2) q) z""", "fx_records", rated_cte("fx_records", "record_id,"))
def b8(fx):
    out = ops.family_summary(images(fx), rated(fx, ids=True))
    return (out.withColumn("area_ratio_sum", F.round("area_ratio_sum", 12)).withColumn("s_max", F.round("s_max", 9)).withColumn("s_mean", F.round("s_mean", 12))
            .withColumn("d_sum", F.round("d_sum", 6)))


@query("b9_gde", """
SELECT image_id, round(d_max, 6) d_max, round(d_sum, 6) d_sum, round(g, 6) gde, CASE WHEN g<=15 THEN 'Baixo' WHEN g<=50 THEN 'Médio' WHEN g<=80 THEN 'Alto' WHEN g<=100 THEN 'Sofrível' ELSE 'Crítico' END gde_level,
 CASE WHEN g<=15 THEN 'Estado aceitável; manutenção preventiva.' WHEN g<=50 THEN 'Planejar nova inspeção e intervenção em longo prazo.' WHEN g<=80 THEN 'Planejar inspeção especializada e intervenção em médio prazo.' WHEN g<=100 THEN 'Inspeção especializada rigorosa e intervenção em curto prazo.' ELSE 'Inspeção especializada imediata e medidas emergenciais.' END gde_action, round(g*4, 6) k
FROM (SELECT *, CASE WHEN d_sum>0 THEN d_max*(1+(d_sum-d_max)/d_sum) ELSE 0 END g FROM sums) q""", "fx_records_anon", rated_cte("fx_records_anon", "", 1.10, "'efflorescence_white'") + ",\n" + SUMS)
def b9(fx):
    out = ops.gde(images(fx), rated(fx, ENV), ENV)
    return out.select("image_id", *[F.round(c, 6).alias(c) for c in ("d_max", "d_sum", "gde", "k")], "gde_level", "gde_action")


@query("b10_element_rating", f"""
SELECT image_id, n, round(aar, 12) affected_area_ratio, round(s_max, 9) s_max, fi_max, delta, element_rank, 5-greatest(1, element_rank) ec, {EC_NAME.format('5-greatest(1,element_rank)')} ec_label, critical_element, structure_rank, nt,
 CASE nt WHEN 5 THEN 'Excelente/sem dano detectado' WHEN 4 THEN 'Boa' WHEN 3 THEN 'Regular' WHEN 2 THEN 'Ruim' WHEN 1 THEN 'Crítica' ELSE 'Emergencial' END nt_label FROM (
SELECT *, CASE WHEN element_rank=0 THEN 5 WHEN s_max>=0.95 AND rebar_s>=0.9 AND aar>=0.003 THEN 0 ELSE 5-structure_rank END::BIGINT nt FROM (
SELECT *, false critical_element, CASE WHEN element_rank=0 THEN 0 WHEN element_rank<4 THEN greatest(1, element_rank-1) ELSE 3 END::BIGINT structure_rank FROM (
SELECT *, CASE WHEN max_rank>0 THEN least(4, max_rank+delta) ELSE 0 END::BIGINT element_rank FROM (
SELECT *, CASE WHEN max_rank>0 AND (n>=5 OR aar>=0.015) THEN 1 ELSE 0 END::BIGINT delta FROM sums) a) b) c) d""", "fx_records_anon", rated_cte("fx_records_anon", "", 1.10, "'efflorescence_white'") + ",\n" + SUMS)
def b10(fx):
    cfg = RatingConfig(environment="high", excluded=("efflorescence_white",), relevance=0.0, element_family="transversinas_cortinas_alas", allow_emergency=True)
    out = ops.element_rating(images(fx), rated(fx, cfg), cfg)
    return out.withColumn("affected_area_ratio", F.round("affected_area_ratio", 12)).withColumn("s_max", F.round("s_max", 9))


@query("b11_summarize_records", """
SELECT image_id, count(*) total_objects, count(*) FILTER (damage_class='cracks') n_cracks, count(*) FILTER (damage_class='spalling_dark') n_spalling_dark, count(*) FILTER (damage_class='exposed_rebar') n_exposed_rebar, count(*) FILTER (damage_class='corrosion_rust') n_corrosion_rust, count(*) FILTER (damage_class='efflorescence_white') n_efflorescence_white,
 coalesce(sum(area_px2) FILTER (damage_class='spalling_dark'), 0) spalling_area_px2, coalesce(sum(area_px2) FILTER (damage_class='exposed_rebar'), 0) rebar_area_px2, coalesce(sum(length_px) FILTER (damage_class='cracks'), 0) crack_length_total_px,
 round(coalesce(avg(length_px) FILTER (damage_class='cracks'), 0), 9) crack_length_mean_px, round(coalesce(avg(width_px) FILTER (damage_class='cracks' AND width_px>0), 0), 9) crack_width_mean_px, coalesce(max(width_px) FILTER (damage_class='cracks' AND width_px>0), 0) crack_width_max_px FROM fx_records_anon GROUP BY 1""", "fx_records_anon")
def b11(fx):
    out = ops.summarize_records(fx.records_anon)
    return out.withColumn("crack_length_mean_px", F.round("crack_length_mean_px", 9)).withColumn("crack_width_mean_px", F.round("crack_width_mean_px", 9))


@query("b12_significant_regions", f"""
SELECT record_id, image_id, time_label, damage_class, area_px2 FROM (SELECT *, max(area_px2) OVER (PARTITION BY image_id, time_label, damage_class) largest FROM fx_records WHERE damage_class IN ('spalling_dark','corrosion_rust','efflorescence_white')) q
WHERE area_px2 >= greatest(30, 0.0005::DOUBLE*{AREA}, 0.03::DOUBLE*largest)""", "fx_records")
def b12(fx):
    return ops.significant_regions(fx.records, F.lit(AREA)).select("record_id", "image_id", "time_label", "damage_class", "area_px2")


REGIONS = f"""sg AS (SELECT *, row_number() OVER (PARTITION BY image_id, time_label, damage_class ORDER BY area_px2 DESC, record_id) k FROM (SELECT *, max(area_px2) OVER (PARTITION BY image_id, time_label, damage_class) largest FROM fx_records WHERE damage_class IN ('spalling_dark','corrosion_rust','efflorescence_white')) q
 WHERE area_px2 >= greatest(30, 0.0005::DOUBLE*160000, 0.03::DOUBLE*largest)),
ab AS /* RECURSIVE */ (SELECT image_id, time_label, damage_class, k, record_id, record_id host, [{{'id': record_id, 'x': bbox_x, 'y': bbox_y, 'w': bbox_w, 'h': bbox_h}}] kept FROM sg WHERE k=1
 UNION ALL SELECT image_id, time_label, damage_class, k, record_id, coalesce(found, record_id), CASE WHEN found IS NULL THEN list_append(kept, {{'id': record_id, 'x': bbox_x, 'y': bbox_y, 'w': bbox_w, 'h': bbox_h}}) ELSE kept END FROM (
  SELECT s.*, a.kept, list_filter(a.kept, lambda o: greatest(0, least(s.bbox_x+s.bbox_w, o.x+o.w)-greatest(s.bbox_x, o.x))*greatest(0, least(s.bbox_y+s.bbox_h, o.y+o.h)-greatest(s.bbox_y, o.y)) >= 0.8::DOUBLE*s.bbox_w*s.bbox_h)[1].id found
  FROM ab a JOIN sg s ON s.image_id=a.image_id AND s.time_label=a.time_label AND s.damage_class=a.damage_class AND s.k=a.k+1) z)"""


@query("b12_consolidate_regions", """
SELECT a.image_id, a.time_label, a.damage_class, a.host record_id, sum(s.area_px2) area_px2, count(*)-1 absorbed, max(s.bbox_x) FILTER (s.record_id=a.host) bbox_x, max(s.bbox_y) FILTER (s.record_id=a.host) bbox_y, max(s.bbox_w) FILTER (s.record_id=a.host) bbox_w, max(s.bbox_h) FILTER (s.record_id=a.host) bbox_h,
 max(s.perimeter_px) FILTER (s.record_id=a.host) perimeter_px FROM ab a JOIN sg s ON s.record_id=a.record_id AND s.image_id=a.image_id AND s.time_label=a.time_label AND s.damage_class=a.damage_class GROUP BY 1,2,3,4""", "fx_records", REGIONS)
def b12b(fx):
    return ops.consolidate_regions(fx.records, F.lit(400 * 400))


@query("b13_source_class", "SELECT damage_class, kind, time_label, damage_class source_class, count(*) n FROM (SELECT *, CASE WHEN bbox_w % 2 = 0 THEN 'growth' ELSE 'reduction' END kind FROM fx_records_anon) q GROUP BY 1,2,3", "fx_records_anon")
def b13(fx):
    kind = F.when(F.col("bbox_w") % 2 == 0, "growth").otherwise("reduction")
    source = R.source_class(F.col("kind"), F.concat("kind", F.lit("_"), "damage_class"))
    return (fx.records_anon.withColumn("kind", kind).groupBy("damage_class", "kind", "time_label", source.alias("source_class"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("b14_classify_box_aspect", """
SELECT record_id, damage_class, major_px, round(major_px/minor, 9) aspect_ratio FROM (SELECT *, greatest(bbox_w, bbox_h) major_px, greatest(1, least(bbox_w, bbox_h)) minor FROM fx_records) q
WHERE damage_class <> 'exposed_rebar' OR (major_px/minor >= 3 AND major_px >= 0.04::DOUBLE*1600 AND area_px2 >= 60)""", "fx_records")
def b14(fx):
    return ops.classify_box_aspect(fx.records, F.lit(1600.0)).select("record_id", "damage_class", "major_px", F.round("aspect_ratio", 9).alias("aspect_ratio"))
