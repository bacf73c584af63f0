"""Registered queries: model outputs and evaluation (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ops
from ..operators import inference
from .base import query

ON = lambda *cols: [F.round(c, 9).alias(c) for c in cols]
PRED = "pr AS (SELECT image_id, y, x, prob, gt, split, prob>=0.6 p FROM fx_probs)"


def gt(fx):
    return fx.probs.where("gt").select("image_id", "y", "x")


def pred(fx, t=0.6):
    return fx.probs.where(F.col("prob") >= t).select("image_id", "y", "x")


@query("i1_run_engines")
def i1(fx):
    def bright():
        def detect(image):
            on = [(x, y) for x, y, v in zip(image["x"], image["y"], image["v"]) if v >= 200]
            if not on:
                return []
            xs, ys = [p[0] for p in on], [p[1] for p in on]
            return [{"label": "efflorescence", "score": len(on) / len(image["v"]), "x1": float(min(xs)), "y1": float(min(ys)), "x2": float(max(xs) + 1), "y2": float(max(ys) + 1), "area_px": float(len(on))}]
        return detect

    def unavailable():
        raise inference.MissingWeights("no model file")

    def fragile():
        def detect(image):
            if image["image_id"] % 2:
                raise ValueError("cannot decode")
            return []
        return detect

    runs = inference.run_engines(inference.pack_images(fx.pixels), {"bright": bright, "unavailable": unavailable, "fragile": fragile})
    return runs.select("image_id", "engine_id", "status", F.size("detections").alias("detections"))


@query("i2_softmax_argmax", "SELECT image_id, y, x, arg_max(class_id, (logit, -class_id))::BIGINT class_id, round(sum(exp(logit-m)) FILTER (class_id=2)/sum(exp(logit-m)), 9) prob FROM (SELECT *, max(logit) OVER (PARTITION BY image_id, y, x) m FROM fx_logits) q GROUP BY 1,2,3", "fx_logits")
def i2(fx):
    return ops.softmax_argmax(fx.logits, 2).withColumn("prob", F.round("prob", 9))


@query("i3_threshold_mask", "SELECT image_id, count(*) FILTER (prob>=0.7) area, round(count(*) FILTER (prob>=0.7)/count(*), 9) area_ratio, round(avg(prob), 9) mean_probability, round(max(prob), 9) max_probability, round(coalesce(avg(prob) FILTER (prob>=0.7), max(prob)), 9) score FROM fx_probs GROUP BY 1", "fx_probs")
def i3(fx):
    return ops.threshold_mask(fx.probs, 0.7).select("image_id", "area", *ON("area_ratio", "mean_probability", "max_probability", "score"))


@query("i4_bilinear_resample", """
SELECT a.image_id, a.ty y, a.tx x, round((a.prob*(1-wx)+b.prob*wx)*(1-wy)+(c.prob*(1-wx)+d.prob*wx)*wy + 1.1e-10, 9) prob FROM (SELECT image_id, ty, tx, p.prob, y0, x0, y1, x1, wy, wx FROM (
 SELECT *, CAST(floor(fy) AS BIGINT) y0, CAST(floor(fx) AS BIGINT) x0, least(31, CAST(floor(fy) AS BIGINT)+1) y1, least(31, CAST(floor(fx) AS BIGINT)+1) x1, fy-floor(fy) wy, fx-floor(fx) wx FROM (SELECT ty, tx, greatest(0, least(31, (ty+0.5)*32/20-0.5)) fy, greatest(0, least(31, (tx+0.5)*32/48-0.5)) fx FROM (SELECT unnest(range(0,20)) ty) a CROSS JOIN (SELECT unnest(range(0,48)) tx) b) t) t JOIN full_p p ON p.y=t.y0 AND p.x=t.x0) a
JOIN full_p b ON b.image_id=a.image_id AND b.y=a.y0 AND b.x=a.x1 JOIN full_p c ON c.image_id=a.image_id AND c.y=a.y1 AND c.x=a.x0 JOIN full_p d ON d.image_id=a.image_id AND d.y=a.y1 AND d.x=a.x1""", "fx_probs", "full_p AS (SELECT image_id, y, x, coalesce(prob, 0) prob FROM (SELECT DISTINCT image_id FROM fx_probs) i CROSS JOIN (SELECT unnest(range(0,32)) y) a CROSS JOIN (SELECT unnest(range(0,32)) x) b LEFT JOIN fx_probs USING (image_id, y, x))")
def i4(fx):
    out = ops.bilinear_resample(fx.probs, (32, 32), (20, 48))
    grid = fx.probs.select("image_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(47).cast("long"))))
    return grid.join(out, ["image_id", "y", "x"], "left").withColumn("prob", F.round(F.coalesce("prob", F.lit(0.0)) + 1.1e-10, 9))


CANDS = "SELECT image_id, det_id cand_id, (x1+x2)/2 cx, (y1+y2)/2 cy, x2-x1 w, y2-y1 h, coalesce(score, 0.1) s0, 1-coalesce(score, 0.1) s1, 0.4*coalesce(score, 0.1)+0.35 s2 FROM {d}"


def candidates(fx):
    return fx.spark.sql(CANDS.replace("0.1)", "0.1D)").replace("0.4*", "0.4D*").replace("0.35 ", "0.35D "), d=fx.detections).withColumn("scores", F.array("s0", "s1", "s2"))


@query("i5_decode_boxes", "SELECT image_id, cand_id, CASE WHEN s0>=s1 AND s0>=s2 THEN 0 WHEN s1>=s2 THEN 1 ELSE 2 END::BIGINT class_id, round(greatest(s0,s1,s2), 9) score, cx-w/2 x1, cy-h/2 y1, cx+w/2 x2, cy+h/2 y2 FROM cd WHERE greatest(s0,s1,s2)>=0.6", "fx_detections", "cd AS (" + CANDS.format(d="fx_detections").replace("0.1)", "0.1::DOUBLE)").replace("0.4*", "0.4::DOUBLE*").replace("0.35 ", "0.35::DOUBLE ") + ")")
def i5(fx):
    return ops.decode_boxes(candidates(fx), 0.6).withColumn("score", F.round("score", 9))


NMS = "cd AS (" + CANDS.format(d="fx_detections").replace("0.1)", "0.1::DOUBLE)").replace("0.4*", "0.4::DOUBLE*").replace("0.35 ", "0.35::DOUBLE ") + """),
bx AS (SELECT image_id, x1, y1, x2, y2, max(score) score, arg_min(cand_id, (-score, cand_id)) cand_id FROM (SELECT image_id, cand_id, greatest(s0, s1, s2) score, cx-w/2 x1, cy-h/2 y1, cx+w/2 x2, cy+h/2 y2 FROM cd WHERE greatest(s0, s1, s2)>=0.25) q GROUP BY 1,2,3,4,5),
ns AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, cand_id) k FROM bx),
nf AS /* RECURSIVE */ (SELECT image_id, k, true ok, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] kept FROM ns WHERE k=1
 UNION ALL SELECT image_id, k, ok, CASE WHEN ok THEN list_append(kept, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) ELSE kept END FROM (SELECT n.*, f.kept, len(f.kept)<30 AND len(list_filter(f.kept, lambda o:
  greatest(0, least(o.x2, n.x2)-greatest(o.x1, n.x1))*greatest(0, least(o.y2, n.y2)-greatest(o.y1, n.y1))/greatest(greatest(0, o.x2-o.x1)*greatest(0, o.y2-o.y1)+greatest(0, n.x2-n.x1)*greatest(0, n.y2-n.y1)-greatest(0, least(o.x2, n.x2)-greatest(o.x1, n.x1))*greatest(0, least(o.y2, n.y2)-greatest(o.y1, n.y1)), 1e-9) > 0.45))=0 ok
  FROM nf f JOIN ns n ON n.image_id=f.image_id AND n.k=f.k+1) z)"""


@query("i6_nms", "SELECT image_id, cand_id, score, x1, y1, x2, y2 FROM ns JOIN nf USING (image_id, k) WHERE ok", "fx_detections", NMS)
def i6(fx):
    return ops.nms(ops.decode_boxes(candidates(fx), 0.25))


@query("i7_unletterbox", "SELECT * FROM (SELECT det_id, least(640, greatest(0, (x1-20)/0.5::DOUBLE)) x1, least(200, greatest(0, (y1-60)/0.5::DOUBLE)) y1, least(640, greatest(0, (x2-20)/0.5::DOUBLE)) x2, least(200, greatest(0, (y2-60)/0.5::DOUBLE)) y2 FROM fx_detections) q WHERE x2>x1 AND y2>y1", "fx_detections")
def i7(fx):
    return ops.unletterbox(fx.detections.select("det_id", *ops.BOX), F.lit(0.5), F.lit(20.0), F.lit(60.0), F.lit(640.0), F.lit(200.0))


# Prototypes: the 64 components of each vector as an 8 x 8 plane per channel; one detection per vector parity.
PROTO = "SELECT CAST(floor(vec_id/16) AS BIGINT) image_id, vec_id % 16 channel, CAST(floor(i/8) AS BIGINT) y, i % 8 x, CAST(v AS DOUBLE) value FROM {e}"
COEF = "SELECT image_id, channel, det_id, CAST((channel*7+det_id*5+image_id) % 11 - 5 AS DOUBLE) coefficient FROM (SELECT DISTINCT CAST(floor(vec_id/16) AS BIGINT) image_id, vec_id % 16 channel FROM {e}) c [[det_id 0 2]]"


@query("i8_proto_masks", "SELECT image_id, det_id::BIGINT det_id, y, x, round(1/(1+exp(-sum(coefficient*value))), 8) prob FROM co JOIN po USING (image_id, channel) GROUP BY 1,2,3,4", "fx_emb",
       "po AS (" + PROTO.format(e="fx_emb") + "),\nco AS (" + COEF.format(e="fx_emb").replace("[[det_id 0 2]]", "CROSS JOIN (SELECT unnest(range(0,3)) det_id) d") + ")")
def i8(fx):
    from ..sources.fixtures import _spark_text
    co = fx.spark.sql(_spark_text(COEF), e=fx.emb).withColumn("det_id", F.col("det_id").cast("long"))
    return ops.proto_masks(co, fx.spark.sql(PROTO, e=fx.emb)).withColumn("prob", F.round("prob", 8))


@query("i9_class_area_ratios", "SELECT image_id, class_id, count(*) area, round(count(*)/any_value(n), 9) ratio FROM (SELECT image_id, y, x, arg_max(class_id, (logit, -class_id))::BIGINT class_id FROM fx_logits GROUP BY 1,2,3) a JOIN (SELECT image_id, count(*) n FROM fx_pixels GROUP BY 1) b USING (image_id) GROUP BY 1,2", "fx_logits fx_pixels")
def i9(fx):
    return ops.class_area_ratios(ops.softmax_argmax(fx.logits, 0)).withColumn("ratio", F.round("ratio", 9))


@query("i10_zero_shot_argmax", "SELECT image_id, prompt_id, count(*) area, round(avg(p), 9) score, round(count(*)/any_value(n), 9) ratio FROM (SELECT image_id, y, x, arg_max(class_id, (logit/6.1, -class_id))::BIGINT prompt_id, max(logit/6.1::DOUBLE) p FROM fx_logits GROUP BY 1,2,3) a JOIN (SELECT image_id, count(*) n FROM fx_pixels GROUP BY 1) b USING (image_id) WHERE p>=0.55 GROUP BY 1,2", "fx_logits fx_pixels")
def i10(fx):
    rows = fx.logits.select("image_id", "y", "x", F.col("class_id").alias("prompt_id"), (F.col("logit") / 6.1).alias("prob"))
    return ops.zero_shot_argmax(rows).select("image_id", "prompt_id", "area", *ON("score", "ratio"))


SEG = "sm AS (SELECT image_id, count(*) FILTER (gt AND p) tp, count(*) FILTER (p AND NOT gt) fp, count(*) FILTER (gt AND NOT p) fn, count(*) FILTER (gt) gt_px, count(*) n FROM pr GROUP BY 1)"


@query("i11_seg_metrics", "SELECT image_id, tp, fp, fn, round(tp/nullif(tp+fp+fn,0), 9) iou, round(2*tp/nullif(2*tp+fp+fn,0), 9) dice, round(tp/nullif(tp+fp,0), 9) AS \"precision\", round(tp/nullif(tp+fn,0), 9) recall FROM sm WHERE tp+fp+fn>0", "fx_probs", PRED + ",\n" + SEG)
def i11(fx):
    return ops.seg_metrics(gt(fx), pred(fx), ["image_id"]).select("image_id", "tp", "fp", "fn", *ON("iou", "dice", "precision", "recall"))


@query("i12_cldice", """
SELECT image_id, round(tp, 9) topology_precision, round(ts, 9) topology_sensitivity, round(CASE WHEN tp+ts>0 THEN 2*tp*ts/(tp+ts) ELSE 0 END, 9) cldice FROM (SELECT image_id, coalesce(count(*) FILTER (p AND (x+y)%3=0 AND gt)/nullif(count(*) FILTER (p AND (x+y)%3=0), 0), 0) tp, coalesce(count(*) FILTER (gt AND (x+y)%3=0 AND p)/nullif(count(*) FILTER (gt AND (x+y)%3=0), 0), 0) ts, count(*) FILTER ((x+y)%3=0 AND (p OR gt)) k FROM pr GROUP BY 1) q WHERE k>0""", "fx_probs", PRED)
def i12(fx):
    thin = "(x + y) % 3 = 0"
    out = ops.cldice(gt(fx), pred(fx), gt(fx).where(thin), pred(fx).where(thin), ["image_id"])
    return out.select("image_id", *ON("topology_precision", "topology_sensitivity", "cldice"))


GRID = "th AS (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in ops.SWEEP) + "]) t)"
SWEEP = GRID + """,
sw AS (SELECT image_id, "mode", t, tp, fp, g-tp fn, g, n FROM (SELECT image_id, "mode", t, count(*) FILTER (q>=t AND gt) tp, count(*) FILTER (q>=t AND NOT gt) fp, count(*) FILTER (gt) g, count(*) n FROM (SELECT image_id, gt, unnest(['direct','inverted']) AS "mode", unnest([prob, 1-prob]) q FROM fx_probs) a CROSS JOIN th GROUP BY 1,2,3) b),
ss AS (SELECT *, coalesce(tp/nullif(tp+fp+fn,0), 1) iou, coalesce(2*tp/nullif(2*tp+fp+fn,0), 1) dice, abs(tp+fp-g)/n area_delta FROM sw)"""


@query("i13_threshold_sweep", """SELECT image_id, "mode", t threshold, round(iou, 9) iou, round(dice, 9) dice, round(area_delta, 9) area_delta, iou>=0.5 AND dice>=0.65 AND area_delta<=0.1 passed FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, dice DESC, area_delta, "mode", t) rn FROM ss) q WHERE rn=1""", "fx_probs", SWEEP)
def i13(fx):
    return ops.threshold_sweep(fx.probs).select("image_id", "mode", "threshold", *ON("iou", "dice", "area_delta"), "passed")


@query("i14_minority_foreground", "SELECT p.image_id, y, x, gt <> (s>0.5) gt FROM (SELECT image_id, y, x, g>=125 gt FROM fx_pixels) p JOIN (SELECT image_id, avg((g>=125)::INT) s FROM fx_pixels GROUP BY 1) q USING (image_id)", "fx_pixels")
def i14(fx):
    return ops.minority_foreground(fx.pixels.select("image_id", "y", "x", (F.col("g") >= 125).alias("gt")))


CASES = PRED + ",\n" + SEG + """,
cs AS (SELECT split, image_id, coalesce(tp/nullif(tp+fp+fn,0), 1) iou, coalesce(2*tp/nullif(2*tp+fp+fn,0), 1) dice, abs(tp+fp-gt_px)/n area_delta FROM sm JOIN (SELECT DISTINCT image_id, split FROM fx_probs) s USING (image_id))"""


def cases(fx):
    on = F.col("prob") >= 0.6
    counts = fx.probs.groupBy("split", "image_id").agg(F.count_if(on & F.col("gt")).alias("tp"), F.count_if(on & ~F.col("gt")).alias("fp"), F.count_if(~on & F.col("gt")).alias("fn"), F.count_if("gt").alias("gt_px"), F.count(F.lit(1)).alias("pixels"))
    return ops.with_scores(counts)


@query("i15_dataset_metrics", "SELECT split, count(*) cases, round(avg(iou), 9) mean_iou, round(min(iou), 9) min_iou, round(avg(dice), 9) mean_dice, round(avg(area_delta), 9) mean_area_delta, round(median(iou), 9) median_iou, round(median(dice), 9) median_dice FROM cs GROUP BY 1", "fx_probs", CASES)
def i15(fx):
    return ops.dataset_metrics(cases(fx), ["split"]).select("split", "cases", *ON("mean_iou", "min_iou", "mean_dice", "mean_area_delta", "median_iou", "median_dice"))


VAL = "vt AS (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in ops.VALIDATION_GRID) + "]) t)"


@query("i15_choose_threshold", """SELECT split, t threshold, round(mi, 9) mean_iou, round(md, 9) mean_dice FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(mi,12) DESC, round(md,12) DESC, round(ma,12), t) rn FROM (SELECT split, t, avg(coalesce(tp/nullif(tp+fp+fn,0),1)) mi, avg(coalesce(2*tp/nullif(2*tp+fp+fn,0),1)) md, avg(abs(tp+fp-tp-fn)/n) ma FROM (
 SELECT split, image_id, t, count(*) FILTER (prob>=t AND gt) tp, count(*) FILTER (prob>=t AND NOT gt) fp, count(*) FILTER (prob<t AND gt) fn, count(*) n FROM fx_probs CROSS JOIN vt GROUP BY 1,2,3) a GROUP BY 1,2) b) c WHERE rn=1""", "fx_probs", VAL)
def i15b(fx):
    return ops.choose_threshold(fx.probs, ["split"]).select("split", "threshold", *ON("mean_iou", "mean_dice"))


@query("i16_quality_gate", "SELECT image_id, iou>=0.5 AND dice>=0.65 AND area_delta<=0.1 supervised, iou>=0.35 AND dice>=0.5 AND area_delta<=0.15 external, iou>=0.35 AND dice>=0.5 AND area_delta<=0.2 candidate FROM cs", "fx_probs", CASES)
def i16(fx):
    return cases(fx).select("image_id", *[ops.gate(ops.GATES[n]).alias(n) for n in ("supervised", "external", "candidate")])


CM = "cl AS (SELECT image_id, y, x, arg_max(class_id, (logit, -class_id))::BIGINT prediction, CASE WHEN (x+y)%7=0 THEN 255 ELSE (image_id + y//8) % 4 END truth FROM fx_logits GROUP BY 1,2,3)"


def classes(fx):
    rows = ops.softmax_argmax(fx.logits, 0)
    truth = F.when((F.col("x") + F.col("y")) % 7 == 0, 255).otherwise((F.col("image_id") + F.floor(F.col("y") / 8)) % 4).cast("long")
    return rows.select("image_id", F.col("class_id").alias("prediction"), truth.alias("truth"))


@query("i17_confusion_matrix", "SELECT image_id, truth, prediction, count(*) n FROM cl WHERE truth<>255 GROUP BY 1,2,3", "fx_logits", CM)
def i17(fx):
    return ops.confusion_matrix(classes(fx), ["image_id"])


@query("i17_class_iou", "SELECT k class_id, count(*) FILTER (truth=k AND prediction=k) tp, count(*) FILTER (truth<>k AND prediction=k) fp, count(*) FILTER (truth=k AND prediction<>k) fn, round(count(*) FILTER (truth=k AND prediction=k)/nullif(count(*) FILTER (truth=k OR prediction=k), 0), 9) iou FROM cl CROSS JOIN (SELECT unnest(range(0,4)) k) q WHERE truth<>255 GROUP BY 1", "fx_logits", CM)
def i17b(fx):
    return ops.class_iou(ops.confusion_matrix(classes(fx))).withColumn("iou", F.round("iou", 9))


@query("i18_multilabel_confusion", """
SELECT pair_id, a.c truth, b.c prediction, count(*) n, any_value(t.total) total FROM la a JOIN lb b USING (pair_id, y, x) JOIN (SELECT pair_id, c, count(*) total FROM la GROUP BY 1,2) t ON t.pair_id=a.pair_id AND t.c=a.c GROUP BY 1,2,3""".replace("SELECT pair_id, a.c", "SELECT a.pair_id, a.c"), "fx_masks fx_pixels", """
la AS (SELECT image_id pair_id, p.y, p.x, coalesce(damage_class, 'background') c FROM fx_pixels p LEFT JOIN (SELECT DISTINCT pair_id, damage_class, y, x FROM fx_masks WHERE epoch='t0') m ON m.pair_id=p.image_id AND m.y=p.y AND m.x=p.x),
lb AS (SELECT image_id pair_id, p.y, p.x, coalesce(damage_class, 'background') c FROM fx_pixels p LEFT JOIN (SELECT DISTINCT pair_id, damage_class, y, x FROM fx_masks WHERE epoch='t1') m ON m.pair_id=p.image_id AND m.y=p.y AND m.x=p.x)""")
def i18(fx):
    px = fx.pixels.withColumnRenamed("image_id", "pair_id")
    return ops.multilabel_confusion(fx.masks.where("epoch = 't0'"), fx.masks.where("epoch = 't1'"), px, ["pair_id"], ["cracks", "corrosion_rust"])


@query("i19_mask_compare", "SELECT image_id, tp+fn a_px, tp+fp b_px, round(tp/(tp+fp+fn), 9) iou, round((fp+fn)/1024, 9) pmr FROM sm WHERE tp+fp+fn>0", "fx_probs", PRED + ",\n" + SEG)
def i19(fx):
    return ops.mask_compare(gt(fx), pred(fx), ["image_id"], 1024).select("image_id", "a_px", "b_px", *ON("iou", "pmr"))


@query("i19_field_compare", "SELECT image_id, max(abs(r-g))::DOUBLE linf, round(avg(abs(r-g)), 9) mae FROM fx_rgb GROUP BY 1", "fx_rgb")
def i19b(fx):
    out = ops.field_compare(fx.rgb.select("image_id", "y", "x", F.col("r").cast("double").alias("v")), fx.rgb.select("image_id", "y", "x", F.col("g").cast("double").alias("v")), ["image_id"], "v")
    return out.withColumn("mae", F.round("mae", 9))


STAGE = """SELECT image_id, 'raw_mask' stage, CAST(NULL AS DOUBLE) iou, CAST(max(g) AS DOUBLE)/CAST(2550000 AS DOUBLE) pmr, CAST(NULL AS DOUBLE) linf, CAST(0 AS DOUBLE) dcc, CAST(0 AS DOUBLE) nodes FROM {px} GROUP BY image_id
 UNION ALL SELECT image_id, 'final_mask', 1 - CAST(min(g) AS DOUBLE)/CAST(20000 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM {px} GROUP BY image_id
 UNION ALL SELECT image_id, 'gray', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(max(g) AS DOUBLE)/CAST(256 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {px} GROUP BY image_id"""


@query("i20_parity_report", """
SELECT a.image_id, g gray_linf, 0.0::DOUBLE response_linf, round(r, 9) raw_pmr, 0.0::DOUBLE open_pmr, round(c, 9) clean_iou, 0.0::DOUBLE dcc, 0.0::DOUBLE skeleton_nodes, round(m, 9) measure_rel, CASE WHEN g<=1 AND r<=1e-4 AND c>=0.9999 AND m<=0.01 THEN 'pass' WHEN c>=0.995 AND m<=0.05 THEN 'warn' ELSE 'fail' END status FROM (
 SELECT image_id, max(linf) FILTER (stage='gray') g, max(pmr) FILTER (stage='raw_mask') r, min(iou) FILTER (stage='final_mask') c FROM st GROUP BY 1) a JOIN (SELECT image_id, max(abs(a-b)/greatest(1e-9, CASE WHEN b=0 THEN 1 ELSE abs(b) END)) m FROM ms GROUP BY 1) b USING (image_id)""",
       "fx_pixels", "st AS (" + STAGE.format(px="fx_pixels") + "),\nms AS (SELECT image_id, avg(g) a, avg(g)*(1+(image_id%4)*0.02::DOUBLE) b FROM fx_pixels GROUP BY 1)")
def i20(fx):
    ms = fx.pixels.groupBy("image_id").agg(F.avg("g").alias("a")).withColumn("b", F.col("a") * (1 + (F.col("image_id") % 4) * 0.02))
    out = ops.parity_report(fx.spark.sql(STAGE, px=fx.pixels), ms, ["image_id"])
    return out.select("image_id", "gray_linf", "response_linf", F.round("raw_pmr", 9).alias("raw_pmr"), "open_pmr", F.round("clean_iou", 9).alias("clean_iou"), "dcc", "skeleton_nodes", F.round("measure_rel", 9).alias("measure_rel"), "status")


@query("i21_model_consistency", "SELECT image_id, round(avg(abs(a-b)), 9) mean_abs_error, round(max(abs(a-b)), 9) max_abs_error, round(coalesce(count(*) FILTER (a>=0.5 AND b>=0.5)/nullif(count(*) FILTER (a>=0.5 OR b>=0.5),0), 1), 9) iou, round(abs(avg((a>=0.5)::INT)-avg((b>=0.5)::INT)), 9) area_delta FROM (SELECT image_id, prob a, floor(prob*20)/20 b FROM fx_probs) q GROUP BY 1", "fx_probs")
def i21(fx):
    coarse = fx.probs.select("image_id", "y", "x", (F.floor(F.col("prob") * 20) / 20).alias("prob"))
    return ops.model_consistency(fx.probs, coarse).select("image_id", *ON("mean_abs_error", "max_abs_error", "iou", "area_delta"))


@query("i22_bland_altman", "SELECT damage_class, n, round(m, 8) bias, round(s, 8) sd, round(m-1.96*s, 8) lower, round(m+1.96*s, 8) upper FROM (SELECT damage_class, count(*) n, avg(a-b) m, stddev_samp(a-b) s FROM fx_measures_anon GROUP BY 1) q", "fx_measures_anon")
def i22(fx):
    return ops.bland_altman(fx.measures_anon, ["damage_class"]).select("damage_class", "n", *[F.round(c, 8).alias(c) for c in ("bias", "sd", "lower", "upper")])


@query("i23_manifest_check", "SELECT doc_id asset_id, true present, doc_id%5<>0 size_ok, doc_id%7<>0 digest_ok FROM documents WHERE true")
def i23(fx):
    assets = fx.documents.select(F.col("doc_id").alias("asset_id"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    manifest = assets.select("asset_id", F.when(F.col("asset_id") % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("asset_id") % 7 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    return ops.manifest_check(assets, manifest)


@query("i24_engine_latency", "SELECT engine_id, count(*) runs, count(*) FILTER (status='ok') ok, round(avg(latency_ms), 8) mean_ms, quantile_cont(latency_ms, 0.5) p50_ms, round(quantile_cont(latency_ms, 0.95), 8) p95_ms FROM fx_runs GROUP BY 1", "fx_runs")
def i24(fx):
    return ops.engine_latency(fx.runs).withColumn("mean_ms", F.round("mean_ms", 8)).withColumn("p95_ms", F.round("p95_ms", 8))


@query("i25_remap_labels", "SELECT image_id, y, x, CASE g%19 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 5 WHEN 4 THEN 4 WHEN 8 THEN 2 WHEN 12 THEN 3 ELSE 255 END::BIGINT class_id FROM fx_pixels", "fx_pixels")
def i25(fx):
    return ops.remap_labels(fx.pixels.select("image_id", "y", "x", (F.col("g") % 19).alias("class_id")), "class_id")
