"""Registered queries: annotation datasets (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import annotations as ops
from .base import query

H, W = 120, 140
KEYS = ["image_id", "ann_id", "cls"]
def poly():
    return F.col("cls") != "cracks"


def stroke():
    return F.lit(3.0)


USE = "us AS (SELECT * FROM fx_annotations WHERE status NOT IN ('suggested','rejected'))"
EDGE = USE + f""",
ed AS (SELECT a.image_id, a.ann_id, a.cls, a.px xi, a.py yi, b.px xj, b.py yj FROM us a JOIN us b ON a.ann_id=b.ann_id AND b.seq=(a.seq+3)%4 WHERE a.cls<>'cracks'),
cr AS (SELECT image_id, ann_id, cls, y, xi+(y+0.5-yi)*(xj-xi)/(yj-yi) c FROM ed CROSS JOIN (SELECT unnest(range(0,{H})) y) s WHERE (yi<=y+0.5 AND yj>y+0.5) OR (yj<=y+0.5 AND yi>y+0.5)),
rk AS (SELECT *, row_number() OVER (PARTITION BY ann_id, y ORDER BY c) k, lead(c) OVER (PARTITION BY ann_id, y ORDER BY c) c2 FROM cr),
pg AS (SELECT DISTINCT image_id, ann_id, cls, y, x FROM rk JOIN (SELECT unnest(range(0,{W})) x) s ON x>=ceil(c-0.5) AND x<=floor(c2-0.5) WHERE k%2=1)"""
STRK = USE + f""",
sg AS (SELECT a.image_id, a.ann_id, a.cls, a.px ax, a.py ay, b.px bx, b.py by_, greatest(1, ceil(sqrt((b.px-a.px)*(b.px-a.px)+(b.py-a.py)*(b.py-a.py))/0.75)) n FROM us a JOIN us b ON a.ann_id=b.ann_id AND b.seq=a.seq+1 WHERE a.cls='cracks'),
dc AS (SELECT image_id, ann_id, cls, ax+(bx-ax)*(k/n) cx, ay+(by_-ay)*(k/n) cy FROM (SELECT *, unnest(range(0, n::BIGINT+1)) k FROM sg) q),
sk AS (SELECT DISTINCT image_id, ann_id, cls, y, x FROM dc JOIN (SELECT unnest(range(0,{H})) y) a ON y BETWEEN cy-3 AND cy+3 JOIN (SELECT unnest(range(0,{W})) x) b ON x BETWEEN cx-3 AND cx+3 WHERE (x+0.5-cx)*(x+0.5-cx)+(y+0.5-cy)*(y+0.5-cy)<=2.25)"""
BOTH = EDGE + ",\n" + STRK.replace(USE + ",\n", "") + ",\npx AS (SELECT * FROM pg UNION ALL SELECT * FROM sk)"
PAINT = "CASE cls WHEN 'structure' THEN 1 WHEN 'irrelevant' THEN 2 WHEN 'spalling_dark' THEN 3 WHEN 'efflorescence_white' THEN 4 WHEN 'corrosion_rust' THEN 5 WHEN 'exposed_rebar' THEN 6 ELSE 7 END"
INDEX = "CASE cls WHEN 'structure' THEN 1 WHEN 'irrelevant' THEN 2 WHEN 'spalling_dark' THEN 3 WHEN 'exposed_rebar' THEN 4 WHEN 'corrosion_rust' THEN 5 WHEN 'efflorescence_white' THEN 6 ELSE 7 END"
LABELS = BOTH + f",\nlm AS (SELECT image_id, y, x, arg_max({INDEX}, {PAINT})::BIGINT AS \"label\" FROM px GROUP BY 1,2,3)"
TILES = f"""im AS (SELECT DISTINCT image_id, {W}+image_id%3 w, {H} h FROM fx_annotations),
tw AS (SELECT image_id, scale, i, j, i*tw x0, j*th y0, least(tw, w-i*tw) ww, least(th, h-j*th) hh FROM (SELECT *, ceil(w/scale)::BIGINT tw, ceil(h/scale)::BIGINT th FROM im CROSS JOIN (SELECT unnest([1,2,4])::BIGINT scale) s) a CROSS JOIN (SELECT unnest(range(0,4)) i) b CROSS JOIN (SELECT unnest(range(0,4)) j) c WHERE i<scale AND j<scale),
wn AS (SELECT *, greatest(1, floor(ww*least(1.0::DOUBLE, 64.0/greatest(ww,hh))+0.5))::BIGINT out_w, greatest(1, floor(hh*least(1.0::DOUBLE, 64.0/greatest(ww,hh))+0.5))::BIGINT out_h FROM tw WHERE ww>0 AND hh>0)"""
CROP = LABELS + ",\n" + TILES + """,
ct AS (SELECT q.image_id, scale, i, j, out_y, out_x, l.label FROM (SELECT *, y0+least(hh-1, floor((out_y+0.5)*hh/out_h)::BIGINT) sy, x0+least(ww-1, floor((out_x+0.5)*ww/out_w)::BIGINT) sx FROM (SELECT *, unnest(range(0, out_w)) out_x FROM (SELECT *, unnest(range(0, out_h)) out_y FROM wn) a) b) q JOIN lm l ON l.image_id=q.image_id AND l.y=q.sy AND l.x=q.sx)"""


def shapes(fx):
    return ops.shapes_of(ops.usable_annotations(fx.annotations), KEYS)


def pixels(fx, keys=KEYS, union=False):
    return ops.rasterize(shapes(fx), keys, H, W, poly(), stroke(), union)


def images(fx):
    return fx.annotations.select("image_id").distinct().select("image_id", (W + F.col("image_id") % 3).alias("w"), F.lit(H).cast("long").alias("h"))


@query("j1_usable_annotations", "SELECT cls, status, count(DISTINCT ann_id) annotations, count(*) vertices FROM us GROUP BY 1,2", "fx_annotations", USE)
def j1(fx):
    return ops.usable_annotations(fx.annotations).groupBy("cls", "status").agg(F.countDistinct("ann_id").alias("annotations"), F.count(F.lit(1)).alias("vertices"))


@query("j2_rasterize_polygons", "SELECT image_id, ann_id, cls, y, x FROM pg", "fx_annotations", EDGE)
def j2(fx):
    return ops.rasterize_polygons(shapes(fx).where(poly()), KEYS, H, W)


@query("j3_rasterize_strokes", "SELECT image_id, ann_id, cls, y, x FROM sk", "fx_annotations", STRK)
def j3(fx):
    return ops.rasterize_strokes(shapes(fx).where(~poly()), KEYS, H, W, stroke())


@query("j4_label_map", "SELECT * FROM lm", "fx_annotations", LABELS)
def j4(fx):
    return ops.label_map(pixels(fx))


@query("j5_shape_measures", """
SELECT ann_id, round(abs(sum(a.px*b.py-b.px*a.py))/2, 6) area, min(a.px)-1 bbox_x, min(a.py)-1 bbox_y, max(a.px)-min(a.px)+2 bbox_w, max(a.py)-min(a.py)+2 bbox_h,
 round(2*greatest(1, 2.5::DOUBLE)*sqrt(pow(max(a.px) FILTER (a.seq=3)-max(a.px) FILTER (a.seq=0), 2)+pow(max(a.py) FILTER (a.seq=3)-max(a.py) FILTER (a.seq=0), 2)), 5) quad_area FROM fx_annotations a JOIN (SELECT ann_id, seq, px, py FROM fx_annotations) b USING (ann_id) WHERE b.seq=(a.seq+1)%4 GROUP BY 1""", "fx_annotations")
def j5(fx):
    p = F.col("points")
    rows = ops.shapes_of(fx.annotations, ["ann_id"]).withColumn("b", G.bounding_box(p, F.lit(1.0))).withColumn("quad", G.line_to_quad(p, F.lit(5.0)))
    return rows.select("ann_id", F.round(G.polygon_area(p), 6).alias("area"), *[F.col(f"b.{k}").alias(f"bbox_{k}") for k in "xywh"], F.round(G.polygon_area(F.col("quad")), 5).alias("quad_area"))


@query("j6_coco_rows", f"""
SELECT a.*, CASE WHEN cls='cracks' THEN 'polyline' ELSE 'polygon' END shape, CASE WHEN cls='cracks' THEN 3.0::DOUBLE END width_px, CASE WHEN cls='cracks' THEN 4 END::INT vertices, CASE WHEN cls<>'cracks' THEN 8 END::INT coordinates, CASE WHEN cls IN ('structure','irrelevant') THEN 'cena' WHEN cls='cracks' THEN 'detalhe' ELSE 'regiao' END AS level,
 round(x0-pad, 2) bbox_x, round(y0-pad, 2) bbox_y, round(x1-x0+2*pad, 2) bbox_w, round(y1-y0+2*pad, 2) bbox_h FROM (SELECT ann_id, image_id, {INDEX}::BIGINT category_id, count(*) area FROM px GROUP BY 1,2,3) a
JOIN (SELECT ann_id, any_value(cls) cls, CASE WHEN any_value(cls)='cracks' THEN 1.5::DOUBLE ELSE 0 END pad, min(px) x0, max(px) x1, min(py) y0, max(py) y1 FROM us GROUP BY 1) b USING (ann_id)""".replace("SELECT a.*,", "SELECT a.ann_id, a.image_id, a.category_id, a.area,"), "fx_annotations", BOTH)
def j6(fx):
    out = ops.coco_rows(shapes(fx), H, W, poly(), stroke())
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return out.select("ann_id", "image_id", "category_id", "area", "shm.shape", "shm.width_px", count("shm.polyline").alias("vertices"), count("segmentation").alias("coordinates"), "shm.level", *[F.col(f"bbox.{k}").alias(f"bbox_{k}") for k in "xywh"])


@query("j7_tile_windows", "SELECT * FROM wn", "fx_annotations", TILES)
def j7(fx):
    return ops.tile_windows(images(fx), side=64)


@query("j8_crop_tiles", "SELECT * FROM ct", "fx_annotations", CROP)
def j8(fx):
    return ops.crop_tiles(ops.label_map(pixels(fx)), images(fx), side=64)


@query("j8_tile_index", "SELECT w.image_id, w.scale, w.i, w.j, coalesce(n, 0) labelled_px FROM wn w LEFT JOIN (SELECT image_id, scale, i, j, count(*) n FROM ct GROUP BY 1,2,3,4) c USING (image_id, scale, i, j) WHERE w.scale=1 OR n>0", "fx_annotations", CROP)
def j8b(fx):
    tiles = ops.crop_tiles(ops.label_map(pixels(fx)), images(fx), side=64)
    return ops.tile_index(ops.tile_windows(images(fx), side=64), tiles).select("image_id", "scale", "i", "j", "labelled_px")


def record_shapes(fx, r=None):
    """Shapes of the records, or of the rows ``r`` of records without identity."""
    ids, r = (["record_id"], fx.records) if r is None else ([], r)
    x, y, w, h = (F.col(f"bbox_{k}").cast("double") for k in "xywh")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    closed = F.col("damage_class") != "cracks"
    return r.select(*ids, "image_id", "damage_class", closed.alias("closed"), "width_px", F.when(closed, F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))).otherwise(F.array(p(x, y), p(x + w, y + h))).alias("points"))


@query("j9_suggestions", """
SELECT concat('cdm-', record_id) ann_id, damage_class cls, CASE WHEN damage_class='cracks' THEN 'detalhe' ELSE 'regiao' END AS "level", CASE WHEN damage_class='cracks' THEN 'crack' ELSE 'polygon' END shape, round(bbox_x*0.25::DOUBLE, 2) first_x,
 CASE WHEN damage_class='cracks' THEN greatest(1, round(coalesce(nullif(width_px,0), 2)*0.25 + 1e-9, 2)) END width FROM fx_records""", "fx_records")
def j9(fx):
    out = ops.suggestions(record_shapes(fx), 0.25)
    return out.select("ann_id", "cls", "level", "shape", F.get("points", F.lit(0))["x"].alias("first_x"), "width")


FOUND = BOTH + f""",
rb AS (SELECT image_id % 50 image_id, damage_class cls, bbox_x/12.0::DOUBLE x0, (bbox_x+bbox_w)/12.0::DOUBLE x1, bbox_y/10.0::DOUBLE y0, (bbox_y+bbox_h)/10.0::DOUBLE y1 FROM fx_records),
rp AS (SELECT image_id, cls, y, x FROM rb JOIN (SELECT unnest(range(0,{H})) y) a ON y+0.5>=y0 AND y+0.5<y1 JOIN (SELECT unnest(range(0,{W})) x) b ON x>=ceil(x0-0.5) AND x<=floor(x1-0.5) WHERE cls<>'cracks'),
rd AS (SELECT image_id, cls, x0+(x1-x0)*(k/n) cx, y0+(y1-y0)*(k/n) cy FROM (SELECT *, unnest(range(0, n::BIGINT+1)) k FROM (SELECT *, greatest(1, ceil(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/0.75)) n FROM rb WHERE cls='cracks') q) z),
rs AS (SELECT image_id, cls, y, x FROM rd JOIN (SELECT unnest(range(0,{H})) y) a ON y BETWEEN cy-3 AND cy+3 JOIN (SELECT unnest(range(0,{W})) x) b ON x BETWEEN cx-3 AND cx+3 WHERE (x+0.5-cx)*(x+0.5-cx)+(y+0.5-cy)*(y+0.5-cy)<=2.25),
gx AS (SELECT DISTINCT image_id, cls, y, x FROM px WHERE cls NOT IN ('structure','irrelevant')),
fx_ AS (SELECT DISTINCT f.* FROM (SELECT * FROM rp UNION ALL SELECT * FROM rs) f SEMI JOIN (SELECT DISTINCT image_id, cls FROM gx) k USING (image_id, cls)),
tpn AS (SELECT image_id, cls, count(*) FILTER (g AND f) tp, count(*) FILTER (f AND NOT g) fp, count(*) FILTER (g AND NOT f) fn FROM (SELECT image_id, cls, y, x, bool_or(w=1) g, bool_or(w=2) f FROM (SELECT *, 1 w FROM gx UNION ALL SELECT *, 2 FROM fx_) u GROUP BY 1,2,3,4) v GROUP BY 1,2)"""


@query("j10_evaluate_against_gt", "SELECT image_id, cls, tp, fp, fn, round(tp/nullif(tp+fp+fn,0), 9) iou, round(2*tp/nullif(2*tp+fp+fn,0), 9) dice, round(tp/nullif(tp+fp,0), 9) AS \"precision\", round(tp/nullif(tp+fn,0), 9) recall FROM tpn", "fx_annotations fx_records", FOUND)
def j10(fx):
    keys = ["image_id", "cls"]  # only the union of the shapes of a class counts: no pixel travels with the id of its shape
    rec = record_shapes(fx, fx.records_anon).select((F.col("image_id") % 50).alias("image_id"), F.col("damage_class").alias("cls"), F.transform("points", lambda p: F.struct((p["x"] / 12).alias("x"), (p["y"] / 10).alias("y"))).alias("points"))
    out = ops.evaluate_against_gt(pixels(fx, keys, union=True), ops.rasterize(rec, keys, H, W, poly(), stroke(), union=True))
    return out.select("image_id", "cls", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("iou", "dice", "precision", "recall")])


FILES = "SELECT concat('scen', CAST(o_custkey % 3 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '/img/' ELSE '/gt/' END, 'frame_', CAST(CAST(floor(o_orderkey/2) AS BIGINT) % 4000 AS STRING), CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.JPG' END) path FROM {o}"
PAIRS = "fl AS (SELECT DISTINCT path FROM (" + FILES.format(o="orders") + """) a),
ps AS (SELECT split_part(path, '/', 1) scenario, split_part(path, '/', 2) kind, replace(split_part(path, '/', 3), '.JPG', '') stem, path FROM fl WHERE path LIKE '%.JPG'),
pp AS (SELECT i.scenario, i.stem, i.path image, m.path mask FROM ps i JOIN ps m ON i.scenario=m.scenario AND i.stem=m.stem AND i.kind='img' AND m.kind='gt')"""


def files(fx):
    return ops.pair_files(fx.spark.sql(FILES, o=fx.orders).distinct())


@query("j11_pair_files", "SELECT * FROM pp", "", PAIRS)
def j11(fx):
    return files(fx)


@query("j12_spread_sample", """SELECT p.scenario, stem, image, mask FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY image)-1 k, count(*) OVER (PARTITION BY scenario) n FROM pp) p
WHERE n<=17 OR k IN (SELECT floor(i*(n-1)/16)::BIGINT FROM (SELECT unnest(range(0,17)) i) q)""", "", PAIRS)
def j12(fx):
    return ops.spread_sample(files(fx), 17, F.substring("image", 1, 18)).select("scenario", "stem", "image", "mask")


@query("j13_hash_split", "SELECT c_custkey, CASE WHEN b<70 THEN 'train' WHEN b<85 THEN 'val' ELSE 'test' END split FROM (SELECT c_custkey, CAST(concat('0x', substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 b FROM customer) q")
def j13(fx):
    return fx.customer.select("c_custkey", ops.hash_split(F.col("c_custkey")).alias("split"))


CROPS = {"recorte_se": (0, 0, 22, 22), "recorte_sd": (10, 0, 22, 22), "recorte_ie": (0, 10, 22, 22), "recorte_id": (10, 10, 22, 22), "fase_7_5": (7, 5, 25, 27)}
MOVES = {"original": ("y", "x", "g"), "rot_90": ("x", "31-y", "g"), "rot_180": ("31-y", "31-x", "g"), "rot_270": ("31-x", "y", "g"), "espelho_h": ("y", "31-x", "g"), "espelho_v": ("31-y", "x", "g"), "brilho_p15": ("y", "x", "g+15"), "brilho_m15": ("y", "x", "g-15"),
         "contraste_115": ("y", "x", "(g-128)*1.15::DOUBLE+128"), "contraste_085": ("y", "x", "(g-128)*0.85::DOUBLE+128"), "gama_08": ("y", "x", "255*pow(g/255, 0.8::DOUBLE)"), "gama_125": ("y", "x", "255*pow(g/255, 1.25::DOUBLE)")}
AUG = " UNION ALL ".join([f"SELECT image_id, '{n}' variant, y-{y0} y, x-{x0} x, g FROM fx_pixels WHERE x>={x0} AND x<{x0 + w} AND y>={y0} AND y<{y0 + h}" for n, (x0, y0, w, h) in CROPS.items()]
                         + [f"SELECT image_id, '{n}', {y}, {x}, least(255, greatest(0, floor({g}+0.5)))::BIGINT FROM fx_pixels" for n, (y, x, g) in MOVES.items()])


@query("j14_augment_index", AUG, "fx_pixels")
def j14(fx):
    return ops.augment_index(fx.pixels, 32, 32)


# Shapes redrawn as curves: handles turn 0.3 of the next side by a right angle; every other node has no handle of its own before it.
NODES = """nd AS (SELECT a.ann_id, a.seq, a.cls<>'cracks' closed, a.px ax, a.py ay, a.px+(b.py-a.py)*0.3 hx, a.py-(b.px-a.px)*0.3 hy, b.px dx, b.py dy, CASE WHEN b.seq%2=1 THEN b.px-(c.px-b.px)*0.25 ELSE b.px END gx, CASE WHEN b.seq%2=1 THEN b.py-(c.py-b.py)*0.25 ELSE b.py END gy
 FROM fx_annotations a JOIN fx_annotations b ON a.ann_id=b.ann_id AND b.seq=(a.seq+1)%4 JOIN fx_annotations c ON a.ann_id=c.ann_id AND c.seq=(a.seq+2)%4),
sn AS (SELECT *, greatest(1, least(400, ceil((sqrt((hx-ax)*(hx-ax)+(hy-ay)*(hy-ay))+sqrt((gx-hx)*(gx-hx)+(gy-hy)*(gy-hy))+sqrt((dx-gx)*(dx-gx)+(dy-gy)*(dy-gy)))/1.4::DOUBLE)))::BIGINT n FROM nd WHERE closed OR seq<3),
bp AS (SELECT ann_id, 0 seq, 0 k, ax x, ay y FROM nd WHERE seq=0 UNION ALL SELECT ann_id, seq, k, u*u*u*ax+3*u*u*t*hx+3*u*t*t*gx+t*t*t*dx, u*u*u*ay+3*u*u*t*hy+3*u*t*t*gy+t*t*t*dy FROM (SELECT *, k/n::DOUBLE t, 1-k/n::DOUBLE u FROM (SELECT *, unnest(range(1, n+1)) k FROM sn) q) z WHERE NOT (closed AND seq=3 AND k=n)),
bo AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY seq, k)-1 i FROM bp)"""


def curved(fx):
    from ..functions import curves

    rows = ops.shapes_of(fx.annotations, ["ann_id", "cls"]).withColumn("closed", F.col("cls") != "cracks")
    at = lambda i: F.get("points", i % 4)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def node(p, i):
        after = at(i + 1)
        hout = point(p["x"] + (after["y"] - p["y"]) * 0.3, p["y"] - (after["x"] - p["x"]) * 0.3)
        hin = F.when(i % 2 == 1, point(p["x"] - (after["x"] - p["x"]) * 0.25, p["y"] - (after["y"] - p["y"]) * 0.25))
        return F.struct(p.alias("p"), hin.alias("hin"), hout.alias("hout"))

    return curves, rows.withColumn("nodes", F.transform("points", node))


@query("j15_bezier_points", "SELECT ann_id, i::INT i, round(x+1.3e-9, 8) x, round(y+1.3e-9, 8) y FROM bo", "fx_annotations", NODES)
def j15(fx):
    curves, rows = curved(fx)
    drawn = rows.select("ann_id", F.posexplode(curves.flatten_bezier(F.col("nodes"), F.col("closed"))).alias("i", "p"))
    return drawn.select("ann_id", "i", *[F.round(F.col(f"p.{a}") + 1.3e-9, 8).alias(a) for a in "xy"])


SPLINE = """cl AS (SELECT ann_id, cls<>'cracks' closed, seq, px, py FROM fx_annotations),
pd AS (SELECT ann_id, closed, seq i, px, py FROM cl WHERE closed UNION ALL SELECT ann_id, closed, seq+2, px, py FROM cl WHERE NOT closed UNION ALL SELECT ann_id, closed, s, px, py FROM cl JOIN (SELECT unnest([0,1]) s) q ON seq=0 WHERE NOT closed UNION ALL SELECT ann_id, closed, s, px, py FROM cl JOIN (SELECT unnest([6,7]) s) q ON seq=3 WHERE NOT closed),
sp AS (SELECT a.ann_id, a.closed, a.i, a.px x0, a.py y0, b.px x1, b.py y1, c.px x2, c.py y2, d.px x3, d.py y3 FROM pd a JOIN pd b ON a.ann_id=b.ann_id AND b.i=CASE WHEN a.closed THEN (a.i+1)%4 ELSE a.i+1 END JOIN pd c ON a.ann_id=c.ann_id AND c.i=CASE WHEN a.closed THEN (a.i+2)%4 ELSE a.i+2 END JOIN pd d ON a.ann_id=d.ann_id AND d.i=CASE WHEN a.closed THEN (a.i+3)%4 ELSE a.i+3 END),
sb AS (SELECT *, (1-3*t+3*t*t-t*t*t)/6 b0, (4-6*t*t+3*t*t*t)/6 b1, (1+3*t+3*t*t-3*t*t*t)/6 b2, t*t*t/6 b3 FROM (SELECT *, k/16.0::DOUBLE t FROM sp CROSS JOIN (SELECT unnest(range(0,16)) k) q) z),
so AS (SELECT ann_id, i*16+k i, b0*x0+b1*x1+b2*x2+b3*x3 x, b0*y0+b1*y1+b2*y2+b3*y3 y FROM sb UNION ALL SELECT ann_id, 80, px, py FROM cl WHERE NOT closed AND seq=3)"""


@query("j16_bspline_points", "SELECT ann_id, i::INT i, round(x, 8) x, round(y, 8) y FROM so", "fx_annotations", SPLINE)
def j16(fx):
    curves, rows = curved(fx)
    drawn = rows.select("ann_id", F.posexplode(curves.flatten_bspline(F.col("points"), F.col("closed"))).alias("i", "p"))
    return drawn.select("ann_id", "i", F.round("p.x", 8).alias("x"), F.round("p.y", 8).alias("y"))


@query("j17_spiral_points", """
SELECT ann_id, k::INT i, round(px+r*cos(th), 6) x, round(py+r*sin(th), 6) y FROM (SELECT *, (2+ann_id%9)*pow(t, 0.5+ann_id%3) r, ann_id%7-2*pi()*turns*(1-t) th FROM (SELECT *, 0.1+0.9*k/n t FROM (SELECT *, unnest(range(0, n+1)) k FROM (
 SELECT ann_id, px, py, (1+ann_id%5)*0.25::DOUBLE turns, greatest(24, ceil((1+ann_id%5)*18))::BIGINT n FROM fx_annotations WHERE seq=0) a) b) c) d""", "fx_annotations")
def j17(fx):
    from ..functions import curves

    a = F.col("ann_id")
    rows = ops.shapes_of(fx.annotations, ["ann_id"])
    drawn = curves.spiral_points(F.get("points", F.lit(0)), (2 + a % 9).cast("double"), (a % 7).cast("double"), (1 + a % 5) * 0.25, a % 3 + 0.5, F.lit(0.1))
    return rows.select("ann_id", F.posexplode(drawn).alias("i", "p")).select("ann_id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("j18_curve_areas", """
SELECT ann_id, count(*) vertices, round(abs(sum(x*ny-nx*y))/2+1e-6, 4) area FROM (SELECT ann_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny FROM (SELECT ann_id, i, round(x+1e-9, 2) x, round(y+1e-9, 2) y FROM bo JOIN (SELECT DISTINCT ann_id FROM nd WHERE closed) c USING (ann_id)) q WINDOW w AS (PARTITION BY ann_id ORDER BY i)) z GROUP BY 1""", "fx_annotations", NODES)
def j18(fx):
    """Areas of the stored polylines of closed curves."""
    curves, rows = curved(fx)
    drawn = F.transform(curves.flatten_bezier(F.col("nodes"), F.col("closed")), lambda p: F.struct((p["x"] + 1e-9).alias("x"), (p["y"] + 1e-9).alias("y")))
    stored = rows.where("closed").select("ann_id", curves.rounded(drawn).alias("ring"))
    return stored.select("ann_id", F.size("ring").cast("long").alias("vertices"), F.round(G.polygon_area(F.col("ring")) + 1e-6, 4).alias("area"))
