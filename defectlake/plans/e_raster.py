"""Registered queries: raster analytics (E)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import imagerun, outlines, rating
from ..operators import raster as ops
from ..operators import skeleton
from ..operators import temporal
from ..session import checkpoint
from .base import query

KEYS = ["pair_id", "damage_class", "epoch"]
K = "pair_id, damage_class, epoch"
RGBF = "(SELECT image_id, y, x, r/255 r, g/255 g, b/255 b, greatest(r,g,b)/255 val, (greatest(r,g,b)/255-least(r,g,b)/255) d FROM fx_rgb)"


def win(fn: str, v: str, r: int, source: str, out: str, keys: str = "image_id") -> str:
    """Two-pass k x k sliding aggregate as SQL."""
    return f"""(SELECT *, {fn}(s_) OVER (PARTITION BY {keys}, x ORDER BY y RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) {out} FROM (SELECT *, {fn}({v}) OVER (PARTITION BY {keys}, y ORDER BY x RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) s_ FROM {source}) q_)"""


def bh(v: str, r: int, source: str) -> str:
    a = "(SELECT * EXCLUDE (s_) FROM " + win("max", v, r, source, "m_") + " z_)"
    return f"(SELECT *, least(255, greatest(0, c_ - {v})) bh FROM {win('min', 'm_', r, a, 'c_')} y_)"


def labels_cte(source: str, keys: str, conn: int = 8, name: str = "lab") -> str:
    """Connected components by recursive propagation of scan positions."""
    on = " AND ".join(f"m.{k.strip()}=r.{k.strip()}" for k in keys.split(","))
    near = "abs(m.y-r.y)<=1 AND abs(m.x-r.x)<=1" if conn == 8 else "abs(m.y-r.y)+abs(m.x-r.x)=1"
    cols = ", ".join(f"m.{k.strip()}" for k in keys.split(","))
    return f"""{name}m AS (SELECT DISTINCT {keys}, y, x FROM {source}),
{name}r AS /* RECURSIVE */ (SELECT {keys}, y, x, y*2147483648+x lab FROM {name}m UNION SELECT {cols}, m.y, m.x, r.lab FROM {name}r r JOIN {name}m m ON {on} AND m.y BETWEEN r.y-1 AND r.y+1 AND {near} AND m.y*2147483648+m.x > r.lab),
{name} AS (SELECT {keys}, y, x, min(lab) AS "label" FROM {name}r GROUP BY {keys}, y, x)"""


BOX = "box AS (SELECT {k}, label, count(*) area, min(x) x0, min(y) y0, max(x) x1, max(y) y1, max(x)-min(x)+1 bw, max(y)-min(y)+1 bh FROM lab GROUP BY {k}, label)".format(k=K)
LAB = labels_cte("fx_masks", K)


def erode_sql(source: str, keys: str, out: str, r: int = 1, n: int = 32) -> str:
    on = " AND ".join(f"a.{k.strip()}=b.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{out} AS (SELECT {cols}, a.y, a.x FROM {source} a JOIN {source} b ON {on} AND b.y BETWEEN a.y-{r} AND a.y+{r} AND b.x BETWEEN a.x-{r} AND a.x+{r} GROUP BY {cols}, a.y, a.x
 HAVING count(*) = (least({n - 1}, a.y+{r})-greatest(0, a.y-{r})+1)*(least({n - 1}, a.x+{r})-greatest(0, a.x-{r})+1))"""


@query("e1_to_gray", "SELECT image_id, y, x, round(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b + 1.1e-8, 6) gray FROM fx_rgb", "fx_rgb")
def e1(fx):
    return ops.to_gray(fx.rgb).select("image_id", "y", "x", F.round(F.col("gray") + 1.1e-8, 6).alias("gray"))


HSV = f"""hsv AS (SELECT image_id, y, x, val, CASE WHEN val<=1e-6 THEN 0 ELSE d/greatest(val,1e-6) END sat,
 60*(CASE WHEN d<=1e-6 THEN 0 WHEN val=b THEN (r-g)/d+4 WHEN val=g THEN (b-r)/d+2 ELSE (g-b)/d - 6*floor((g-b)/d/6) END) hue FROM {RGBF} q)"""


@query("e2_to_hsv", "SELECT image_id, y, x, round(hue, 8) hue, round(sat, 9) sat, round(val, 9) val FROM hsv", "fx_rgb", HSV)
def e2(fx):
    return ops.to_hsv(fx.rgb).select("image_id", "y", "x", F.round("hue", 8).alias("hue"), F.round("sat", 9).alias("sat"), F.round("val", 9).alias("val"))


@query("e3_image_percentiles", "SELECT image_id, round(quantile_cont(g::DOUBLE, 0.02), 8) p2, round(quantile_cont(g::DOUBLE, 0.18), 8) p18, round(quantile_cont(g::DOUBLE, 0.45), 8) p45, round(quantile_cont(g::DOUBLE, 0.98), 8) p98 FROM fx_pixels GROUP BY 1", "fx_pixels")
def e3(fx):
    return ops.image_percentiles(fx.pixels, "g", [2, 18, 45, 98]).select("image_id", *[F.round(c, 8).alias(c) for c in ("p2", "p18", "p45", "p98")])


STRETCH = """pc AS (SELECT image_id, quantile_cont(g::DOUBLE, 0.02) p2, quantile_cont(g::DOUBLE, 0.98) p98 FROM fx_pixels GROUP BY 1),
st AS (SELECT p.*, CASE WHEN p98<=p2+1e-6 THEN g ELSE least(255, greatest(0, (g-p2)*least(2.4::DOUBLE, 255/(p98-p2)))) END gray FROM fx_pixels p JOIN pc USING (image_id))"""


@query("e4_contrast_stretch", "SELECT image_id, y, x, round(gray, 7) gray FROM st", "fx_pixels", STRETCH)
def e4(fx):
    return ops.contrast_stretch(fx.pixels).select("image_id", "y", "x", F.round("gray", 7).alias("gray"))


# Every image gets a flat frame of 3 to 7 pixels whose width depends on the image, so the detector has borders to find.
FRAMED = "SELECT image_id, y, x, CASE WHEN y < 3 + image_id % 5 OR x > 27 - image_id % 3 THEN 250 + (x+y) % 4 ELSE g END g FROM {px}"
RECT = """ln AS (SELECT image_id, 'y' a, y i, max(g)-min(g) r FROM framed GROUP BY image_id, y UNION ALL SELECT image_id, 'x', x, max(g)-min(g) FROM framed GROUP BY image_id, x),
sz AS (SELECT image_id, max(y)+1 h, max(x)+1 w FROM framed GROUP BY 1),
rn AS (SELECT image_id, h, w, least(floor(h*0.25), coalesce(min(i) FILTER (a='y' AND r>10), h)) t0, least(floor(h*0.25), coalesce(min(h-1-i) FILTER (a='y' AND r>10), h)) b0, least(floor(w*0.25), coalesce(min(i) FILTER (a='x' AND r>10), w)) l0, least(floor(w*0.25), coalesce(min(w-1-i) FILTER (a='x' AND r>10), w)) r0 FROM ln JOIN sz USING (image_id) GROUP BY 1,2,3),
pd AS (SELECT image_id, h, w, CASE WHEN t0>=3 THEN t0+2 ELSE 0 END t, CASE WHEN b0>=3 THEN b0+2 ELSE 0 END b, CASE WHEN l0>=3 THEN l0+2 ELSE 0 END l, CASE WHEN r0>=3 THEN r0+2 ELSE 0 END r FROM rn),
rect AS (SELECT image_id, f framed, CASE WHEN f THEN l ELSE 0 END::BIGINT x0, CASE WHEN f THEN t ELSE 0 END::BIGINT y0, (w-CASE WHEN f THEN r ELSE 0 END-1)::BIGINT x1, (h-CASE WHEN f THEN b ELSE 0 END-1)::BIGINT y1 FROM (SELECT *, t+b+l+r>0 AND t+b<h-8 AND l+r<w-8 f FROM pd) q)"""
FR = "framed AS (" + FRAMED.format(px="fx_pixels") + "),\n" + RECT


def framed(fx):
    return fx.spark.sql(FRAMED, px=fx.pixels)


@query("e5_frame_rect", "SELECT * FROM rect", "fx_pixels", FR)
def e5(fx):
    return ops.frame_rect(framed(fx))


@query("e6_clamp_to_rect", "SELECT p.image_id, p.y, p.x, s.g FROM framed p JOIN rect r USING (image_id) JOIN framed s ON s.image_id=p.image_id AND s.y=greatest(y0, least(y1, p.y)) AND s.x=greatest(x0, least(x1, p.x))", "fx_pixels", FR)
def e6(fx):
    return ops.clamp_to_rect(framed(fx), ops.frame_rect(framed(fx)), "g")


@query("e7_min_max_filter", f"SELECT a.image_id, a.y, a.x, a.lo, b.hi FROM {win('min', 'g', 2, 'fx_pixels', 'lo')} a JOIN {win('max', 'g', 2, 'fx_pixels', 'hi')} b USING (image_id, y, x)", "fx_pixels")
def e7(fx):
    return ops.max_filter(ops.min_filter(fx.pixels, "g", 5, "lo"), "g", 5, "hi").select("image_id", "y", "x", "lo", "hi")


@query("e7_open_close_mask", "SELECT * FROM opd", "fx_masks", "dm AS (SELECT DISTINCT " + K + ", y, x FROM fx_masks),\n" + erode_sql("dm", K, "er") + f",\nopd AS (SELECT DISTINCT {K}, y+dy y, x+dx x FROM er CROSS JOIN (SELECT unnest(range(-1,2)) dy) a CROSS JOIN (SELECT unnest(range(-1,2)) dx) b WHERE y+dy BETWEEN 0 AND 31 AND x+dx BETWEEN 0 AND 31)")
def e7b(fx):
    return C.opening(fx.masks, KEYS, 32, 32)


@query("e8_blackhat", f"SELECT image_id, y, x, bh::DOUBLE blackhat FROM {bh('g', 3, 'fx_pixels')} q", "fx_pixels")
def e8(fx):
    return ops.blackhat(fx.pixels, "g", 7).select("image_id", "y", "x", "blackhat")


@query("e9_roughness", """SELECT image_id, y, x, round(abs(g - avg(o) ), 8) rough FROM (SELECT a.image_id, a.y, a.x, a.g, b.g o FROM fx_pixels a JOIN fx_pixels b ON a.image_id=b.image_id AND b.y BETWEEN a.y-2 AND a.y+2 AND b.x BETWEEN a.x-2 AND a.x+2) q GROUP BY image_id, y, x, g""", "fx_pixels")
def e9(fx):
    return ops.roughness(fx.pixels, "g").select("image_id", "y", "x", F.round("rough", 8).alias("rough"))


@query("e10_histogram", """SELECT image_id, channel, bin, count(*) n FROM (SELECT image_id, unnest(['r','g','b','l']) channel, unnest([r, g, b, greatest(0, least(255, CAST(floor(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b+0.5) AS BIGINT)))]) bin FROM fx_rgb) q GROUP BY 1,2,3""", "fx_rgb")
def e10(fx):
    return ops.histogram(fx.rgb)


@query("e11_otsu", """SELECT image_id, channel, arg_min(bin, (-between_, bin)) threshold FROM (SELECT *, wb*(w-wb)*(sb/wb-(s-sb)/(w-wb))*(sb/wb-(s-sb)/(w-wb)) between_ FROM (SELECT image_id, channel, bin, (sum(n) OVER c)::DOUBLE wb, (sum(bin*n) OVER c)::DOUBLE sb, (sum(n) OVER a)::DOUBLE w, (sum(bin*n) OVER a)::DOUBLE s
 FROM (SELECT image_id, channel, bin, count(*) n FROM (SELECT image_id, unnest(['r','g','b']) channel, unnest([r, g, b]) bin FROM fx_rgb) q GROUP BY 1,2,3) h WINDOW c AS (PARTITION BY image_id, channel ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id, channel)) z WHERE w>wb) t GROUP BY 1,2""", "fx_rgb")
def e11(fx):
    return ops.otsu(ops.histogram(fx.rgb).where("channel <> 'l'"), ["image_id", "channel"])


OTSU = """gy AS (SELECT image_id, y, x, floor(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b+0.5) gray FROM fx_rgb),
hb AS (SELECT image_id, y, x, bh FROM """ + bh("gray", 3, "gy") + """ z),
bx AS (SELECT image_id, y, x, coalesce(lag(bh) OVER w, bh)+2*bh+coalesce(lead(bh) OVER w, bh) v FROM hb WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
bl AS (SELECT image_id, y, x, floor((coalesce(lag(v) OVER w, v)+2*v+coalesce(lead(v) OVER w, v))/16+0.5) v FROM bx WINDOW w AS (PARTITION BY image_id, x ORDER BY y)),
hs AS (SELECT image_id, v, count(*)::DOUBLE n FROM bl GROUP BY 1,2),
cu AS (SELECT *, sum(n) OVER o wb, sum(n*v) OVER o sb, sum(n) OVER (PARTITION BY image_id) w, sum(n*v) OVER (PARTITION BY image_id) s FROM hs WINDOW o AS (PARTITION BY image_id ORDER BY v)),
th AS (SELECT image_id, arg_max(v, (wb*(w-wb)*(sb/wb-(s-sb)/(w-wb))*(sb/wb-(s-sb)/(w-wb)), -v)) t FROM cu WHERE w>wb GROUP BY 1),
rw AS (SELECT image_id, y, x FROM bl JOIN th USING (image_id) WHERE v>t),
e1 AS (SELECT a.* FROM rw a LEFT JOIN rw b ON a.image_id=b.image_id AND a.y=b.y AND b.x=a.x+1 WHERE b.x IS NOT NULL OR a.x=31),
e2 AS (SELECT a.* FROM e1 a LEFT JOIN e1 b ON a.image_id=b.image_id AND a.x=b.x AND b.y=a.y+1 WHERE b.y IS NOT NULL OR a.y=31),
op AS (SELECT DISTINCT image_id, least(31, y+dy) y, least(31, x+dx) x FROM e2 CROSS JOIN (SELECT unnest([0,0,1,1]) dy, unnest([0,1,0,1]) dx) q),
""" + labels_cte("op", "image_id")


@query("e12_crack_candidates", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label)::INT AS \"rank\" FROM (SELECT image_id, label, count(*) area, min(x) x0, min(y) y0, max(x) x1, max(y) y1, max(x)-min(x)+1 bw, max(y)-min(y)+1 bh FROM lab GROUP BY 1,2 HAVING count(*)>=8) a) b WHERE \"rank\"<=120", "fx_rgb", OTSU)
def e12(fx):
    return ops.crack_candidates(fx.rgb, 32, 32, radius=3)


FAMILY = HSV + """,
lu AS (SELECT image_id, y, x, 0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b lum, r, g, b FROM fx_rgb),
lp AS (SELECT image_id, quantile_cont(lum, 0.02) p2, quantile_cont(lum, 0.98) p98 FROM lu GROUP BY 1),
ls AS (SELECT lu.*, least(255, greatest(0, (lum-p2)*least(2.4::DOUBLE, 255/(p98-p2)))) gray FROM lu JOIN lp USING (image_id)),
gq AS (SELECT image_id, quantile_cont(gray, 0.18) p18, quantile_cont(gray, 0.45) p45, quantile_cont(gray, 0.72) p72 FROM ls GROUP BY 1),
fb AS (SELECT a.image_id, a.y, a.x, a.r, a.g, a.b, a.gray, a.bh bhv, p18, p45, p72, hue, sat, val FROM """ + bh("gray", 3, "ls") + """ a JOIN gq USING (image_id) JOIN hsv USING (image_id, y, x)),
fam AS (SELECT image_id, y, x, bhv>35 cracks, gray<least(120, p18+8.75) OR (bhv>19.25 AND gray<p45) spalling_dark, r>g+12 AND r>b+18 AND sat>0.22 AND val>0.16 AND (hue<55 OR hue>330) corrosion_rust, val>0.72 AND sat<0.28 AND gray>p72 efflorescence_white FROM fb)"""


@query("e13_family_candidates", "SELECT image_id, y, x, cracks, spalling_dark, corrosion_rust, efflorescence_white FROM fam", "fx_rgb", FAMILY)
def e13(fx):
    return ops.family_candidates(fx.rgb, 35.0, 7).select("image_id", "y", "x", "cracks", "spalling_dark", "corrosion_rust", "efflorescence_white")


def labels(fx):
    return C.label_components(fx.masks, KEYS)


@query("e14_connected_components", "SELECT * FROM lab", "fx_masks", LAB)
def e14(fx):
    return labels(fx)


FEATURES = LAB + ",\n" + BOX + ",\n" + erode_sql("lab", K + ", label", "inn") + f""",
mo AS (SELECT {K}, label, avg(x) cx, avg(y) cy, atan2(2*round(covar_pop(x, y), 9)+0.0, round(var_pop(x)-var_pop(y), 9)+0.0)/2 th FROM lab GROUP BY {K}, label),
ax AS (SELECT {K}, label, cx, cy, max((x-cx)*cos(th)+(y-cy)*sin(th))-min((x-cx)*cos(th)+(y-cy)*sin(th)) axis_length FROM lab JOIN mo USING ({K}, label) GROUP BY {K}, label, cx, cy),
bd AS (SELECT {K}, label, count(*)::DOUBLE perimeter FROM lab l ANTI JOIN inn USING ({K}, label, y, x) GROUP BY {K}, label),
feat AS (SELECT box.*, cx, cy, axis_length, coalesce(perimeter, 0) perimeter, greatest(bw,bh)/greatest(1, least(bw,bh)) aspect, area/greatest(axis_length, 1e-6) width FROM box JOIN ax USING ({K}, label) LEFT JOIN bd USING ({K}, label))"""


@query("e15_component_features", f"SELECT {K}, label, area, x0, y0, x1, y1, round(cx, 8) cx, round(cy, 8) cy, round(axis_length, 6) axis_length, perimeter, round(aspect, 8) aspect FROM feat", "fx_masks", FEATURES)
def e15(fx):
    out = C.component_features(labels(fx), KEYS, 32, 32)
    return out.select(*KEYS, "label", "area", "x0", "y0", "x1", "y1", F.round("cx", 8).alias("cx"), F.round("cy", 8).alias("cy"), F.round("axis_length", 6).alias("axis_length"), "perimeter", F.round("aspect", 8).alias("aspect"))


@query("c3_change_records", "SELECT pair_id, damage_class, change, label, count(*) area, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM lab GROUP BY 1,2,3,4", "fx_masks", """
chg AS (SELECT pair_id, damage_class, 'growth' change, y, x FROM (SELECT pair_id, damage_class, y, x FROM fx_masks WHERE epoch='t1' EXCEPT SELECT pair_id, damage_class, y, x FROM fx_masks WHERE epoch='t0') a
 UNION ALL SELECT pair_id, damage_class, 'reduction', y, x FROM (SELECT pair_id, damage_class, y, x FROM fx_masks WHERE epoch='t0' EXCEPT SELECT pair_id, damage_class, y, x FROM fx_masks WHERE epoch='t1') b),
""" + labels_cte("chg", "pair_id, damage_class, change"))
def c3(fx):
    keys = ["pair_id", "damage_class", "change"]
    return C.component_boxes(C.label_components(temporal.change_pixels(fx.masks), keys), keys).drop("bw", "bh")


@query("e16_reconstruct_by_opening", f"SELECT l.* FROM lab l SEMI JOIN (SELECT DISTINCT {K}, label FROM inn) s USING ({K}, label)", "fx_masks", LAB + ",\n" + erode_sql("lab", K + ", label", "inn"))
def e16(fx):
    return ops.reconstruct_by_opening(labels(fx), KEYS, 32, 32).select(*KEYS, "y", "x", "label")


# A bright-region mask per image, labelled by image only.
BRIGHT = "br AS (SELECT image_id, y, x FROM fx_pixels WHERE g >= 165),\n" + labels_cte("br", "image_id")


def bright(fx):
    return C.label_components(fx.pixels.where("g >= 165"), ["image_id"])


@query("e17_filter_by_contrast", """
SELECT i.image_id, i.label, round(i.m, 8) inside_mean, round(r.m, 8) ring_mean, round(i.rm, 8) rough_mean, (r.m IS NULL OR i.m-r.m>=40) AND i.rm>=20 kept FROM
(SELECT l.image_id, l.label, avg(p.g) m, avg(rough) rm FROM lab l JOIN rg p USING (image_id, y, x) GROUP BY 1,2) i LEFT JOIN
(SELECT b.image_id, b.label, avg(p.g) m FROM (SELECT image_id, label, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM lab GROUP BY 1,2) b JOIN (SELECT * FROM fx_pixels ANTI JOIN lab USING (image_id, y, x)) p ON p.image_id=b.image_id AND p.x BETWEEN x0-7 AND x1+7 AND p.y BETWEEN y0-7 AND y1+7 GROUP BY 1,2) r USING (image_id, label)""",
       "fx_pixels", BRIGHT + """,
rg AS (SELECT image_id, y, x, g, abs(g-avg(o)) rough FROM (SELECT a.image_id, a.y, a.x, a.g, b.g o FROM fx_pixels a JOIN fx_pixels b ON a.image_id=b.image_id AND b.y BETWEEN a.y-2 AND a.y+2 AND b.x BETWEEN a.x-2 AND a.x+2) q GROUP BY 1,2,3,4)""")
def e17(fx):
    out = ops.filter_by_contrast(bright(fx), ops.roughness(fx.pixels, "g"), ["image_id"], 40.0, 1, "g", "rough", 20.0)
    return out.select("image_id", "label", *[F.round(c, 8).alias(c) for c in ("inside_mean", "ring_mean", "rough_mean")], "kept")


@query("e18_drop_small_border", """
SELECT l.* FROM lab l ANTI JOIN (SELECT image_id, label FROM lab GROUP BY 1,2 HAVING (min(x)<=3 OR max(x)>=28 OR min(y)<=3 OR max(y)>=28) AND count(*) < 0.01*28*28) g USING (image_id, label)""", "fx_pixels", BRIGHT)
def e18(fx):
    rects = fx.pixels.select("image_id").distinct().select("image_id", *[F.lit(v).cast("long").alias(n) for n, v in (("x0", 2), ("y0", 2), ("x1", 29), ("y1", 29))])
    return ops.drop_small_border(bright(fx), ["image_id"], rects).select("image_id", "y", "x", "label")


def morph(source: str, *steps: tuple[str, int]) -> str:
    """Erosions (min) and dilations (max) of a dense 0/1 raster ``(image_id, y, x, v)``."""
    out = source
    for fn, r in steps:
        out = "(SELECT image_id, y, x, w_ v FROM " + win(fn, "v", r, out, "w_") + " z_)"
    return out


def dense(name: str) -> str:
    """A set of pixels as a dense raster."""
    return f"(SELECT image_id, y, x, ({name}.y IS NOT NULL)::INT v FROM grid LEFT JOIN (SELECT image_id, y, x, true hit FROM {name}) {name} USING (image_id, y, x))".replace(f"({name}.y IS NOT NULL)", "coalesce(hit, false)")


def contrast_sql(lab: str, out: str, sign: str, delta: float, rough: bool) -> str:
    """Pixels of the components of ``lab`` that pass the contrast rule."""
    return f"""{out} AS (SELECT l.image_id, l.y, l.x FROM {lab} l JOIN (SELECT i.image_id, i.label FROM (SELECT l.image_id, l.label, avg(p.gray) m, avg(p.rough) rm FROM {lab} l JOIN pxm p USING (image_id, y, x) GROUP BY 1,2) i LEFT JOIN
 (SELECT b.image_id, b.label, avg(p.gray) m FROM (SELECT image_id, label, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM {lab} GROUP BY 1,2) b JOIN (SELECT * FROM pxm ANTI JOIN {lab} USING (image_id, y, x)) p ON p.image_id=b.image_id AND p.x BETWEEN x0-7 AND x1+7 AND p.y BETWEEN y0-7 AND y1+7 GROUP BY 1,2) r USING (image_id, label)
 WHERE (r.m IS NULL OR {sign}*(r.m-i.m)>={delta}) {"AND i.rm>=5" if rough else ""}) k ON k.image_id=l.image_id AND k.label=l.label)"""


def inner_sql(lab: str, out: str) -> str:
    return f"{out} AS (SELECT image_id, y, x FROM {lab} l ANTI JOIN (SELECT image_id, label FROM {lab} JOIN rc USING (image_id) GROUP BY 1,2 HAVING (min(x)<=1 OR max(x)>=any_value(xm)-1 OR min(y)<=1 OR max(y)>=any_value(ym)-1) AND count(*) < 0.01*(any_value(xm)+1)*(any_value(ym)+1)) g USING (image_id, label))"


CLEAN5 = (("min", 2), ("max", 2), ("max", 2), ("min", 2))
RUN = FAMILY.replace("fx_rgb", "fx_concrete") + f""",
rc AS (SELECT image_id, max(y) ym, max(x) xm FROM fam GROUP BY 1),
grid AS (SELECT image_id, y, x FROM rc CROSS JOIN (SELECT unnest(range(0,64)) y) a CROSS JOIN (SELECT unnest(range(0,64)) x) b),
pxm AS (SELECT f.image_id, f.y, f.x, l.gray, l.lum, abs(l.lum - m.bm) rough, h.sat, h.val FROM fam f JOIN ls l USING (image_id, y, x) JOIN hsv h USING (image_id, y, x) JOIN (SELECT image_id, y, x, sum(s_) OVER c / sum(n_) OVER c bm FROM (SELECT image_id, y, x, sum(lum) OVER r s_, count(*) OVER r n_ FROM ls WINDOW r AS (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)) q WINDOW c AS (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)) m USING (image_id, y, x)),
k0 AS (SELECT image_id, y, x FROM fam WHERE cracks), {labels_cte("k0", "image_id", name="lk")},
k1 AS (SELECT image_id, y, x FROM lk SEMI JOIN (SELECT DISTINCT image_id, label FROM lk JOIN {morph(dense("k0"), ("min", 1))} e USING (image_id, y, x) WHERE v=1) s USING (image_id, label)),
k2 AS (SELECT image_id, y, x FROM {morph(dense("k1"), ("max", 1), ("min", 1))} a WHERE v=1),
s0 AS (SELECT image_id, y, x FROM fam WHERE spalling_dark),
s1 AS (SELECT image_id, y, x FROM {morph(dense("s0"), *CLEAN5)} a WHERE v=1),
s2 AS (SELECT s1.* FROM s1 SEMI JOIN (SELECT * FROM {morph(dense("s1"), ("min", 4), ("max", 4), ("max", 3))} a WHERE v=1) g USING (image_id, y, x)), {labels_cte("s2", "image_id", name="l2")},
{contrast_sql("l2", "s3", "1", 42, True)},
s4 AS (SELECT image_id, y, x FROM {morph(dense("s3"), ("max", 5), ("min", 5))} a WHERE v=1), {labels_cte("s4", "image_id", name="l4")}, {inner_sql("l4", "s5")},
r0 AS (SELECT image_id, y, x FROM fam WHERE corrosion_rust),
r1 AS (SELECT image_id, y, x FROM {morph(dense("r0"), *CLEAN5)} a WHERE v=1), {labels_cte("r1", "image_id", name="lr")}, {inner_sql("lr", "r2")},
w0 AS (SELECT image_id, y, x FROM fam WHERE efflorescence_white),
w1 AS (SELECT image_id, y, x FROM {morph(dense("w0"), *CLEAN5)} a WHERE v=1), {labels_cte("w1", "image_id", name="lw")},
{contrast_sql("lw", "w2", "-1", 80, False)}, {labels_cte("w2", "image_id", name="lx")}, {inner_sql("lx", "w3")},
b0 AS (SELECT image_id, y, x FROM (SELECT p.*, quantile_cont(gray, 0.4) OVER (PARTITION BY image_id) p40 FROM pxm p SEMI JOIN s5 USING (image_id, y, x)) q WHERE gray<p40 OR (sat<0.2 AND val<0.55)),
b1 AS (SELECT image_id, y, x FROM {morph(dense("b0"), ("min", 1), ("max", 1), ("max", 1), ("min", 1))} a WHERE v=1)"""
for _name in "ls fam grid pxm k0 k1 s0 s1 s2 s3 s4 s5 r0 r1 r2 w0 w1 w2 w3 b0 b1 lk l2 l4 lr lw lx".split():  # read several times
    RUN = re.sub(rf"(?m)(^|, |\n){_name} AS \(", rf"\g<1>{_name} AS MATERIALIZED (", RUN)
STAGES = {"cracks": ("k0", "k1", "k2"), "spalling_dark": ("s0", "s1", "s5"), "corrosion_rust": ("r0", "r1", "r2"), "efflorescence_white": ("w0", "w1", "w3"), "exposed_rebar": ("b0", "b1", "b1")}
# Spalling regions that are mostly rust: their rust goes, the rest is opened, and rebar in them goes.
SPLIT = RUN + f""",
lz AS (SELECT l4.* FROM l4 SEMI JOIN s5 USING (image_id, y, x)),
af AS (SELECT image_id, y, x FROM lz SEMI JOIN (SELECT l.image_id, l.label FROM lz l LEFT JOIN (SELECT *, 1 hit FROM r2) r USING (image_id, y, x) GROUP BY 1,2 HAVING count(hit) >= 0.6*count(*)) q USING (image_id, label)),
rm AS (SELECT * FROM af ANTI JOIN r2 USING (image_id, y, x)),
ro AS (SELECT image_id, y, x FROM {morph(dense("rm"), ("min", 2), ("max", 2))} a WHERE v=1),
fin AS (SELECT image_id, 'cracks' damage_class, y, x FROM k2 ANTI JOIN r2 USING (image_id, y, x) UNION ALL SELECT image_id, 'corrosion_rust', y, x FROM r2 UNION ALL SELECT image_id, 'efflorescence_white', y, x FROM w3
 UNION ALL SELECT image_id, 'spalling_dark', y, x FROM (SELECT * FROM s5 ANTI JOIN af USING (image_id, y, x) UNION SELECT * FROM ro) z UNION ALL SELECT image_id, 'exposed_rebar', y, x FROM b1 ANTI JOIN af USING (image_id, y, x))"""


@query("e31_image_run_stages", " UNION ALL ".join(f"SELECT image_id, '{c}' damage_class, '{s}' stage, count(*) n FROM {t} GROUP BY 1" for c, ts in STAGES.items() for s, t in zip(("candidate", "clean", "mask"), ts)), "fx_concrete", RUN)
def e31(fx):
    """Pixels of every family after each stage of the image run."""
    return imagerun.family_masks(fx.concrete, 64, 64, 35.0, 7).groupBy("image_id", "damage_class", "stage").agg(F.count(F.lit(1)).alias("n"))


@query("e19_separate_families", "SELECT image_id, damage_class, count(*) n FROM fin GROUP BY 1,2", "fx_concrete", SPLIT)
def e19(fx):
    """Final masks of the image run."""
    return imagerun.image_run(fx.concrete, 64, 64, 35.0, 7).groupBy("image_id", "damage_class").agg(F.count(F.lit(1)).alias("n"))


@query("e32_image_run_rating")
def e32(fx):
    """From pixels to the rating of every image: masks, records, damage index and element rating."""
    records = imagerun.run_records(imagerun.image_run(fx.concrete, 64, 64, 35.0, 7), 64, 64)
    rated = checkpoint(rating.rate_damages(records, F.lit(4096.0)))
    images = fx.concrete.select("image_id").distinct()
    index = rating.gde(images, rated).select("image_id", F.round("gde", 8).alias("gde"), "gde_level")
    return rating.element_rating(images, rated).select("image_id", "n", F.round("affected_area_ratio", 9).alias("affected_area_ratio"), "element_rank", "ec", "nt").join(index, "image_id")


@query("e20_crack_fragments", f"SELECT l.* FROM lab l SEMI JOIN (SELECT {K}, label FROM box WHERE area>=3 AND (greatest(bw,bh)/greatest(1, least(bw,bh))>=2 OR area>=16)) k USING ({K}, label)", "fx_masks", LAB + ",\n" + BOX)
def e20(fx):
    return ops.crack_fragments(labels(fx), KEYS, 4.0).select(*KEYS, "y", "x", "label")


SKEL = f"""sk AS (SELECT DISTINCT {K}, y, x FROM fx_masks WHERE (x + 2*y) % 5 < 3),
nb AS (SELECT a.{K.replace(', ', ', a.')}, a.y, a.x, count(b.y) deg, bool_or(b.y=a.y AND b.x=a.x+1) rt, bool_or(b.y=a.y+1 AND b.x=a.x) dn, bool_or(b.y=a.y AND b.x=a.x-1) lf, bool_or(b.y=a.y+1 AND b.x=a.x+1) dr, bool_or(b.y=a.y+1 AND b.x=a.x-1) dl
 FROM sk a LEFT JOIN sk b ON a.pair_id=b.pair_id AND a.damage_class=b.damage_class AND a.epoch=b.epoch AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 AND NOT (a.y=b.y AND a.x=b.x) GROUP BY a.pair_id, a.damage_class, a.epoch, a.y, a.x)"""


@query("e21_skeleton_stats", f"""SELECT {K}, count(*) pixels, count(*) FILTER (deg=1) ends, count(*) FILTER (deg>=3) branches, round(sum(coalesce(rt,false)::INT + coalesce(dn,false)::INT) + sqrt(2.0::DOUBLE)*sum((coalesce(dr,false) AND NOT rt AND NOT dn)::INT + (coalesce(dl,false) AND NOT lf AND NOT dn)::INT), 6) length FROM nb GROUP BY {K}""", "fx_masks", SKEL)
def e21(fx):
    return ops.skeleton_stats(fx.masks.where("(x + 2*y) % 5 < 3"), KEYS).withColumn("length", F.round("length", 6))


@query("e21_thin_skeleton")
def e21b(fx):
    """Pruned skeletons of all masks, from their pixels."""
    return skeleton.prune_spurs(skeleton.thin(fx.masks.select(*KEYS, "y", "x"), KEYS), KEYS)


@query("e22_crack_measures")
def e22(fx):
    cracks = fx.masks.where("damage_class = 'cracks'")
    frag = ops.crack_fragments(C.label_components(cracks, KEYS), KEYS, 4.0)
    return ops.crack_measures(frag, None, KEYS, 32, 32, min_area=4.0)


IST = """im AS (SELECT image_id, y, x, r, g, b, 0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b l FROM fx_rgb),
i1 AS (SELECT *, lag(l) OVER a - 2*l + lead(l) OVER a h2, lag(l) OVER a + lead(l) OVER a h1 FROM im WINDOW a AS (PARTITION BY image_id, y ORDER BY x)),
i2 AS (SELECT *, h1+lag(l) OVER c + lead(l) OVER c - 4*l lap, lag(h2) OVER c - 2*h2 + lead(h2) OVER c nm, greatest(0, least(255, CAST(floor(l+0.5) AS BIGINT))) bin FROM i1 WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
i3 AS (SELECT image_id, avg(l) mean, stddev_pop(l) std, var_pop(lap) FILTER (nm IS NOT NULL) sharpness, avg(abs(nm))*sqrt(pi()/2)/6 noise, avg(CASE WHEN greatest(r,g,b)>0 THEN (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b) ELSE 0 END) saturation, avg(r) mean_r, avg(g) mean_g, avg(b) mean_b, 100*avg((bin<=4)::INT) clip_low_pct, 100*avg((bin>=251)::INT) clip_high_pct, count(*) n,
 quantile_disc(bin, 0.02) p2, quantile_disc(bin, 0.5) p50, quantile_disc(bin, 0.98) p98 FROM i2 GROUP BY 1),
ist AS (SELECT *, p98-p2 dynamic_range, mean_r/mean_g cast_rg, mean_b/mean_g cast_bg FROM i3)"""
STATNUM = ["mean", "std", "sharpness", "noise", "saturation", "mean_r", "mean_g", "mean_b", "clip_low_pct", "clip_high_pct", "cast_rg", "cast_bg"]


@query("e23_image_stats", "SELECT image_id, n, p2, p50, p98, dynamic_range, " + ", ".join(f"round({c} + 1.1e-8, 6) {c}" for c in STATNUM) + " FROM ist", "fx_rgb", IST)
def e23(fx):
    return ops.image_stats(fx.rgb).select("image_id", "n", "p2", "p50", "p98", "dynamic_range", *[F.round(F.col(c) + 1.1e-8, 6).alias(c) for c in STATNUM])


LEVEL = "CASE WHEN {0} THEN 'bad' WHEN {1} THEN 'warn' ELSE 'ok' END"
QUAL = IST + ",\nq0 AS (SELECT image_id, mean, 'warn' c1, " + ", ".join(f"{LEVEL.format(a, b)} {n}" for n, a, b in (
    ("c2", "sharpness<40", "sharpness<110"), ("c3", "mean<30 OR mean>225", "mean<55 OR mean>200"), ("c4", "greatest(clip_low_pct,clip_high_pct)>20", "greatest(clip_low_pct,clip_high_pct)>8"),
    ("c5", "dynamic_range<40", "dynamic_range<75"), ("c6", "noise>14", "noise>7"), ("c7", "greatest(abs(cast_rg-1),abs(cast_bg-1))>0.25", "greatest(abs(cast_rg-1),abs(cast_bg-1))>0.12"))) + " FROM ist),\n" + \
    "q1 AS (SELECT *, len(list_filter([c1,c2,c3,c4,c5,c6,c7], lambda s: s='bad')) nb, len(list_filter([c1,c2,c3,c4,c5,c6,c7], lambda s: s='warn')) nw FROM q0)"


@query("e24_assess_quality", "SELECT image_id, c1 resolution, c2 sharpness, c3 exposure, c4 clipping, c5 dynamic_range, c6 noise, c7 color_cast, greatest(0, 100-25*nb-8*nw)::BIGINT score, CASE WHEN nb>0 THEN 'bad' WHEN nw>0 THEN 'warn' ELSE 'ok' END verdict, (c6='bad' AND c5='bad') OR c2='bad' recapture, (CASE c6 WHEN 'bad' THEN 55 WHEN 'warn' THEN 30 END)::BIGINT denoise FROM q1", "fx_rgb", QUAL)
def e24(fx):
    out = ops.assess_quality(ops.image_stats(fx.rgb), 600, 800)
    names = ["resolution", "sharpness", "exposure", "clipping", "dynamic_range", "noise", "color_cast"]
    return out.select("image_id", *[F.col(f"check_{n}").alias(n) for n in names], "score", "verdict", "recapture", F.col("fix.denoise").alias("denoise"))


@query("e25_tone_lut", """
SELECT image_id, y, x, v(r) r, v(g) g, v(b) b FROM fx_rgb""".replace("v(r) r, v(g) g, v(b) b", ", ".join(
    "CAST(floor(255*pow(least(1, greatest(0, 0.7::DOUBLE*{0}+0.3::DOUBLE*(1/(1+exp(-5*({0}-0.5)))-1/(1+exp(2.5::DOUBLE)))/(1/(1+exp(-2.5::DOUBLE))-1/(1+exp(2.5::DOUBLE))))), 1/1.2::DOUBLE)+0.5) AS BIGINT) {1}".format(f"least(1, greatest(0, ({k}/255*pow(2, 0.5::DOUBLE)-0.5)*1.1::DOUBLE+0.5))", k) for k in "rgb")), "fx_rgb")
def e25(fx):
    lut = {k: ops.tone_lut(F.col(k), exposure=0.5, contrast=10.0, s_curve=30.0, gamma=1.2).alias(k) for k in "rgb"}
    return fx.rgb.select("image_id", "y", "x", *lut.values())


@query("e25_apply_correction", "SELECT image_id, 31-y y, 31-x x, r, g, b FROM (SELECT image_id, y, x, " + ", ".join(f"CAST(round_even(least(255, greatest(0, {k}*((sr+sg+sb)/3)/greatest(1, s{k}))), 0) AS BIGINT) {k}" for k in "rgb") + " FROM fx_rgb JOIN (SELECT image_id, sum(r)::DOUBLE sr, sum(g)::DOUBLE sg, sum(b)::DOUBLE sb FROM fx_rgb GROUP BY 1) s USING (image_id)) q", "fx_rgb")
def e25b(fx):
    return ops.apply_correction(fx.rgb, 32, 32, white_balance=True, rotate=180)


@query("e26_convex_hulls")
def e26(fx):
    from ..functions.geometry import polygon_area
    return C.convex_hulls(labels(fx), KEYS, 32, 32).select(*KEYS, "label", F.size("points").alias("vertices"), polygon_area(F.col("points")).alias("hull_area"))


@query("e27_mask_algebra", """
SELECT 'and' op, * FROM (SELECT pair_id, y, x FROM fx_masks WHERE damage_class='cracks' AND epoch='t1' INTERSECT SELECT pair_id, y, x FROM fx_masks WHERE damage_class='cracks' AND epoch='t0') a
UNION ALL SELECT 'or', * FROM (SELECT pair_id, y, x FROM fx_masks WHERE damage_class='cracks' AND epoch='t1' UNION SELECT pair_id, y, x FROM fx_masks WHERE damage_class='cracks' AND epoch='t0') b
UNION ALL SELECT 'and_not', * FROM (SELECT pair_id, y, x FROM fx_masks WHERE damage_class='cracks' AND epoch='t1' EXCEPT SELECT pair_id, y, x FROM fx_masks WHERE damage_class='cracks' AND epoch='t0') c""", "fx_masks")
def e27(fx):
    cracks = fx.masks.where("damage_class = 'cracks'")
    out = None
    for op in ("and", "or", "and_not"):
        part = ops.mask_algebra(cracks.where("epoch = 't1'"), cracks.where("epoch = 't0'"), op, ["pair_id"]).select(F.lit(op).alias("op"), "pair_id", "y", "x")
        out = part if out is None else out.unionByName(part)
    return out


@query("e28_resize_nearest", f"SELECT m.{K.replace(', ', ', m.')}, t.y, u.x FROM (SELECT DISTINCT {K}, y, x FROM fx_masks) m JOIN (SELECT i y, least(31, CAST(floor((i+0.5)*32/20) AS BIGINT)) s FROM (SELECT unnest(range(0,20)) i) a) t ON t.s=m.y JOIN (SELECT i x, least(31, CAST(floor((i+0.5)*32/48) AS BIGINT)) s FROM (SELECT unnest(range(0,48)) i) b) u ON u.s=m.x", "fx_masks")
def e28(fx):
    return ops.resize_nearest(fx.masks.select(*KEYS, "y", "x").distinct(), KEYS, (32, 32), (20, 48)).select(*KEYS, "y", "x")


@query("e29_mask_runs", f"""SELECT {K}, min(p) AS "start", count(*) length FROM (SELECT *, p - row_number() OVER (PARTITION BY {K} ORDER BY p) g FROM (SELECT DISTINCT {K}, y*32+x p FROM fx_masks) a) b GROUP BY {K}, g""", "fx_masks")
def e29(fx):
    return ops.mask_runs(fx.masks, KEYS, 32, 32)


@query("e29_rle", f"""SELECT {K}, array_to_string(list_concat(flatten(list_transform(r, lambda s, i: [s.s - CASE WHEN i=1 THEN 0 ELSE r[i-1].s+r[i-1].n END, s.n])), CASE WHEN 1024-(r[-1].s+r[-1].n)>0 THEN [1024-(r[-1].s+r[-1].n)] ELSE [] END), ',') counts FROM (
SELECT {K}, list({{'s': s, 'n': n}} ORDER BY s) r FROM (SELECT {K}, min(p) s, count(*) n FROM (SELECT *, p - row_number() OVER (PARTITION BY {K} ORDER BY p) g FROM (SELECT DISTINCT {K}, x*32+y p FROM fx_masks) a) b GROUP BY {K}, g) c GROUP BY {K}) d""", "fx_masks")
def e29b(fx):
    return ops.rle(fx.masks, KEYS, 32, 32).withColumn("counts", F.array_join("counts", ","))


@query("e30_region_outlines", """
SELECT b.image_id, b.label, 2-euler rings, 1-euler holes, sides::BIGINT sides, corners::BIGINT corners, pixels FROM (SELECT image_id, label, CAST((sum(one)-sum(three)-2*sum(two))/4 AS BIGINT) euler, sum(one)+sum(three)+2*sum(two) corners FROM (
 SELECT image_id, label, qy, qx, (count(*)=1)::BIGINT one, (count(*)=3)::BIGINT three, (count(*)=2 AND min(dy*2+dx) IN (0,1) AND max(dy*2+dx)=3-min(dy*2+dx))::BIGINT two FROM (SELECT image_id, label, y+dy qy, x+dx qx, 1-dy dy, 1-dx dx FROM lab CROSS JOIN (SELECT unnest([0,0,1,1]) dy, unnest([0,1,0,1]) dx) q) a GROUP BY 1,2,3,4) w GROUP BY 1,2) b
JOIN (SELECT image_id, label, count(*) pixels, 4*count(*)-sum(shared) sides FROM (SELECT l.image_id, l.label, (SELECT count(*) FROM labm m WHERE m.image_id=l.image_id AND abs(m.y-l.y)+abs(m.x-l.x)=1) shared FROM lab l) s GROUP BY 1,2) c USING (image_id, label)""", "fx_pixels", "om AS (SELECT image_id, y, x FROM fx_pixels WHERE g>=165),\n" + labels_cte("om", "image_id"))
def e30(fx):
    """Outlines of the bright regions, followed in small tiles so that most rings are stitched."""
    labels = C.label_components(fx.pixels.where("g >= 165").select("image_id", "y", "x"), ["image_id"])
    out = outlines.outline_summary(outlines.region_outlines(labels, ["image_id"], tile=16), ["image_id"])
    return out.withColumn("corners", F.col("corners").cast("long"))
