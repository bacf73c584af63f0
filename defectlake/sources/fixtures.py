"""Inspection-domain tables derived from the test-data tables.

Each derived table is one SQL text that Spark and DuckDB both run. Two macros cover the dialect differences:
``[[k 0 3]]`` multiplies rows by a fixed integer range and ``{table}`` names an input. Tables that need a different
physical shape in Spark (row identity without a global sort, previous/next row without one window per key) are built
by a function instead; the SQL text is then used by DuckDB only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_positions, shifted
from ..session import BROADCAST_ROWS, checkpoint

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
               "labels conversations").split()

_LINE_COLUMNS = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                 "l_returnflag l_linestatus l_shipdate").split()

# Text identity of a line item: money and rates as whole cents so both engines print the same digits.
_LINE_KEY = """md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
 CAST(l_linenumber AS STRING), CAST(CAST(floor(l_quantity*100+0.5) AS BIGINT) AS STRING),
 CAST(CAST(floor(l_extendedprice*100+0.5) AS BIGINT) AS STRING), CAST(CAST(floor(l_discount*100+0.5) AS BIGINT) AS STRING),
 CAST(CAST(floor(l_tax*100+0.5) AS BIGINT) AS STRING), l_returnflag, l_linestatus,
 CAST(CAST(l_shipdate AS DATE) AS STRING)))"""

SQL: dict[str, str] = {}

SQL["fx_lines"] = f"""
SELECT concat({_LINE_KEY}, '-', CAST(row_number() OVER (PARTITION BY {', '.join(_LINE_COLUMNS)} ORDER BY l_orderkey) AS STRING)) line_id, *
FROM {{lineitem}}"""

_DETECTIONS = """
SELECT {ID} image_id, engine_id, label, score, CAST(x1 AS DOUBLE) x1, CAST(y1 AS DOUBLE) y1, CAST(x1+w AS DOUBLE) x2, CAST(y1+h AS DOUBLE) y2, CAST(w*h AS DOUBLE) area_px FROM (
 SELECT {ID} l_orderkey % 500 image_id, concat('eng_', CAST(l_suppkey % 6 AS STRING)) engine_id,
  CASE l_partkey % 9 WHEN 0 THEN 'Cracks' WHEN 1 THEN 'rust  corrosion' WHEN 2 THEN 'water-leak' WHEN 3 THEN 'spall' WHEN 4 THEN 'Exposed_Rebar' WHEN 5 THEN 'severe distress zone' WHEN 6 THEN ' precipitation' WHEN 7 THEN 'graffiti tag' ELSE 'fissura' END label,
  CASE WHEN l_linenumber=7 THEN NULL ELSE CAST(CAST(floor(l_extendedprice*100) AS BIGINT) % 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) END score,
  (l_partkey % 4)*100 + l_linenumber*3 x1, (l_suppkey % 3)*90 + CAST(l_quantity AS BIGINT) % 7 y1, 40 + CAST(l_quantity AS BIGINT) w, 35 + l_linenumber h FROM {SRC}) d"""
SQL["fx_detections"] = _DETECTIONS.replace("{SRC}", "{fx_lines}").replace("SELECT {ID} image_id", "SELECT line_id det_id, image_id").replace("{ID}", "line_id,")
# The same rows without identity: aggregates read the line items directly, with no shuffle for the id.
SQL["fx_detections_anon"] = _DETECTIONS.replace("{SRC}", "{lineitem}").replace("{ID} ", "")

SQL["fx_runs"] = """
SELECT image_id, engine_id, CASE WHEN (image_id*7 + e) % 11 = 0 THEN 'error' WHEN (image_id*5 + e) % 13 = 0 THEN 'missing_weights' ELSE 'ok' END status,
 CAST((image_id*37 + e*101) % 900 + 20 AS DOUBLE) latency_ms
FROM (SELECT image_id, e, concat('eng_', CAST(e AS STRING)) engine_id FROM (SELECT DISTINCT l_orderkey % 500 image_id FROM {lineitem}) i [[e 0 5]]) r"""

_RECORDS = """
SELECT {ID} image_id, cls damage_class, tl time_label, q*q*3 area_px2, q*4+ln length_px, CASE WHEN ln%2=0 THEN q/CAST(4 AS DOUBLE) ELSE q/CAST(10 AS DOUBLE) END width_px, q*2+10 perimeter_px, px bbox_x, py bbox_y, CAST(20+q AS BIGINT) bbox_w, CAST(10+ln AS BIGINT) bbox_h, CASE WHEN image_id%3=0 THEN NULL ELSE CAST(0.25 AS DOUBLE) END mm_per_px FROM (
 SELECT {ID} l_orderkey % 3000 image_id,
 CASE l_partkey % 5 WHEN 0 THEN 'cracks' WHEN 1 THEN 'spalling_dark' WHEN 2 THEN 'exposed_rebar' WHEN 3 THEN 'corrosion_rust' ELSE 'efflorescence_white' END cls,
 CASE WHEN l_returnflag='R' THEN 't0_previous' ELSE 't1_current' END tl, l_quantity q, l_linenumber ln, (l_partkey*37)%1500 px, (l_suppkey*53)%1100 py FROM {SRC}) r"""
SQL["fx_records"] = _RECORDS.replace("{SRC}", "{fx_lines}").replace("SELECT {ID} image_id", "SELECT line_id record_id, image_id").replace("{ID}", "line_id,")
SQL["fx_records_anon"] = _RECORDS.replace("{SRC}", "{lineitem}").replace("{ID} ", "")

_INSPECTIONS_OUTER = """
SELECT inspection_id, asset_id, element_id, created_at, temporal, CASE WHEN temporal AND k<>3 THEN CASE WHEN k=0 THEN inspection_id + 1000000 WHEN k=1 THEN prev2 WHEN k=5 AND m=0 THEN next1 ELSE prev1 END END reference_origin_id,
 CASE WHEN k=0 AND m<2 THEN 'materialized_history' WHEN k=3 THEN NULL ELSE 'linked_inspection' END reference_storage, k=3 AND m<2 has_reference_image,
 inspection_id image_hash_key, CASE WHEN inspection_id % 29 = 0 THEN NULL WHEN inspection_id % 17 = 0 THEN -1 WHEN k=1 THEN prev2 WHEN k=5 AND m=0 THEN next1 ELSE prev1 END reference_hash_key, gde, gate_status
FROM """
_INSPECTIONS_COLUMNS = """o_orderkey inspection_id, CAST(c_nationkey AS BIGINT) asset_id, o_custkey element_id, o_orderdate created_at, o_orderpriority <> '5-LOW' temporal, o_orderkey % 6 k, CAST(floor(o_orderkey/6) AS BIGINT) % 4 m,
 round(o_totalprice/5000,2) gde, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'warning' ELSE 'fail' END gate_status"""
SQL["fx_inspections"] = _INSPECTIONS_OUTER + f"""(SELECT {_INSPECTIONS_COLUMNS},
  lag(o_orderkey,1) OVER w prev1, lag(o_orderkey,2) OVER w prev2, lead(o_orderkey,1) OVER w next1
  FROM {{orders}} JOIN {{customer}} ON o_custkey=c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) q"""

SQL["fx_points"] = """
SELECT line_id point_id, l_suppkey % 4 cloud_id, CAST(l_partkey AS DOUBLE)/CAST(20 AS DOUBLE) x, l_quantity y, CASE WHEN l_suppkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE l_discount*100 END z,
 CASE WHEN l_partkey%20<6 THEN 2 WHEN l_partkey%20<10 THEN 5 WHEN l_partkey%20<11 THEN 9 WHEN l_partkey%20<14 THEN 17 WHEN l_partkey%20<16 THEN 6 ELSE 40 END cls, CAST(floor(l_extendedprice) AS BIGINT) % 4096 intensity,
 l_partkey + l_linenumber code FROM {fx_lines}"""
SQL["fx_points_anon"] = SQL["fx_points"].replace("line_id point_id, ", "").replace("{fx_lines}", "{lineitem}")

SQL["fx_emb"] = "SELECT vec_id, CAST(unnest(range(0,64)) AS BIGINT) i, unnest(embedding) v FROM {embeddings}"
SQL["fx_pixels"] = """
SELECT image_id, y, x, least(255, greatest(0, CAST(floor(128 + v*400) AS BIGINT))) g FROM (
 SELECT CAST(floor(vec_id/16) AS BIGINT) image_id, CAST(floor((vec_id%16)/4) AS BIGINT)*8 + CAST(floor(i/8) AS BIGINT) y, (vec_id%4)*8 + i%8 x, CAST(v AS DOUBLE) v FROM {fx_emb}) p"""
SQL["fx_rgb"] = """
SELECT image_id, y, x, least(255, greatest(0, CAST(floor(128 + v*400) AS BIGINT))) r, least(255, greatest(0, CAST(floor(115 + v*260) AS BIGINT) + (x*5+y) % 9)) g, least(255, greatest(0, CAST(floor(100 + v*120) AS BIGINT))) b FROM (
 SELECT CAST(floor(vec_id/16) AS BIGINT) image_id, CAST(floor((vec_id%16)/4) AS BIGINT)*8 + CAST(floor(i/8) AS BIGINT) y, (vec_id%4)*8 + i%8 x, CAST(v AS DOUBLE) v FROM {fx_emb}) p"""
# Concrete of 64 x 64 pixels in tiles of 16: dark rough, rusty, white and dark rusty patches, and thin dark lines.
SQL["fx_concrete"] = """
SELECT image_id, y, x, least(255, greatest(0, CAST(floor(CASE k WHEN 0 THEN 45 + v*160 WHEN 1 THEN 170 + v*60 WHEN 2 THEN 240 + v*20 WHEN 3 THEN 95 + v*60 ELSE CASE WHEN y % 16 = 7 AND k = 4 THEN 55 ELSE 150 + v*40 END END) AS BIGINT))) r,
 least(255, greatest(0, CAST(floor(CASE k WHEN 0 THEN 45 + v*160 WHEN 1 THEN 95 + v*40 WHEN 2 THEN 238 + v*20 WHEN 3 THEN 55 + v*40 ELSE CASE WHEN y % 16 = 7 AND k = 4 THEN 55 ELSE 150 + v*40 END END) AS BIGINT))) g,
 least(255, greatest(0, CAST(floor(CASE k WHEN 0 THEN 45 + v*160 WHEN 1 THEN 60 + v*20 WHEN 2 THEN 230 + v*20 WHEN 3 THEN 40 + v*30 ELSE CASE WHEN y % 16 = 7 AND k = 4 THEN 55 ELSE 150 + v*40 END END) AS BIGINT))) b FROM (
 SELECT image_id, (ty*8 + cy)*2 + CAST(floor(d/2) AS BIGINT) y, (tx*8 + cx)*2 + CAST(d % 2 AS BIGINT) x, k, v FROM (
  SELECT CAST(floor(vec_id/16) AS BIGINT) image_id, CAST(floor((vec_id%16)/4) AS BIGINT) ty, vec_id%4 tx, CAST(floor(i/8) AS BIGINT) cy, i%8 cx, (vec_id*7 + CAST(floor(vec_id/16) AS BIGINT)*3) % 17 k, CAST(v AS DOUBLE) v, d FROM {fx_emb} e [[d 0 3]]) q) p"""
SQL["fx_frames"] = """
SELECT user_id session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) seq, ts, event_type label, CAST(floor(value) AS BIGINT) % 7 n, CAST(floor(value*100) AS BIGINT) % 900 + 20 latency_ms FROM {events}"""
SQL["fx_masks"] = """
SELECT image_id pair_id, 'cracks' damage_class, 't1' epoch, y, x FROM {fx_pixels} WHERE g >= 170 UNION ALL
SELECT image_id, 'cracks', 't0', y, x FROM {fx_pixels} WHERE g + ((x+y) % 9)*4 >= 180 UNION ALL
SELECT image_id, 'corrosion_rust', 't1', y, x FROM {fx_pixels} WHERE g <= 90 AND image_id % 4 <> 0 UNION ALL
SELECT image_id, 'corrosion_rust', 't0', y, x FROM {fx_pixels} WHERE g <= 84 AND image_id % 5 <> 0"""
SQL["fx_probs"] = """
SELECT image_id, y, x, CAST(g AS DOUBLE)/CAST(255 AS DOUBLE) prob, g + (x*7+y*3) % 60 > 185 gt, CASE WHEN image_id % 3 = 0 THEN 'val' ELSE 'test' END split FROM {fx_pixels}"""
SQL["fx_logits"] = """
SELECT image_id, y, x, class_id, CAST((g*(class_id+3) + x*11 + y*7*class_id) % 97 AS DOUBLE)/CAST(16 AS DOUBLE) logit FROM {fx_pixels} p [[class_id 0 3]]"""
SQL["fx_scene"] = """
SELECT image_id, cell_y, cell_x, class_id, CAST(min(g) AS DOUBLE)/CAST(160 AS DOUBLE) conf FROM (
 SELECT image_id, g, CAST(floor(y/4) AS BIGINT) cell_y, CAST(floor(x/4) AS BIGINT) cell_x, (image_id + CAST(floor(y/8) AS BIGINT)*2 + CAST(floor(x/8) AS BIGINT)) % 6 class_id FROM {fx_pixels}) c
GROUP BY image_id, cell_y, cell_x, class_id"""
SQL["fx_votes"] = """
SELECT point_id, view_id, class_id, CASE view_id WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.8 AS DOUBLE) WHEN 2 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END weight FROM (
 SELECT point_id, CAST(view_id AS BIGINT) view_id, (code*7 + view_id*view_id*3) % 8 class_id FROM {fx_points} p [[view_id 0 3]]) t WHERE class_id < 5"""
SQL["fx_poses"] = """
SELECT CAST(view_id AS BIGINT) view_id, CAST(800 AS DOUBLE) fx, CAST(800 AS DOUBLE) fy, CAST(400 AS DOUBLE) cx, CAST(300 AS DOUBLE) cy, CAST(800 AS BIGINT) w, CAST(600 AS BIGINT) h, CAST(1 AS DOUBLE) r00, CAST(0 AS DOUBLE) r01, CAST(0 AS DOUBLE) r02, CAST(0 AS DOUBLE) r10, CAST(1 AS DOUBLE) r11, CAST(0 AS DOUBLE) r12, CAST(0 AS DOUBLE) r20, CAST(0 AS DOUBLE) r21, CAST(1 AS DOUBLE) r22, CAST(-50 + view_id*5 AS DOUBLE) tx, CAST(-25 AS DOUBLE) ty, CAST(60 + view_id*10 AS DOUBLE) tz, CAST(0.01 AS DOUBLE)*view_id k1, CAST(0 AS DOUBLE) k2, CAST(0 AS DOUBLE) p1, CAST(0 AS DOUBLE) p2, CAST(0 AS DOUBLE) k3, CAST(1.2 AS DOUBLE)+view_id rmse_px, CAST(18 - view_id AS BIGINT) inliers, CAST(20 AS BIGINT) correspondences FROM (SELECT 1 one) o [[view_id 0 3]]"""
SQL["fx_spatial_records"] = """
SELECT CAST(year(o_orderdate) AS BIGINT) campaign_id, o_orderkey record_id, CASE o_custkey % 5 WHEN 0 THEN 'cracks' WHEN 1 THEN 'spalling_dark' WHEN 2 THEN 'exposed_rebar' WHEN 3 THEN 'corrosion_rust' ELSE 'efflorescence_white' END damage_class, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 40 END host_id,
 CAST(o_custkey % 60 AS DOUBLE) + CAST(o_orderkey % 10 AS DOUBLE)/CAST(20 AS DOUBLE) x, CAST(floor(o_custkey/60) AS DOUBLE) + CAST(o_orderkey % 7 AS DOUBLE)/CAST(20 AS DOUBLE) y, CAST(o_custkey % 3 AS DOUBLE) z, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice/1000,2) END metric_value,
 CASE WHEN o_orderkey % 5 = 0 THEN 'length' ELSE 'area' END metric_kind, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'mm2' END metric_unit, o_orderkey % 13 <> 0 metric_comparable, CASE WHEN year(o_orderdate) = 1994 THEN NULL ELSE concat(CAST(2100 - year(o_orderdate) AS STRING), '-06-01') END observed_at FROM {orders}"""
SQL["fx_alignment"] = """
SELECT CAST(seq AS BIGINT) seq, CAST(seq*12 AS DOUBLE) x, CAST((seq*seq) % 7 AS DOUBLE) y, CAST(1 AS DOUBLE) z FROM (SELECT 1 one) o [[seq 0 5]]"""
SQL["fx_triangles"] = """
SELECT s_suppkey element_id, concat('elem_', CAST(s_suppkey AS STRING)) global_id, tri, x0 ax, y0 ay, z0 az, CASE WHEN tri=0 THEN x0+4 ELSE x0 END bx, CASE WHEN tri=0 THEN y0 ELSE y0+2 END by_, z0 bz, x0+4 cx, y0+2 cy, z0 cz FROM (
 SELECT s_suppkey, CAST(tri AS BIGINT) tri, CAST((s_suppkey % 15)*4 AS DOUBLE) x0, CAST(floor(s_suppkey/15)*2 AS DOUBLE) y0, CAST(s_suppkey % 3 AS DOUBLE) z0 FROM {supplier} s [[tri 0 1]]) q"""
SQL["fx_annotations"] = """
SELECT p_partkey ann_id, p_partkey % 50 image_id, CASE p_partkey % 7 WHEN 0 THEN 'structure' WHEN 1 THEN 'irrelevant' WHEN 2 THEN 'spalling_dark' WHEN 3 THEN 'exposed_rebar' WHEN 4 THEN 'corrosion_rust' WHEN 5 THEN 'efflorescence_white' ELSE 'cracks' END cls, CASE p_size % 4 WHEN 0 THEN 'suggested' WHEN 1 THEN 'manual' WHEN 2 THEN 'accepted' ELSE 'rejected' END status, CAST(seq AS BIGINT) seq, CAST(p_partkey % 80 + CASE seq WHEN 1 THEN p_size WHEN 2 THEN p_size + 6 WHEN 3 THEN 4 ELSE 0 END AS DOUBLE) px, CAST(p_partkey % 60 + CASE seq WHEN 2 THEN p_size WHEN 3 THEN p_size + 5 ELSE 0 END AS DOUBLE) py FROM {part} p [[seq 0 3]]"""
SQL["fx_measures"] = """
SELECT record_id case_id, damage_class, 'area_px2' metric, area_px2 a, area_px2 + CAST(CAST(length_px AS BIGINT) % 5 AS DOUBLE) - 2 b FROM {fx_records}"""
SQL["fx_measures_anon"] = SQL["fx_measures"].replace("record_id case_id, ", "").replace("{fx_records}", "{fx_records_anon}")
SQL["fx_snapshots"] = """
SELECT inspection_id, asset_id, element_id, created_at, CASE k WHEN 0 THEN 'cracks' WHEN 1 THEN 'spalling_dark' ELSE 'corrosion_rust' END damage_class, CAST(100 + (inspection_id*13 + k*71) % 900 AS DOUBLE) area_px2, CASE WHEN inspection_id % 3 = 0 THEN NULL ELSE CAST(0.25 AS DOUBLE) END mm_per_px, CASE WHEN (inspection_id + k) % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(90 + (inspection_id*17 + k*31) % 900 AS DOUBLE) END previous_area_px2 FROM {fx_inspections} i [[k 0 2]]"""

SQL["fx_catalog"] = """
SELECT CASE WHEN p_partkey = 1 THEN 'cdm_1' ELSE concat('engine_', CAST(p_partkey AS STRING)) END id, p_name name, p_brand family, CASE p_size % 3 WHEN 0 THEN 'semantic_segmentation' WHEN 1 THEN 'detection' ELSE 'classification' END task,
 p_type description, CASE p_partkey % 6 WHEN 0 THEN 'public_shm_checkpoint' WHEN 1 THEN 'zero_shot' WHEN 2 THEN 'classical' WHEN 3 THEN 'shm_checkpoint' WHEN 4 THEN 'generic_pretrained' ELSE 'optional_runtime' END domain_mode,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('group_', CAST(p_size % 5 AS STRING)) END catalog_group, CASE WHEN p_partkey % 10 = 3 THEN 'always' ELSE 'default' END catalog_visibility,
 p_partkey % 7 = 0 catalog_owned, p_partkey % 5 = 0 recommended, p_partkey % 11 = 0 cloud_verified, p_partkey % 9 = 0 browser_ready FROM {part}"""

_RANGE = re.compile(r"\[\[(\w+) (\d+) (\d+)\]\]")
_NAME = re.compile(r"\{(\w+)\}")
_ROUND = re.compile(r"round\((\w+/\d+),\s*(\d+)\)")


def _spark_text(text: str) -> str:
    # Spark rounds the decimal digits of a double, DuckDB the scaled double: 153.545 is 153.55 or, scaled to 15354.499..., 153.54.
    text = _ROUND.sub(lambda m: f"round({m[1]}*{10 ** int(m[2])}.0D, 0)/{10 ** int(m[2])}.0D", text)
    return _RANGE.sub(lambda m: f"LATERAL VIEW explode(sequence({m[2]}, {m[3]})) lv_{m[1]} AS {m[1]}", text)


def _duck_text(text: str) -> str:
    text = _RANGE.sub(lambda m: f"CROSS JOIN (SELECT unnest(range({m[2]}, {int(m[3]) + 1})) {m[1]}) lv_{m[1]}", text)
    return _NAME.sub(lambda m: m[1], text)


def dependencies(name: str) -> list[str]:
    """Derived tables that ``name`` needs, in definition order, itself last."""
    need: set[str] = set()

    def walk(n: str) -> None:
        if n in SQL and n not in need:
            need.add(n)
            for m in _NAME.finditer(SQL[n]):
                walk(m[1])

    walk(name)
    return [n for n in SQL if n in need]


def duck_ctes(*names: str) -> str:
    """``name AS (…)`` list for the WITH clause of an oracle query."""
    wanted = {d for n in names for d in dependencies(n)}
    return ",\n".join(f"{n} AS ({_duck_text(SQL[n])})" for n in SQL if n in wanted)


# Copies beyond this number are generated by several tasks instead of one.
_COPY_CHUNK = 1_000_000


def _lines(lineitem: DataFrame) -> DataFrame:
    """Give every line item a stable id without sorting the table.

    The id is a digest of the whole row plus a copy number. Hashes of rows are counted first: a row whose hash comes once is
    the only copy and is not shuffled. Equal rows are counted (partial aggregation on the map side) and the copies generated
    again, so no task ever holds a group of equal rows.
    """
    hashed = F.xxhash64(*_LINE_COLUMNS).alias("_hash")
    again = checkpoint(lineitem.groupBy(hashed).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("_hash"))
    repeated = again.count()
    if not repeated:
        return _named(lineitem.select(*_LINE_COLUMNS, F.lit(1).cast("long").alias("copy")))
    if repeated > BROADCAST_ROWS:
        return _named(_copies(lineitem))
    rows, again = lineitem.select(*_LINE_COLUMNS, hashed), F.broadcast(again)
    once = rows.join(again, "_hash", "left_anti").select(*_LINE_COLUMNS, F.lit(1).cast("long").alias("copy"))
    return _named(once.unionByName(_copies(rows.join(again, "_hash", "left_semi"))))


def _copies(lineitem: DataFrame) -> DataFrame:
    """The rows with a number among equal ones."""
    counted = lineitem.groupBy(*_LINE_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    few = counted.where(F.col("n") <= _COPY_CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    many = (counted.where(F.col("n") > _COPY_CHUNK)
            .withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(_COPY_CHUNK).cast("long"))))
            .repartition("first")
            .withColumn("copy", F.explode(F.sequence("first", F.least("n", F.col("first") + _COPY_CHUNK - 1))))
            .drop("first"))
    return few.unionByName(many).select(*_LINE_COLUMNS, "copy")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.expr(f"concat({_LINE_KEY}, '-', CAST(copy AS STRING))").alias("line_id"), *_LINE_COLUMNS)


class Fixtures:
    """Lazily built input and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        key = name if name in BASE_TABLES else f"fx_{name}"
        if key not in BASE_TABLES and key not in SQL:
            raise AttributeError(name)
        return self.table(key)

    def table(self, key: str) -> DataFrame:
        if key not in self._frames:
            self._frames[key] = self._build(key)
        return self._frames[key]

    def _build(self, key: str) -> DataFrame:
        if key in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{key}.parquet")
        if key == "fx_lines":
            return _lines(self.lineitem)
        if key == "fx_emb":
            return self.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v")).select(
                "vec_id", F.col("i").cast("long").alias("i"), "v")
        if key == "fx_inspections":
            return self._inspections()
        if key == "fx_frames":
            return self._stream_frames()
        names = {m[1] for m in _NAME.finditer(SQL[key])}
        return self.spark.sql(_spark_text(SQL[key]), **{n: self.table(n) for n in names})

    def _inspections(self) -> DataFrame:
        """Previous and next inspection of an element by position joins: a long history is spread over its months."""
        rows = self.spark.sql(f"SELECT {_spark_text(_INSPECTIONS_COLUMNS)} FROM {{orders}} JOIN {{customer}} ON o_custkey=c_custkey",
                              orders=self.orders, customer=self.customer)
        placed = checkpoint(ordered_positions(rows, ["element_id"], ["created_at", "inspection_id"], F.trunc("created_at", "month")))
        rows = placed
        for name, step in (("prev1", -1), ("prev2", -2), ("next1", 1)):
            rows = shifted(rows, placed, ["element_id"], step, {"inspection_id": name})
        return self.spark.sql(_INSPECTIONS_OUTER + "{rows}", rows=rows)

    def _stream_frames(self) -> DataFrame:
        rows = ordered_positions(self.events, ["user_id"], ["ts", "event_id"], F.col("ts").cast("date"), position="seq")
        return rows.selectExpr("user_id session_id", "seq", "ts", "event_type label", "CAST(floor(value) AS BIGINT) % 7 n",
                               "CAST(floor(value*100) AS BIGINT) % 900 + 20 latency_ms")
