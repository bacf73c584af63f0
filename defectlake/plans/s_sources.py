"""Registered queries: sources and sinks as rows (S)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import las_ranges, readers, schemas, writers
from .a_consensus import CANON, CLEAN
from .base import query
from .d_campaign import CHAIN, EDGES, EVENTS
from .j_annotations import record_shapes


FILE_POINTS = 200_000  # about as many records go to one file, which one task writes


def scratch(fx, name: str) -> str:
    return f"{ensure_checkpoint_dir(fx.spark)}/{name}-{uuid4().hex}"


@query("s1_read_inspection_tables", "SELECT inspection_id, asset_id, element_id, created_at, temporal, reference_origin_id, reference_storage, has_reference_image, gde, gate_status, NULL::VARCHAR source_id FROM fx_inspections", "fx_inspections")
def s1(fx):
    """Stored tables written and read back; the files lack a column that the declared schema has."""
    folder = scratch(fx, "tables")
    for name in schemas.TABLES:
        rows = fx.inspections if name == "inspections" else fx.spark.createDataFrame([], schemas.TABLES[name])
        rows.write.parquet(f"{folder}/{name}")
    out = readers.read_inspection_tables(fx.spark, folder)["inspections"]
    return out.select("inspection_id", "asset_id", "element_id", "created_at", "temporal", "reference_origin_id", "reference_storage", "has_reference_image", "gde", "gate_status", "source_id")


@query("s2_catalog_dimension", "SELECT domain_mode, catalog_group, count(*) engines, count(*) FILTER (recommended) recommended FROM fx_catalog GROUP BY 1,2", "fx_catalog")
def s2(fx):
    """Catalog documents of up to a few hundred engines each, written and read back."""
    path = scratch(fx, "catalog")
    documents = F.greatest(F.lit(1), F.lit(fx.catalog.count() // 200))
    engine = F.struct(*[f.name for f in schemas.CATALOG_ENGINE.fields])
    text = fx.catalog.groupBy(F.pmod(F.hash("id"), documents)).agg(F.to_json(F.struct(F.collect_list(engine).alias("engines"))).alias("value"))
    text.select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = readers.read_catalog(fx.spark, path)
    return rows.groupBy("domain_mode", "catalog_group").agg(F.count(F.lit(1)).alias("engines"), F.count_if("recommended").alias("recommended"))


XYZ = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 6 WHEN 0 THEN '# comment' WHEN 1 THEN concat(CAST(l_partkey AS STRING), ';', CAST(l_suppkey AS STRING), ', x') WHEN 2 THEN concat(CAST(l_partkey AS STRING), ' ', CAST(l_suppkey AS STRING)) WHEN 3 THEN concat(' ', CAST(l_partkey AS STRING), ', ', CAST(l_suppkey AS STRING), ';', CAST(l_linenumber AS STRING), ' 10 20 30 7') ELSE concat(CAST(l_partkey AS STRING), ' ', CAST(l_suppkey AS STRING), ' ', CAST(l_linenumber AS STRING), ' 5') END value FROM {l}"


@query("s3_read_xyz", "SELECT valid, has_rgb, count(*) n, sum(z) z_sum, sum(intensity) intensity_sum FROM (SELECT k>=3 valid, k=3 has_rgb, CASE WHEN k>=3 THEN l_linenumber::DOUBLE END z, CASE WHEN k=3 THEN 7 WHEN k>3 THEN 5 END::DOUBLE intensity FROM (SELECT l_linenumber, l_partkey%6 k FROM lineitem) a WHERE k>0) b GROUP BY 1,2")
def s3(fx):
    out = readers.parse_xyz(fx.spark.sql(XYZ, l=fx.lineitem))
    return out.groupBy("valid", F.col("r").isNotNull().alias("has_rgb")).agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("z_sum"), F.sum("intensity").alias("intensity_sum"))


@query("s3_read_las", """
SELECT l_suppkey % 20 file, count(*) n, round(sum(x), 2) x, round(sum(y), 2) y, round(sum(z), 2) z, sum(intensity)::BIGINT intensity, sum(cls)::BIGINT classes, sum(r)::BIGINT r FROM (
 SELECT l_suppkey, l_partkey*0.01::DOUBLE+1000 x, l_linenumber*0.01::DOUBLE-50 y, l_suppkey*0.01::DOUBLE z, l_partkey % 65536 intensity, l_linenumber % 32 cls, l_partkey % 256 r FROM lineitem) q GROUP BY 1""")
def s3b(fx):
    """Line items as the points of LAS files (format 2), written by the tasks and parsed again."""
    import struct

    import pyarrow as pa

    def build(key, rows):
        head = bytearray(227)
        head[:4], head[24], head[25] = b"LASF", 1, 2
        struct.pack_into("<I", head, 96, 227)
        struct.pack_into("<BHI", head, 104, 2, 26, rows.num_rows)
        struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 1000.0, -50.0, 0.0)
        points = b"".join(struct.pack("<iiiHBBBBHHHH", p, n, s, p % 65536, 0, n % 32, 0, 0, 0, p % 256, 0, 0) for p, n, s in zip(*(rows.column(c).to_pylist() for c in ("l_partkey", "l_linenumber", "l_suppkey"))))
        return pa.table({"path": [str(key[0].as_py())], "content": pa.array([bytes(head) + points], pa.binary())})

    # A file holds some thousand points: the number of files grows with the table.
    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.greatest(F.lit(1), F.lit(fx.lineitem.count() // 100_000)))
    rows = fx.lineitem.select((F.col("l_suppkey") % 20).alias("f"), part.alias("p"), "l_partkey", "l_linenumber", "l_suppkey")
    files = rows.groupBy("f", "p").applyInArrow(build, "path string, content binary")
    points = readers.parse_las(files).where("error is null")
    out = points.groupBy(F.col("path").cast("long").alias("file")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 2).alias(c) for c in "xyz"], F.sum("intensity").alias("intensity"), F.sum("cls").alias("classes"), F.sum("r").alias("r"))
    return out


@query("s3_read_las_ranges", """
SELECT l_suppkey % 5 file, count(*) n, count(DISTINCT l_orderkey*8+l_linenumber) points, round(sum(x), 2) x, round(sum(y), 2) y, sum(intensity)::BIGINT intensity, sum(cls)::BIGINT classes FROM (
 SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey*0.01::DOUBLE+1000 x, l_orderkey*0.01::DOUBLE-50 y, l_partkey % 65536 intensity, l_linenumber % 32 cls FROM lineitem) q GROUP BY 1""")
def s3c(fx):
    """Line items as LAS files in five folders, read in ranges of 200,000 bytes; a file is written by one task and holds about 200,000 records.

    Records go out as lines: both they and the header end in a zero byte, which stands for the end of a line.
    """
    import struct

    import pyarrow as pa

    def head(count):
        out = bytearray(227)
        out[:4], out[24], out[25] = b"LASF", 1, 2
        struct.pack_into("<I", out, 96, 227)
        struct.pack_into("<BHI", out, 104, 2, 26, count)
        struct.pack_into("<6d", out, 131, 0.01, 0.01, 0.01, 1000.0, -50.0, 0.0)
        return bytes(out)

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            lines = [head(c) if k == 0 else struct.pack("<iiiHBBBBHHHH", p, o, s, p % 65536, 0, n % 32, 0, 0, 0, p % 256, 0, 0) for _, _, k, c, p, o, s, n in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[:-1] for x in lines], pa.binary())], ["file", "part", "record"])

    path = scratch(fx, "las")
    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1 + fx.lineitem.count() // (5 * FILE_POINTS)))
    rows = fx.lineitem.select((F.col("l_suppkey") % 5).alias("file"), part.alias("part"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), *[F.col(c).cast("long").alias(c) for c in ("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")])
    first = rows.groupBy("file", "part").agg(F.lit(0).alias("kind"), F.count(F.lit(1)).alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")])
    dealt = rows.union(first).repartition("file", "part").sortWithinPartitions("file", "part", "kind")
    lines = dealt.mapInArrow(run, "file long, part long, record binary").select("file", "part", F.col("record").cast("string").alias("record"))
    lines.write.option("lineSep", "\x00").partitionBy("file", "part").text(path)
    points = las_ranges.read_las_ranges(fx.spark, path, 200_000).where("error is null")
    order = F.round((F.col("y") + 50) * 100).cast("long") * 8 + F.col("cls")
    return points.groupBy(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(order).alias("points"), *[F.round(F.sum(c), 2).alias(c) for c in "xy"], F.sum("intensity").alias("intensity"), F.sum("cls").alias("classes"))


@query("s4_list_assets")
def s4(fx):
    return readers.list_assets(fx.spark, fx.folder).select("name", "kind", "bytes", "sha256")


@query("s5_stride_sample", "SELECT cloud_id, point_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id)-1 k, ceil(count(*) OVER (PARTITION BY cloud_id)/1000.0::DOUBLE)::BIGINT s FROM fx_points) q WHERE k % s = 0", "fx_points")
def s5(fx):
    return readers.stride_sample(fx.points.select("cloud_id", "point_id", "x", "y", "z"), ["cloud_id"], "point_id", F.substring("point_id", 1, 2), 1000)


@query("s6_comparison_rows", f"""
SELECT r.image_id, r.engine_id, status, latency_ms, coalesce(n, 0) detections, label, canonical_label, score, x1, y1, x2, y2, area_px FROM fx_runs r LEFT JOIN (SELECT image_id, engine_id, count(*) n FROM fx_detections_anon GROUP BY 1,2) k USING (image_id, engine_id)
LEFT JOIN (SELECT *, {CANON} canonical_label FROM (SELECT *, {CLEAN} c FROM fx_detections_anon) a) d USING (image_id, engine_id)""", "fx_runs fx_detections_anon")
def s6(fx):
    return writers.comparison_rows(fx.runs, fx.detections_anon)


@query("s7_record_rows", "SELECT record_id, time_label, damage_class, bbox_x, bbox_y, bbox_w, bbox_h, printf('%.2f', area_px2) area_px2, CASE WHEN mm_per_px IS NOT NULL THEN printf('%.4f', area_px2*mm_per_px*mm_per_px) END area_mm2, printf('%.2f', perimeter_px) perimeter_px, CASE WHEN mm_per_px IS NOT NULL THEN printf('%.4f', length_px*mm_per_px) END length_mm FROM fx_records", "fx_records")
def s7(fx):
    return writers.record_rows(fx.records).select("record_id", "time_label", "damage_class", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area_px2", "area_mm2", "perimeter_px", "length_mm")


@query("s8_campaign_events", """
SELECT 'condition' record_type, inspection_id::VARCHAR inspection_id, NULL pathology, 'GDE_img' metric, round(gde, 8) AS value, NULL unit, NULL chain_status, NULL quality_status FROM fx_inspections
UNION ALL SELECT 'snapshot_pathology_area', inspection_id::VARCHAR, damage_class, 'affected_area', round(area_px2*mm_per_px*mm_per_px, 8), 'mm2', NULL, NULL FROM (SELECT *, count(*) OVER (PARTITION BY asset_id, element_id, damage_class) k FROM fx_snapshots WHERE mm_per_px>0) q WHERE k>=2
UNION ALL SELECT 'temporal', inspection_id::VARCHAR, damage_class, 'net_area_change', round(coalesce(net_mm2, net_px2), 8), CASE WHEN net_mm2 IS NOT NULL THEN 'mm2' ELSE 'px2' END, e.status, e.gate_status FROM ev JOIN edges e USING (inspection_id)
UNION ALL SELECT 'temporal', inspection_id::VARCHAR, damage_class, 'net_area_change_vs_t0_pct', round(net_pct, 8), '%', e.status, e.gate_status FROM ev JOIN edges e USING (inspection_id)""", "fx_inspections fx_snapshots", EDGES + ",\n" + EVENTS)
def s8(fx):
    out = writers.campaign_events(fx.inspections, fx.snapshots)
    return out.select("record_type", "inspection_id", "pathology", "metric", F.round("value", 8).alias("value"), "unit", "chain_status", "quality_status")


@query("s9_campaign_documents", "SELECT asset_id, element_id, 0::BIGINT part, n inspection_count, chain_status, n::INT edges FROM chain JOIN (SELECT asset_id, element_id, count(*) n FROM fx_inspections GROUP BY 1,2) k USING (asset_id, element_id)", "fx_inspections", CHAIN)
def s9(fx):
    out = writers.campaign_documents(fx.inspections)
    return out.select("asset_id", "element_id", "part", "inspection_count", F.col("chain_integrity.chain_status").alias("chain_status"), F.size("chain_edges").alias("edges"))


def closed_records(fx):
    return record_shapes(fx).withColumnRenamed("closed", "is_closed").join(fx.records.drop("image_id", "damage_class", "width_px"), "record_id")


@query("s10_coco_annotations", """
SELECT row_number() OVER (PARTITION BY image_id ORDER BY time_label, damage_class, record_id) id, record_id, round(greatest(bbox_w, bbox_h)/greatest(1, least(bbox_w, bbox_h)), 9) aspect_ratio, image_id, CASE damage_class WHEN 'cracks' THEN 1 WHEN 'spalling_dark' THEN 2 WHEN 'exposed_rebar' THEN 3 WHEN 'corrosion_rust' THEN 4 ELSE 5 END::BIGINT category_id, 8::BIGINT coordinates, round(CASE WHEN damage_class<>'cracks' THEN bbox_x ELSE bbox_x-bbox_h/sqrt((bbox_w*bbox_w+bbox_h*bbox_h)::DOUBLE)*greatest(1, greatest(width_px, 2)/2) END, 6) first_x, area_px2 area FROM fx_records""", "fx_records")
def s10(fx):
    out = writers.coco_annotations(closed_records(fx))
    return out.select("id", "attributes.record_id", F.round("attributes.aspect_ratio", 9).alias("aspect_ratio"), "image_id", "category_id", F.size(F.col("segmentation")[0]).cast("long").alias("coordinates"), F.round(F.col("segmentation")[0][0], 6).alias("first_x"), "area")


@query("s11_bim_features", """
SELECT record_id id, CASE WHEN damage_class='cracks' THEN 'polyline' ELSE 'polygon' END geometry_type, CASE WHEN mm_per_px IS NULL THEN 'px' ELSE 'mm' END units, bbox_x*coalesce(mm_per_px, 1) first_x, -bbox_y*coalesce(mm_per_px, 1) first_y, round(area_px2*mm_per_px*mm_per_px/100, 8) area_cm2 FROM fx_records""", "fx_records")
def s11(fx):
    out = writers.bim_features(closed_records(fx))
    return out.select("id", "geometry_type", "units", F.col("coordinates")[0][0].alias("first_x"), F.col("coordinates")[0][1].alias("first_y"), F.round("metrics.area_cm2", 8).alias("area_cm2"))


def nested(fx):
    r = fx.spatial_records
    bound = F.col("host_id").isNotNull()
    return r.select("record_id", "damage_class", F.col("metric_value").alias("gd_index"), F.struct(F.lit(None).cast("double").alias("area_mm2"), F.lit("point_cloud_world").alias("coord_frame"), F.array("x", "y", "z").alias("vertices_3d")).alias("geometry"),
                    F.struct(F.col("campaign_id").cast("string").alias("inspection_date")).alias("provenance"), F.struct(F.concat(F.lit("el_"), F.col("host_id").cast("string")).alias("global_id")).alias("host"),
                    F.struct(F.when(bound, "bound").otherwise("unbound").alias("status")).alias("association"))


@query("s12_pathology_properties", """
SELECT record_id, 'DamageClass' property, damage_class AS value FROM fx_spatial_records UNION ALL SELECT record_id, 'CoordFrame', 'point_cloud_world' FROM fx_spatial_records UNION ALL SELECT record_id, 'InspectionDate', campaign_id::VARCHAR FROM fx_spatial_records
UNION ALL SELECT record_id, 'HostGlobalID', concat('el_', host_id) FROM fx_spatial_records WHERE host_id IS NOT NULL UNION ALL SELECT record_id, 'AssociationStatus', CASE WHEN host_id IS NULL THEN 'unbound' ELSE 'bound' END FROM fx_spatial_records
UNION ALL SELECT record_id, 'GDIndex', metric_value::VARCHAR FROM fx_spatial_records WHERE metric_value IS NOT NULL""", "fx_spatial_records")
def s12(fx):
    return writers.pathology_properties(nested(fx))


@query("s12_export_counts", "SELECT count(*) total_records, count(host_id) exported, count(*)-count(host_id) skipped_missing_host, 0::BIGINT skipped_bad_geometry FROM fx_spatial_records", "fx_spatial_records")
def s12b(fx):
    return writers.export_counts(nested(fx))
