"""Sinks: comparison and record tables, campaign exports, COCO, BIM features, property rows.

Every sink has a function that shapes the rows as a DataFrame and a thin ``write_*`` that stores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import line_to_quad, polygon_area
from ..functions.rating import CLASS_LABELS
from ..functions.taxonomy import canonicalize, literal_map
from ..operators import campaign as C
from ..operators.annotations import COCO_CATEGORY, COCO_NAMES
from ..operators.rating import to_mm

# Column order of the campaign event file and of the pathology property set.
EVENT_HEADER = ["record_type", "inspection_id", "date", "oae_id", "element_id", "inspection_label", "source_id", "reference_inspection_id", "reference_origin_inspection_id", "reference_storage", "reference_source_id",
                "same_oae", "same_element", "same_source", "chain_status", "expected_previous_id", "content_integrity", "source_image_sha256", "reference_image_sha256",
                "pathology", "metric", "value", "unit", "quality_status", "validated", "notes"]
PROPERTIES = {"DamageClass": "damage_class", "GDIndex": "gd_index", "NBR9452Note": "nbr9452_note", "AreaMM2": "geometry.area_mm2", "CoordFrame": "geometry.coord_frame",
              "ReprojectionErrorPx": "geometry.reprojection_error_px", "SourceImage": "provenance.source_image", "InspectionDate": "provenance.inspection_date", "EngineVersion": "engine_version",
              "ConfidenceCalibrated": "provenance.detector_confidence_calibrated", "HostExpressID": "host.express_id", "HostGlobalID": "host.global_id", "HostIfcType": "host.ifc_type",
              "AssociationStatus": "association.status", "AssociationMethod": "association.method", "AssociationDistance": "association.distance"}


def comparison_rows(runs: DataFrame, detections: DataFrame) -> DataFrame:
    """One row per detection, or one row without detection columns for an engine that found nothing."""
    keys = ["image_id", "engine_id"]
    counts = detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("detections"))
    found = detections.select(*keys, "label", canonicalize(F.col("label")).alias("canonical_label"), "score", "x1", "y1", "x2", "y2", "area_px")
    rows = runs.join(counts, keys, "left").join(found, keys, "left")
    return rows.select(*keys, "status", "latency_ms", F.coalesce("detections", F.lit(0)).cast("long").alias("detections"), "label", "canonical_label", "score", "x1", "y1", "x2", "y2", "area_px")


def write_comparison_csv(runs: DataFrame, detections: DataFrame, path: str) -> None:
    comparison_rows(runs, detections).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def class_label(cls: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(CLASS_LABELS), cls), cls)


def record_rows(records: DataFrame) -> DataFrame:
    """Technical record columns with fixed decimals; physical units stay empty without calibration."""
    rows = to_mm(records)
    fixed = lambda c, d: F.when(F.col(c).isNotNull(), F.format_string(f"%.{d}f", F.col(c))).alias(c)
    aspect = F.greatest("bbox_w", "bbox_h") / F.greatest(F.lit(1), F.least("bbox_w", "bbox_h"))
    ratio = F.col("aspect_ratio") if "aspect_ratio" in records.columns else aspect
    note = F.col("note") if "note" in records.columns else F.lit("")
    return rows.select("record_id", "time_label", "damage_class", class_label(F.col("damage_class")).alias("class_label"), fixed("area_px2", 2), fixed("area_mm2", 4), fixed("area_cm2", 4), fixed("perimeter_px", 2),
                       fixed("perimeter_mm", 4), fixed("length_px", 2), fixed("length_mm", 4), fixed("width_px", 2), fixed("width_mm", 4), "bbox_x", "bbox_y", "bbox_w", "bbox_h",
                       F.format_string("%.3f", ratio).alias("aspect_ratio"), note.alias("confidence_note"))


def write_records_csv(records: DataFrame, path: str) -> None:
    record_rows(records).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def campaign_events(inspections: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Long event table of all campaigns: condition values, calibrated areas and validated changes."""
    text = lambda c: F.col(c).cast("string")
    base = {"oae_id": text("asset_id"), "element_id": text("element_id"), "inspection_id": text("inspection_id"), "date": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), "validated": F.lit("true")}
    condition = C.identified(inspections).where(F.col("gde").isNotNull()).select(F.lit("condition").alias("record_type"), *[v.alias(k) for k, v in base.items()], F.lit("GDE_img").alias("metric"), F.col("gde").alias("value"))
    areas = C.calibrated_area_series(snapshots).select(F.lit("snapshot_pathology_area").alias("record_type"), *[v.alias(k) for k, v in base.items()], F.col("damage_class").alias("pathology"),
                                                       F.lit("affected_area").alias("metric"), F.col("area_mm2").alias("value"), F.lit("mm2").alias("unit"))
    edges = C.chain_audit(inspections)
    quality = inspections.select("inspection_id", F.col("gate_status").alias("quality_status"), "reference_storage")
    events = C.temporal_events(inspections, snapshots, edges).join(quality, "inspection_id")
    metrics = F.array(F.struct(F.lit("net_area_change").alias("metric"), F.coalesce("net_mm2", "net_px2").alias("value"), F.when(F.col("net_mm2").isNotNull(), "mm2").otherwise("px2").alias("unit")),
                      F.struct(F.lit("net_area_change_vs_t0_pct").alias("metric"), F.col("net_pct").alias("value"), F.lit("%").alias("unit")))
    temporal = events.select(F.lit("temporal").alias("record_type"), *[v.alias(k) for k, v in base.items()], text("reference_origin_id").alias("reference_origin_inspection_id"), "reference_storage", "chain_status",
                             text("expected_previous_id").alias("expected_previous_id"), "content_integrity", F.col("damage_class").alias("pathology"), "quality_status", F.inline(metrics))
    out = condition.unionByName(areas, allowMissingColumns=True).unionByName(temporal, allowMissingColumns=True)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in EVENT_HEADER])


def write_campaign_events(inspections: DataFrame, snapshots: DataFrame, path: str) -> None:
    campaign_events(inspections, snapshots).write.mode("overwrite").option("header", True).option("sep", ";").option("quoteAll", True).csv(path)


def campaign_documents(inspections: DataFrame, part_rows: int | None = None) -> DataFrame:
    """Nested campaign documents with chain status, one for each campaign.

    With ``part_rows``, a campaign of more inspections continues in further documents, numbered by ``part``.
    """
    edges = C.chain_audit(inspections)
    head = C.chain_status(edges).join(C.campaign_groups(inspections), C.CAMPAIGN)
    parts = edges.withColumn("part", F.floor(F.col("idx") / part_rows).cast("long") if part_rows else F.lit(0).cast("long"))
    entry = F.struct("idx", "inspection_id", "created_at", "status", "expected_previous_id", "origin_reference_id", "content_integrity", "gate_status")
    body = parts.groupBy(*C.CAMPAIGN, "part").agg(F.array_sort(F.collect_list(entry)).alias("chain_edges"))
    integrity = F.struct("chain_status", "hard_issues", "warnings", *[f"n_{s}" for s in C.STATUSES])
    return body.join(head, C.CAMPAIGN).select(F.lit("shm_cdm_campaign_v1").alias("schema"), *C.CAMPAIGN, "part", F.col("inspections").alias("inspection_count"), "first_at", "latest_at", integrity.alias("chain_integrity"), "chain_edges")


def write_campaign_json(inspections: DataFrame, path: str, part_rows: int | None = None) -> None:
    campaign_documents(inspections, part_rows).write.mode("overwrite").json(path)


def coco_annotations(records: DataFrame) -> DataFrame:
    """COCO annotation rows of detector records (``points``, ``is_closed``): thin quads for open lines.

    Ids number the records of an image from 1 in the order of time label, class and record id.
    """
    pts = F.when(F.col("is_closed"), F.col("points")).otherwise(line_to_quad(F.col("points"), F.greatest("width_px", F.lit(2.0))))
    rows = records.withColumn("_pts", pts)
    flat = F.flatten(F.transform("_pts", lambda p: F.array(p["x"], p["y"])))
    category = F.coalesce(F.element_at(literal_map(COCO_CATEGORY), F.col("damage_class")), F.lit(1)).cast("long")
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("time_label", "damage_class", "record_id"))
    note = F.col("note") if "note" in records.columns else F.lit(None).cast("string")
    aspect = F.col("aspect_ratio") if "aspect_ratio" in records.columns else F.greatest("bbox_w", "bbox_h") / F.greatest(F.lit(1), F.least("bbox_w", "bbox_h"))
    return rows.select(number.cast("long").alias("id"), "image_id", category.alias("category_id"), F.array(flat).alias("segmentation"), F.when(F.col("area_px2") > 0, F.col("area_px2")).otherwise(polygon_area(F.col("_pts"))).alias("area"),
                       F.array(*[F.col(f"bbox_{k}").cast("double") for k in "xywh"]).alias("bbox"), F.lit(0).alias("iscrowd"),
                       F.struct("record_id", "damage_class", "time_label", "perimeter_px", "length_px", "width_px", aspect.alias("aspect_ratio"), note.alias("note")).alias("attributes"))


def write_coco(records: DataFrame, images: DataFrame, path: str) -> None:
    """Annotation, image and category documents as JSON lines under one folder."""
    coco_annotations(records).write.mode("overwrite").json(f"{path}/annotations")
    images.write.mode("overwrite").json(f"{path}/images")
    spark = records.sparkSession
    spark.createDataFrame([(i, n, "concrete_damage") for i, n in COCO_NAMES.items()], "id long, name string, supercategory string").write.mode("overwrite").json(f"{path}/categories")


def bim_features(records: DataFrame, coordinate_system: str = "image_local") -> DataFrame:
    """Nested features with y pointing up, in millimetres where calibrated."""
    factor = F.coalesce("mm_per_px", F.lit(1.0))
    rows = to_mm(records)
    coords = F.transform("points", lambda p: F.array(p["x"] * factor, -p["y"] * factor))
    metrics = F.struct("area_px2", "area_mm2", "area_cm2", "perimeter_px", "perimeter_mm", "length_px", "length_mm", "width_px", "width_mm", F.array("bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("bbox_px"))
    return rows.select(F.col("record_id").alias("id"), "time_label", "damage_class", class_label(F.col("damage_class")).alias("class_label"), F.when(F.col("is_closed"), "polygon").otherwise("polyline").alias("geometry_type"),
                       F.lit(coordinate_system).alias("coordinate_system"), coords.alias("coordinates"), F.when(F.col("mm_per_px").isNotNull(), "mm").otherwise("px").alias("units"), metrics.alias("metrics"))


def write_bim_features(records: DataFrame, path: str) -> None:
    bim_features(records).write.mode("overwrite").json(path)


def _leaf(schema, path: str) -> bool:
    names = path.split(".")
    if names[0] not in schema.names:
        return False
    return len(names) == 1 or _leaf(schema[names[0]].dataType, names[1]) if len(names) == 1 or hasattr(schema[names[0]].dataType, "names") else False


def pathology_properties(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Flat property rows of nested records; missing fields and nulls give no row."""
    have = {name: path for name, path in PROPERTIES.items() if _leaf(records.schema, path)}
    rows = F.array(*[F.struct(F.lit(n).alias("property"), F.col(p).cast("string").alias("value")) for n, p in have.items()])
    return records.select(key, F.inline(rows)).where(F.col("value").isNotNull())


def export_counts(records: DataFrame) -> DataFrame:
    """Exported and skipped records by reason (``host.global_id``, ``geometry.vertices_3d``)."""
    host = F.coalesce(F.col("host.global_id"), F.lit("")) != ""
    shape = F.coalesce(F.size("geometry.vertices_3d"), F.lit(0)) > 0
    return records.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(host & shape).alias("exported"), F.count_if(~host).alias("skipped_missing_host"), F.count_if(host & ~shape).alias("skipped_bad_geometry"))


def write_pathology_properties(records: DataFrame, path: str, key: str = "record_id") -> None:
    pathology_properties(records, key).write.mode("overwrite").parquet(path)
