"""Explicit schemas of the stored inspection tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()
POINTS = T.ArrayType(_struct(x=D, y=D))

DETECTIONS = _struct(det_id=S, image_id=L, engine_id=S, label=S, canonical_label=S, score=D, x1=D, y1=D, x2=D, y2=D, polygon=POINTS, area_px=D)
RUNS = _struct(image_id=L, engine_id=S, name=S, task=S, status=S, latency_ms=D, message=S, metrics=T.MapType(S, D))
RECORDS = _struct(record_id=S, image_id=L, damage_class=S, time_label=S, points=POINTS, is_closed=B, area_px2=D, perimeter_px=D, bbox_x=L, bbox_y=L, bbox_w=L, bbox_h=L,
                  aspect_ratio=D, length_px=D, width_px=D, mm_per_px=D, note=S)
INSPECTIONS = _struct(inspection_id=L, asset_id=L, element_id=L, source_id=S, created_at=TS, temporal=B, reference_origin_id=L, reference_storage=S, has_reference_image=B,
                      image_hash_key=L, reference_hash_key=L, gde=D, gate_status=S)
PIXELS = _struct(image_id=L, y=L, x=L, r=L, g=L, b=L)
POINT_CLOUD = _struct(point_id=S, cloud_id=L, x=D, y=D, z=D, r=L, g=L, b=L, intensity=L, cls=L)

TABLES = {"detections": DETECTIONS, "runs": RUNS, "records": RECORDS, "inspections": INSPECTIONS, "pixels": PIXELS, "points": POINT_CLOUD}

CATALOG_ENGINE = _struct(id=S, name=S, family=S, task=S, description=S, domain_mode=S, catalog_group=S, catalog_visibility=S, catalog_owned=B, recommended=B, cloud_verified=B, browser_ready=B)
CATALOG = _struct(engines=T.ArrayType(CATALOG_ENGINE))
