"""Registered queries: campaigns and history (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaign as ops
from .base import query

GROUPS = """SELECT asset_id, element_id, count(*) inspections, arg_min(inspection_id, (created_at, inspection_id)) first_id, arg_max(inspection_id, (created_at, inspection_id)) latest_id, min(created_at) first_at, max(created_at) latest_at,
 count(*) FILTER (gate_status<>'fail') validated, count(*) FILTER (gate_status='fail') failed, count(*) FILTER (reference_origin_id IS NOT NULL) linked FROM fx_inspections GROUP BY 1,2"""
EDGES = """pos AS (SELECT *, row_number() OVER w - 1 idx, lag(inspection_id) OVER w expected_previous_id FROM fx_inspections WINDOW w AS (PARTITION BY asset_id, element_id ORDER BY created_at, inspection_id)),
edges AS (SELECT p.asset_id, p.element_id, p.inspection_id, p.created_at, p.temporal, p.idx, CASE WHEN NOT p.temporal THEN CASE WHEN p.idx=0 THEN 'baseline' ELSE 'snapshot' END
 WHEN p.reference_origin_id IS NOT NULL THEN CASE WHEN r.idx IS NOT NULL THEN CASE WHEN r.idx=p.idx-1 THEN 'continuous' WHEN r.idx<p.idx-1 THEN 'branch' ELSE 'invalid_order' END WHEN p.reference_storage='materialized_history' THEN 'materialized_origin' ELSE 'missing_origin' END
 WHEN p.has_reference_image THEN 'external_reference' ELSE 'legacy_unlinked' END status, p.expected_previous_id, CASE WHEN p.temporal THEN p.reference_origin_id END origin_reference_id, r.idx reference_idx, p.reference_storage, p.gate_status, p.reference_hash_key reference_hash, r.image_hash_key source_hash,
 CASE WHEN r.idx IS NULL THEN 'not_applicable' WHEN p.reference_hash_key IS NULL OR r.image_hash_key IS NULL THEN 'unknown' WHEN p.reference_hash_key=r.image_hash_key THEN 'verified' ELSE 'mismatch' END content_integrity
 FROM pos p LEFT JOIN pos r ON p.temporal AND r.inspection_id=p.reference_origin_id AND r.asset_id=p.asset_id AND r.element_id=p.element_id)"""
CHAIN = EDGES + """,
chain0 AS (SELECT asset_id, element_id, """ + ", ".join(f"count(*) FILTER (status='{s}') n_{s}" for s in ops.STATUSES) + """, count(*) FILTER (content_integrity='mismatch') hash_mismatch, count(*) FILTER (content_integrity='unknown') hash_unknown FROM edges GROUP BY 1,2),
chain AS (SELECT *, n_missing_origin+n_invalid_order+hash_mismatch hard_issues, n_branch+n_materialized_origin+n_external_reference+n_legacy_unlinked+hash_unknown warnings,
 CASE WHEN n_missing_origin+n_invalid_order+hash_mismatch>0 THEN 'fail' WHEN n_branch+n_materialized_origin+n_external_reference+n_legacy_unlinked+hash_unknown>0 THEN 'warning' ELSE 'pass' END chain_status FROM chain0)"""
# Inspections with a source name; every 13th reference of the history was taken elsewhere.
SOURCES = "src AS (SELECT *, concat('cam_', CAST(inspection_id % 3 AS VARCHAR)) source_id, CASE WHEN inspection_id % 13 = 0 THEN asset_id+1 ELSE asset_id END known_asset FROM fx_inspections)"
COMP = SOURCES + """,
comp AS (SELECT i.inspection_id, i.reference_origin_id, i.asset_id=r.known_asset same_asset, i.element_id=r.element_id same_element, i.source_id=r.source_id same_source FROM src i JOIN src r ON r.inspection_id=i.reference_origin_id)"""
EVENTS = """ev AS (SELECT s.asset_id, s.element_id, s.inspection_id, s.created_at, s.damage_class, i.reference_origin_id, previous_area_px2, area_px2 current_area_px2, area_px2-previous_area_px2 net_px2, 100*(area_px2-previous_area_px2)/nullif(previous_area_px2,0) net_pct, (area_px2-previous_area_px2)*mm_per_px*mm_per_px net_mm2
 FROM fx_snapshots s JOIN fx_inspections i USING (inspection_id) WHERE i.temporal AND i.gate_status<>'fail')"""


def compatibility(fx):
    rows = fx.inspections.withColumn("source_id", F.concat(F.lit("cam_"), (F.col("inspection_id") % 3).cast("string")))
    rows = rows.withColumn("known_asset", F.when(F.col("inspection_id") % 13 == 0, F.col("asset_id") + 1).otherwise(F.col("asset_id")))
    # The history knows every 13th inspection under another asset.
    history = rows.withColumn("asset_id", F.col("known_asset"))
    return ops.reference_compatibility(rows, {"asset_id": "same_asset", "element_id": "same_element", "source_id": "same_source"}, history)


@query("d1_campaign_groups", GROUPS, "fx_inspections")
def d1(fx):
    return ops.campaign_groups(fx.inspections)


@query("d2_chain_audit", "SELECT asset_id, element_id, inspection_id, created_at, temporal, idx, status, expected_previous_id, origin_reference_id, reference_idx, reference_storage, gate_status, content_integrity FROM edges", "fx_inspections", EDGES)
def d2(fx):
    return ops.chain_audit(fx.inspections).drop("reference_hash", "source_hash")


@query("d3_content_integrity", "SELECT inspection_id, sha256(CAST(source_hash AS VARCHAR)) source_sha256, sha256(CAST(reference_hash AS VARCHAR)) reference_sha256, content_integrity FROM edges WHERE temporal", "fx_inspections", EDGES)
def d3(fx):
    edges = ops.chain_audit(fx.inspections).where("temporal")
    hashed = [F.sha2(F.col(c).cast("string"), 256).alias(n) for c, n in (("source_hash", "source_sha256"), ("reference_hash", "reference_sha256"))]
    return edges.select("inspection_id", *hashed, "content_integrity")


@query("d4_chain_status", "SELECT * FROM chain", "fx_inspections", CHAIN)
def d4(fx):
    return ops.chain_status(ops.chain_audit(fx.inspections))


@query("d5_identity_audit", """
SELECT c.asset_id, c.element_id, chain_status, coalesce(linked,0) linked, coalesce(identity_issues,0) identity_issues, coalesce(identity_unknown,0) identity_unknown, coalesce(source_changes,0) source_changes,
 CASE WHEN coalesce(identity_issues,0)>0 OR chain_status='fail' THEN 'fail' WHEN coalesce(identity_unknown,0)>0 OR coalesce(source_changes,0)>0 OR chain_status='warning' THEN 'warning' ELSE 'pass' END status
FROM chain c LEFT JOIN (SELECT asset_id, element_id, count(*) linked, count(*) FILTER (NOT same_asset OR NOT same_element) identity_issues, count(*) FILTER (same_asset IS NULL) identity_unknown, count(*) FILTER (same_asset AND same_element AND NOT same_source) source_changes
 FROM fx_inspections i LEFT JOIN comp USING (inspection_id) WHERE i.reference_origin_id IS NOT NULL GROUP BY 1,2) l ON l.asset_id=c.asset_id AND l.element_id=c.element_id""", "fx_inspections", CHAIN + ",\n" + COMP)
def d5(fx):
    chain = ops.chain_status(ops.chain_audit(fx.inspections))
    return ops.identity_audit(fx.inspections, compatibility(fx), chain)


@query("d6_reference_compatibility", "SELECT * FROM comp", "fx_inspections", COMP)
def d6(fx):
    return compatibility(fx)


@query("d7_link_gate", "SELECT inspection_id, same_asset AND same_element allowed, CASE WHEN NOT same_asset THEN 'asset_mismatch' WHEN NOT same_element THEN 'element_mismatch' END reason FROM comp", "fx_inspections", COMP)
def d7(fx):
    allowed, blocked = ops.link_gate(compatibility(fx))
    return (allowed.select("inspection_id", F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("reason"))
            .unionByName(blocked.select("inspection_id", F.lit(False).alias("allowed"), "reason")))


@query("d8_condition_series", """SELECT asset_id, element_id, count(*) points, arg_min(gde, (created_at, inspection_id)) AS "first", arg_max(gde, (created_at, inspection_id)) latest,
 round(CASE WHEN count(*)>=2 THEN arg_max(gde, (created_at, inspection_id)) - arg_min(gde, (created_at, inspection_id)) END, 6) delta FROM fx_inspections GROUP BY 1,2""", "fx_inspections")
def d8(fx):
    return ops.condition_series(fx.inspections).withColumn("delta", F.round("delta", 6))


@query("d9_calibrated_area_series", """SELECT * FROM (SELECT asset_id, element_id, damage_class, inspection_id, created_at, area_px2*mm_per_px*mm_per_px area_mm2, mm_per_px, count(*) OVER (PARTITION BY asset_id, element_id, damage_class) points FROM fx_snapshots WHERE mm_per_px>0) q WHERE points>=2""", "fx_snapshots")
def d9(fx):
    return ops.calibrated_area_series(fx.snapshots)


@query("d10_temporal_events", "SELECT ev.* REPLACE (round(net_pct, 8) AS net_pct), e.status chain_status, e.expected_previous_id, e.content_integrity FROM ev LEFT JOIN edges e USING (inspection_id)", "fx_inspections fx_snapshots", EDGES + ",\n" + EVENTS)
def d10(fx):
    return ops.temporal_events(fx.inspections, fx.snapshots, ops.chain_audit(fx.inspections)).withColumn("net_pct", F.round("net_pct", 8))


@query("d11_strongest_delta", "SELECT inspection_id, damage_class, round(net_pct, 8) net_pct FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY abs(coalesce(net_pct,0)) DESC, damage_class DESC) rn FROM ev) q WHERE rn=1", "fx_inspections fx_snapshots", EVENTS)
def d11(fx):
    events = ops.temporal_events(fx.inspections, fx.snapshots, ops.chain_audit(fx.inspections))
    return ops.strongest_delta(events).withColumn("net_pct", F.round("net_pct", 8))


@query("d12_inspection_snapshot", """SELECT i.inspection_id, i.asset_id, i.element_id, i.gde, i.gate_status, a.c1 cracks_px2, a.c2 spalling_px2, a.c3 rust_px2, CASE WHEN i.temporal AND i.gate_status<>'fail' THEN a.n1 END cracks_net
FROM fx_inspections i LEFT JOIN (SELECT inspection_id, max(area_px2) FILTER (damage_class='cracks') c1, max(area_px2) FILTER (damage_class='spalling_dark') c2, max(area_px2) FILTER (damage_class='corrosion_rust') c3, max(area_px2-previous_area_px2) FILTER (damage_class='cracks') n1 FROM fx_snapshots GROUP BY 1) a USING (inspection_id)""", "fx_inspections fx_snapshots")
def d12(fx):
    out = ops.inspection_snapshot(fx.snapshots, fx.inspections)
    area = lambda c: F.element_at("areas_by_class", F.lit(c))
    return out.select("inspection_id", "asset_id", "element_id", "gde", "gate_status", area("cracks").alias("cracks_px2"), area("spalling_dark").alias("spalling_px2"),
                      area("corrosion_rust").alias("rust_px2"), F.element_at("validated_net_by_class", F.lit("cracks")).alias("cracks_net"))


@query("d13_retain_recent", "SELECT DISTINCT i.inspection_id, i.created_at FROM fx_inspections i JOIN keep k ON k.id=i.inspection_id", "fx_inspections", """
keep AS /* RECURSIVE */ (SELECT inspection_id id, reference_origin_id ref FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, inspection_id DESC) rn FROM fx_inspections) q WHERE rn<=75
 UNION SELECT i.inspection_id, i.reference_origin_id FROM keep JOIN fx_inspections i ON i.inspection_id=keep.ref)""")
def d13(fx):
    return ops.retain_recent(fx.inspections, 75, ["asset_id"]).select("inspection_id", "created_at")


@query("d14_materialize_deleted", """
SELECT i.inspection_id, i.reference_origin_id, CASE WHEN t.inspection_id IS NULL THEN i.reference_origin_id END active_reference_id, CASE WHEN t.inspection_id IS NOT NULL THEN CASE WHEN t.image_hash_key IS NOT NULL OR i.has_reference_image THEN 'materialized_history' ELSE 'missing_reference' END ELSE i.reference_storage END reference_storage,
 CASE WHEN t.inspection_id IS NOT NULL THEN t.image_hash_key IS NOT NULL OR i.has_reference_image ELSE i.has_reference_image END has_reference_image, CASE WHEN t.inspection_id IS NOT NULL THEN coalesce(i.reference_hash_key, t.image_hash_key) ELSE i.reference_hash_key END reference_hash_key
FROM fx_inspections i LEFT JOIN (SELECT * FROM fx_inspections WHERE gate_status='fail' AND NOT temporal) t ON t.inspection_id=i.reference_origin_id WHERE NOT (i.gate_status='fail' AND NOT i.temporal)""", "fx_inspections")
def d14(fx):
    deleted = fx.inspections.where((F.col("gate_status") == "fail") & ~F.col("temporal"))
    return ops.materialize_deleted(fx.inspections, deleted).select("inspection_id", "reference_origin_id", "active_reference_id", "reference_storage", "has_reference_image", "reference_hash_key")


@query("d15_history_kpis", """SELECT asset_id, count(*) inspections, count(DISTINCT element_id) campaigns, count(*) FILTER (temporal) temporal, count(*) FILTER (temporal AND gate_status<>'fail') validated,
 arg_max(gate_status, (created_at, inspection_id)) FILTER (temporal) latest_quality, max(created_at) latest_at FROM fx_inspections GROUP BY 1""", "fx_inspections")
def d15(fx):
    return ops.history_kpis(fx.inspections)


@query("d16_content_hash", "SELECT page_id, sha256(html) sha256 FROM pages")
def d16(fx):
    return ops.content_hash(fx.pages, "html").select("page_id", "sha256")
