"""Inspection histories: campaigns, reference chains, series and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .ordered import ordered_positions, shifted

CAMPAIGN = ["asset_id", "element_id"]
STATUSES = ["continuous", "branch", "materialized_origin", "external_reference", "legacy_unlinked", "missing_origin",
            "invalid_order", "baseline", "snapshot"]
WARNING_STATUSES = ["branch", "materialized_origin", "external_reference", "legacy_unlinked"]


def identified(inspections: DataFrame) -> DataFrame:
    """Inspections with a non-blank asset and element."""
    keep = None
    for key in CAMPAIGN:
        ok = F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")
        keep = ok if keep is None else keep & ok
    return inspections.where(keep)


def campaign_groups(inspections: DataFrame) -> DataFrame:
    """One row per asset and element with its date range and gate counters."""
    order = F.struct("created_at", "inspection_id")
    return identified(inspections).groupBy(*CAMPAIGN).agg(
        F.count(F.lit(1)).alias("inspections"), F.min_by("inspection_id", order).alias("first_id"), F.max_by("inspection_id", order).alias("latest_id"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("latest_at"),
        F.count_if(F.col("gate_status") != "fail").alias("validated"), F.count_if(F.col("gate_status") == "fail").alias("failed"),
        F.count_if(F.col("reference_origin_id").isNotNull()).alias("linked"))


def positions(inspections: DataFrame) -> DataFrame:
    """Date position of every inspection in its campaign (0-based ``idx``); a long campaign is spread over months."""
    rows = identified(inspections)
    rows = rows.withColumn("_at", F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp_ntz")))
    rows = ordered_positions(rows, CAMPAIGN, ["_at", "inspection_id"], F.trunc("_at", "month"), position="pos")
    return rows.withColumn("idx", F.col("pos") - 1).drop("_at")


def content_integrity(origin_found: Column, source_hash: Column, reference_hash: Column) -> Column:
    return (F.when(~origin_found, "not_applicable").when(source_hash.isNull() | reference_hash.isNull(), "unknown")
            .when(source_hash == reference_hash, "verified").otherwise("mismatch"))


def chain_audit(inspections: DataFrame) -> DataFrame:
    """Status of every inspection's link to its reference, expected predecessor and content integrity."""
    placed = checkpoint(positions(inspections))  # read three times below
    rows = shifted(placed, placed, CAMPAIGN, -1, {"inspection_id": "expected_previous_id"})
    refs = placed.select(*CAMPAIGN, F.col("inspection_id").alias("origin"), F.col("idx").alias("reference_idx"),
                                         F.col("image_hash_key").alias("source_hash"))
    rows = rows.withColumn("origin", F.when(F.col("temporal"), F.col("reference_origin_id")))
    rows = rows.join(refs, [*CAMPAIGN, "origin"], "left")
    found = F.col("reference_idx").isNotNull()
    status = (F.when(~F.col("temporal"), F.when(F.col("idx") == 0, "baseline").otherwise("snapshot"))
              .when(F.col("origin").isNotNull() & found,
                    F.when(F.col("reference_idx") == F.col("idx") - 1, "continuous").when(F.col("reference_idx") < F.col("idx") - 1, "branch").otherwise("invalid_order"))
              .when(F.col("origin").isNotNull(), F.when(F.col("reference_storage") == "materialized_history", "materialized_origin").otherwise("missing_origin"))
              .when(F.coalesce("has_reference_image", F.lit(False)), "external_reference").otherwise("legacy_unlinked"))
    return rows.select(*CAMPAIGN, "inspection_id", "created_at", "temporal", "idx", status.alias("status"), "expected_previous_id",
                       F.col("origin").alias("origin_reference_id"), "reference_idx", "reference_storage", "gate_status",
                       F.col("reference_hash_key").alias("reference_hash"), "source_hash",
                       content_integrity(found, F.col("source_hash"), F.col("reference_hash_key")).alias("content_integrity"))


def chain_status(edges: DataFrame) -> DataFrame:
    """Counts per status and pass / warning / fail per campaign."""
    counts = edges.groupBy(*CAMPAIGN).agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES],
        F.count_if(F.col("content_integrity") == "mismatch").alias("hash_mismatch"), F.count_if(F.col("content_integrity") == "unknown").alias("hash_unknown"))
    hard = F.col("n_missing_origin") + F.col("n_invalid_order") + F.col("hash_mismatch")
    warn = F.col("hash_unknown")
    for s in WARNING_STATUSES:
        warn = warn + F.col(f"n_{s}")
    out = counts.withColumn("hard_issues", hard).withColumn("warnings", warn)
    return out.withColumn("chain_status", F.when(F.col("hard_issues") > 0, "fail").when(F.col("warnings") > 0, "warning").otherwise("pass"))


def _same(a: Column, b: Column) -> Column:
    text = F.trim(F.coalesce(b.cast("string"), F.lit("")))
    return (text != "") & (F.trim(F.coalesce(a.cast("string"), F.lit(""))) == text)


def reference_compatibility(inspections: DataFrame, fields: dict[str, str], history: DataFrame | None = None) -> DataFrame:
    """Whether an inspection and its reference share the given identity fields (``{column: output}``).

    References are looked up in ``history``, by default the inspections themselves.
    """
    refs = (inspections if history is None else history).select(F.col("inspection_id").alias("reference_origin_id"), *[F.col(c).alias(f"reference_{o}") for c, o in fields.items()])
    rows = inspections.where(F.col("reference_origin_id").isNotNull()).join(refs, "reference_origin_id")
    return rows.select("inspection_id", "reference_origin_id", *[_same(F.col(c), F.col(f"reference_{o}")).alias(o) for c, o in fields.items()])


def identity_audit(inspections: DataFrame, compatibility: DataFrame, chain: DataFrame) -> DataFrame:
    """Identity problems per campaign, overriding the chain status."""
    linked = identified(inspections).where(F.col("reference_origin_id").isNotNull()).select(*CAMPAIGN, "inspection_id")
    comp = compatibility.select("inspection_id", "same_asset", "same_element", "same_source", F.lit(True).alias("known"))
    counts = linked.join(comp, "inspection_id", "left").groupBy(*CAMPAIGN).agg(
        F.count(F.lit(1)).alias("linked"), F.count_if(~F.col("same_asset") | ~F.col("same_element")).alias("identity_issues"),
        F.count_if(F.col("known").isNull()).alias("identity_unknown"),
        F.count_if(F.col("same_asset") & F.col("same_element") & ~F.col("same_source")).alias("source_changes"))
    out = chain.select(*CAMPAIGN, "chain_status").join(counts, CAMPAIGN, "left").na.fill(0)
    status = (F.when((F.col("identity_issues") > 0) | (F.col("chain_status") == "fail"), "fail")
              .when((F.col("identity_unknown") > 0) | (F.col("source_changes") > 0) | (F.col("chain_status") == "warning"), "warning").otherwise("pass"))
    return out.withColumn("status", status)


def link_gate(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split candidate t0-t1 pairs into allowed and blocked ones; both asset and element must match."""
    ok = F.coalesce(F.col("same_asset") & F.col("same_element"), F.lit(False))
    blocked = pairs.where(~ok).withColumn("reason", F.when(~F.coalesce("same_asset", F.lit(False)), "asset_mismatch").otherwise("element_mismatch"))
    return pairs.where(ok), blocked


def condition_series(inspections: DataFrame, value: str = "gde") -> DataFrame:
    """First, latest and difference of a condition value per campaign."""
    order = F.struct("created_at", "inspection_id")
    return identified(inspections).where(F.col(value).isNotNull()).groupBy(*CAMPAIGN).agg(
        F.count(F.lit(1)).alias("points"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("latest")) \
        .withColumn("delta", F.when(F.col("points") >= 2, F.col("latest") - F.col("first")))


def calibrated_area_series(snapshots: DataFrame) -> DataFrame:
    """Calibrated area points of every class series that has at least two of them."""
    rows = snapshots.where(F.col("mm_per_px") > 0).withColumn("area_mm2", F.col("area_px2") * F.col("mm_per_px") * F.col("mm_per_px"))
    enough = rows.groupBy(*CAMPAIGN, "damage_class").agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= 2)
    return rows.join(enough, [*CAMPAIGN, "damage_class"]).select(*CAMPAIGN, "damage_class", "inspection_id", "created_at", "area_mm2", "mm_per_px", "points")


def temporal_events(inspections: DataFrame, snapshots: DataFrame, edges: DataFrame) -> DataFrame:
    """Validated pairwise area changes with their chain edge."""
    valid = identified(inspections).where(F.col("temporal") & (F.col("gate_status") != "fail")).select("inspection_id", "reference_origin_id")
    net = F.col("area_px2") - F.col("previous_area_px2")
    mm2 = F.col("mm_per_px") * F.col("mm_per_px")
    events = snapshots.join(valid, "inspection_id").select(
        *CAMPAIGN, "inspection_id", "created_at", "damage_class", "reference_origin_id", "previous_area_px2", F.col("area_px2").alias("current_area_px2"),
        net.alias("net_px2"), (100.0 * net / F.nullif("previous_area_px2", F.lit(0.0))).alias("net_pct"), (net * mm2).alias("net_mm2"))
    return events.join(edges.select("inspection_id", F.col("status").alias("chain_status"), "expected_previous_id", "content_integrity"), "inspection_id", "left")


def strongest_delta(events: DataFrame) -> DataFrame:
    """Class with the largest absolute percentage change per inspection."""
    size = F.struct(F.abs(F.coalesce("net_pct", F.lit(0.0))).alias("s"), F.col("damage_class").alias("c"))
    pick = F.max_by(F.struct("damage_class", "net_pct"), size)
    return events.groupBy("inspection_id").agg(pick.alias("p")).select("inspection_id", F.col("p.damage_class").alias("damage_class"), F.col("p.net_pct").alias("net_pct"))


def inspection_snapshot(snapshots: DataFrame, inspections: DataFrame) -> DataFrame:
    """Stored summary of an inspection: area per class, condition value, validated deltas only when the gate passed."""
    areas = snapshots.groupBy("inspection_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("damage_class", "area_px2")))).alias("areas_by_class"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("damage_class", (F.col("area_px2") - F.col("previous_area_px2")).alias("net"))))).alias("net_by_class"))
    rows = inspections.join(areas, "inspection_id", "left")
    passed = F.col("temporal") & (F.col("gate_status") != "fail")
    return rows.select(*CAMPAIGN, "inspection_id", "created_at", "gde", "gate_status", "areas_by_class",
                       F.when(passed, F.col("net_by_class")).alias("validated_net_by_class"))


def retain_recent(inspections: DataFrame, n: int = 75, partition: list[str] | None = None) -> DataFrame:
    """The newest ``n`` inspections (per ``partition``) and everything they refer to, directly or not.

    The closure doubles its reach: a round adds what lies 2^k references behind the inspections kept so far, so a chain of
    any length needs a logarithmic number of rounds. A round that adds nothing ends it, also where references form a ring.
    """
    keys = partition or []
    order = Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col("inspection_id").desc())
    rows = checkpoint(inspections.select(*keys, "inspection_id", "reference_origin_id", "created_at"))
    kept = checkpoint(rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).select("inspection_id"))
    known = rows.select(F.col("inspection_id").alias("back"))
    jump = checkpoint(rows.select("inspection_id", F.col("reference_origin_id").alias("back")).join(known, "back", "left_semi"))
    while True:
        reached = kept.join(jump, "inspection_id").select(F.col("back").alias("inspection_id")).distinct()
        fresh = checkpoint(reached.join(kept, "inspection_id", "left_anti"))
        if fresh.isEmpty():
            return inspections.join(kept, "inspection_id", "left_semi")
        kept = checkpoint(kept.unionByName(fresh))
        further = jump.select(F.col("inspection_id").alias("back"), F.col("back").alias("further"))
        jump = checkpoint(jump.join(further, "back").select("inspection_id", F.col("further").alias("back")))


def materialize_deleted(inspections: DataFrame, deleted: DataFrame) -> DataFrame:
    """Remove inspections; dependents keep origin and hash, and their storage tells whether the image survives."""
    gone = deleted.select("inspection_id").distinct()
    source = inspections.join(gone, "inspection_id", "left_semi").select(
        F.col("inspection_id").alias("reference_origin_id"), F.col("image_hash_key").alias("_hash"), F.lit(True).alias("_gone"))
    rows = inspections.join(gone, "inspection_id", "left_anti").join(source, "reference_origin_id", "left")
    hit = F.coalesce("_gone", F.lit(False))
    has_image = F.col("_hash").isNotNull() | F.coalesce("has_reference_image", F.lit(False))
    return (rows.withColumn("reference_storage", F.when(hit, F.when(has_image, "materialized_history").otherwise("missing_reference")).otherwise(F.col("reference_storage")))
            .withColumn("has_reference_image", F.when(hit, has_image).otherwise(F.col("has_reference_image")))
            .withColumn("reference_hash_key", F.when(hit, F.coalesce("reference_hash_key", "_hash")).otherwise(F.col("reference_hash_key")))
            .withColumn("active_reference_id", F.when(~hit, F.col("reference_origin_id"))).drop("_hash", "_gone"))


def history_kpis(inspections: DataFrame) -> DataFrame:
    """History counters per asset."""
    order = F.struct("created_at", "inspection_id")
    return inspections.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("inspections"), F.countDistinct("element_id").alias("campaigns"), F.count_if("temporal").alias("temporal"),
        F.count_if(F.col("temporal") & (F.col("gate_status") != "fail")).alias("validated"),
        F.max_by(F.when(F.col("temporal"), F.col("gate_status")), F.when(F.col("temporal"), order)).alias("latest_quality"), F.max("created_at").alias("latest_at"))


def content_hash(assets: DataFrame, content: str) -> DataFrame:
    return assets.withColumn("sha256", F.sha2(F.col(content), 256))
