from datetime import datetime, timedelta

from pyspark.sql import functions as F

from defectlake.operators import campaign as C
from defectlake.operators.ordered import ordered_positions, shifted

SCHEMA = ("inspection_id long, asset_id long, element_id long, created_at timestamp_ntz, temporal boolean, reference_origin_id long, reference_storage string, has_reference_image boolean, "
          "image_hash_key long, reference_hash_key long, gde double, gate_status string")


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=20 * n)


def history(spark):
    rows = [(1, 1, 1, day(0), False, None, None, False, 1, None, 10.0, "pass"), (2, 1, 1, day(1), True, 1, "linked_inspection", True, 2, 1, 12.0, "pass"),
            (3, 1, 1, day(2), True, 1, "linked_inspection", True, 3, 9, 13.0, "warning"), (4, 1, 1, day(3), True, 99, "materialized_history", True, 4, None, 14.0, "pass"),
            (5, 1, 1, day(4), True, 98, "linked_inspection", True, 5, None, 15.0, "fail"), (6, 1, 1, day(5), True, None, None, True, 6, None, 15.0, "pass"),
            (7, 1, 1, day(6), True, None, None, False, 7, None, 15.0, "pass"), (8, 1, 1, day(7), True, 9, "linked_inspection", True, 8, None, 16.0, "pass"), (9, 1, 1, day(8), False, None, None, False, 9, None, 17.0, "pass")]
    return spark.createDataFrame(rows, SCHEMA)


def test_all_nine_chain_states(spark):
    edges = {r["inspection_id"]: r for r in C.chain_audit(history(spark)).collect()}
    want = {1: "baseline", 2: "continuous", 3: "branch", 4: "materialized_origin", 5: "missing_origin", 6: "external_reference", 7: "legacy_unlinked", 8: "invalid_order", 9: "snapshot"}
    assert {k: e["status"] for k, e in edges.items()} == want
    assert edges[2]["content_integrity"] == "verified" and edges[3]["content_integrity"] == "mismatch" and edges[8]["content_integrity"] == "unknown"
    assert edges[3]["expected_previous_id"] == 2 and edges[1]["expected_previous_id"] is None
    s = C.chain_status(C.chain_audit(history(spark))).first()
    assert (s["hard_issues"], s["warnings"], s["chain_status"]) == (3, 5, "fail")


def test_identity_issue_overrides_a_passing_chain(spark):
    ok = history(spark).where("inspection_id <= 2")
    comp = spark.createDataFrame([(2, False, True, True)], "inspection_id long, same_asset boolean, same_element boolean, same_source boolean")
    chain = C.chain_status(C.chain_audit(ok))
    assert chain.first()["chain_status"] == "pass"
    assert C.identity_audit(ok, comp, chain).first()["status"] == "fail"
    assert C.identity_audit(ok, comp.where("false"), chain).first()["status"] == "warning"


def test_retention_follows_references(spark):
    kept = C.retain_recent(history(spark), 1).collect()
    assert {r["inspection_id"] for r in kept} == {9}
    linked = history(spark).withColumn("reference_origin_id", F.when(F.col("inspection_id") > 1, F.col("inspection_id") - 3))
    assert {r["inspection_id"] for r in C.retain_recent(linked, 1).collect()} == {9, 6, 3}


def test_deleting_keeps_dependents(spark):
    out = {r["inspection_id"]: r for r in C.materialize_deleted(history(spark), history(spark).where("inspection_id = 1")).collect()}
    assert 1 not in out and out[2]["reference_storage"] == "materialized_history" and out[2]["active_reference_id"] is None and out[2]["reference_origin_id"] == 1
    assert out[4]["reference_storage"] == "materialized_history" and out[8]["active_reference_id"] == 9


def test_positions_of_one_hot_key(spark):
    rows = spark.range(5000).select(F.lit("k").alias("key"), (F.col("id") * 7919 % 5000).alias("t"), F.col("id"))
    placed = ordered_positions(rows.repartition(6), ["key"], ["t"], F.floor(F.col("t") / 100))
    assert placed.where("pos <> t + 1").count() == 0
    prev = shifted(placed, placed, ["key"], -1, {"t": "prev"})
    assert prev.where("pos > 1 AND (prev IS NULL OR prev <> t - 1)").count() == 0
