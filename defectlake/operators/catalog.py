"""Engine catalog ranking, filtering and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def engine_rank() -> Column:
    return (F.when(F.col("id") == "cdm_1", 0).when(F.col("catalog_owned"), 1)
            .when(F.col("catalog_visibility") == "always", 2).when(F.col("browser_ready"), 3)
            .when(F.col("recommended"), 4).otherwise(5).cast("long"))


def rank_engines(catalog: DataFrame) -> DataFrame:
    """Catalog with ``priority`` 0-5; sort by (priority, name) to list it."""
    return catalog.withColumn("priority", engine_rank()).withColumn("sort_name", F.coalesce(F.nullif("name", F.lit("")), F.col("id")))


def filter_engines(catalog: DataFrame, mode: str = "all") -> DataFrame:
    flags = {"owned": "catalog_owned", "recommended": "recommended", "verified": "cloud_verified", "browser": "browser_ready"}
    if mode in flags:
        return catalog.where(F.col(flags[mode]))
    if mode == "public":
        return catalog.where(F.col("domain_mode") == "public_shm_checkpoint")
    if mode == "optional":
        return catalog.where(F.col("domain_mode").isin("optional_runtime", "shm_checkpoint", "generic_pretrained"))
    return catalog


def search_engines(catalog: DataFrame, text: str) -> DataFrame:
    needle = text.strip().lower()
    if not needle:
        return catalog
    columns = [F.nullif(c, F.lit("")) for c in ("name", "family", "task", "description", "domain_mode", "catalog_group")]
    return catalog.where(F.lower(F.concat_ws(" ", *columns)).contains(needle))


def engine_kpis(runs: DataFrame, detections: DataFrame) -> DataFrame:
    """Per image: engines run, succeeded, failed and detections found."""
    counts = runs.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("engines_total"), F.count_if(F.col("status") == "ok").alias("engines_ok"),
        F.count_if(F.col("status") != "ok").alias("engines_failed"))
    found = detections.groupBy("image_id").agg(F.count(F.lit(1)).alias("detections"))
    return counts.join(found, "image_id", "left").withColumn("detections", F.coalesce("detections", F.lit(0)).cast("long"))
