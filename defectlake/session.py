"""Session helpers: checkpoint location, stored tables and size-checked broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is no longer broadcast; wider tables pass a smaller figure.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (shared storage). Only a local master may do without that
    setting, as in tests; then a temporary folder is set.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = configured or tempfile.mkdtemp(prefix="defectlake-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as compressed Parquet in the checkpoint folder and cut its lineage.

    A checkpoint holds whole rows uncompressed, some ten times as much; sorted rows get smallest.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when counting at most ``max_rows + 1`` of its rows proves it small.

    Larger sides come back unhinted, so the join stays a shuffle join that AQE may still re-plan.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def measured(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a summary that is both counted and joined back, and broadcast it only if its row count allows."""
    return broadcast_if_small(checkpoint(df), max_rows)
