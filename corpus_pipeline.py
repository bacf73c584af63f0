"""The corpus pipeline: stages applied to ``documents`` one after another, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm import exact_dedup, mixing, packing, simhash, toxicity
from defectlake.llm.common import staged

# Rows and bytes of a batch for Python, whichever comes first: two batches of whole texts in JVM and worker stay at some MB, not some hundred.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def _lean(spark: SparkSession) -> None:
    """The pipeline owns its session: executors that run all stages keep little memory for batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts to be toxic go; it learns from the labels outside the held-out fold.

    Null and empty texts have no toxic passage and stay unless the labels make most documents toxic; equal rows share their
    fate. Columns of any name come back as they were. No rows give no rows.
    """
    _lean(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, "toxicity__").filter(F.col("toxicity__.predicted") == 0).drop("toxicity__")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after folding A-Z the row with the largest doc_id stays, of several such rows one of them.

    Null counts as empty, so of all null and empty texts one stays. Columns of any name come back; no rows give no rows.
    """
    _lean(spark)
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays, of several such rows one of them.

    Texts without words are like one another. Columns of any name come back; no rows give no rows.
    """
    _lean(spark)
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: a row for each piece, its text cut accordingly, by shards in shuffled order.

    A null or empty text has no words and is not taken; null is a source of its own; equal rows are taken alike but may swap
    places. Only the columns of ``docs`` come back, whatever their names. No rows give no rows.
    """
    _lean(spark)
    # The mix adds columns of its own; those of the documents keep their values under names that none of them has.
    inner = [c if c.lower() in ("doc_id", "text", "source", "n_chars") else f"kept__{i}" for i, c in enumerate(docs.columns)]
    return mixing.mix(docs.toDF(*inner)).select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns)])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in packed sequences.

    A null or empty text is the end id alone; rows with null or equal doc_ids are documents of their own; other columns are
    not read. No rows give no rows.
    """
    _lean(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", clean), ("exact dedup", exact), ("simhash near dedup", near), ("mixing to target weights", mixed), ("packing", packed)]

# Trained scores, 64-bit shingle hashes, seeded permutations and token ids are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
