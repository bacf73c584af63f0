"""The registered queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, conversations, exact_dedup, imatch, license_scan, mixing, packing, periodic, secret_scan, sharding, simhash, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates of all documents; rows as :func:`simhash.near_duplicates` defines them."""
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@query("op2_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Exact duplicates of all documents; rows as :func:`exact_dedup.exact_duplicates` defines them."""
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents")).drop("shuffled")


@query("op3_imatch")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; rows as :func:`imatch.edited_fingerprints` defines them."""
    return imatch.edited_fingerprints(_table(spark, folder, "documents"))


@query("op4_mixing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document; rows as :func:`mixing.mix_plan` defines them."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    plan = mixing.mix_plan(docs, keep_text=False)
    taken = F.aggregate("mix.pieces", F.lit(0).cast("long"), lambda total, piece: total + piece["words"])
    return plan.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"))


@query("op5_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, lower(sha1(payload)) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(i, i + 5), lambda b:
        (((strpos('0123456789abcdef', substr(hex, 1 + b // 4, 1)) - 1) >> (3 - b % 4)) & 1) << (4 - (b - i))))::BIGINT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC records and read back; records as :func:`warc.read_archives` defines them. A gap is an error."""
    records = warc.archive_round_trip(_table(spark, folder, "pages"))
    return warc.intact(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents; scores as :func:`toxicity.scored` defines them, learnt outside the held-out fold."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    rows = toxicity.scored(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % toxicity.FOLDS == 0
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "toxicity.score", "toxicity.predicted", F.size("toxicity.passages").alias("passages"))


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in packed sequences, with the CRC-32 of their ids."""
    pieces = packing.pack_documents(_table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step")


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of all documents with the probability of a secret; the source of a document stands for its path."""
    found = secret_scan.scan(_table(spark, folder, "documents"), path="source")
    return found.select("doc_id", "word_no", "part_no", F.col("length").cast("int").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "coverage", "probability", "secret")


@query("op9_license_scan", license_scan.scan_sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Known licences among the lines, paragraphs and texts of all documents."""
    return license_scan.scan(_table(spark, folder, "documents"))


@query("op10_sharding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all documents as read back from the shards that :func:`sharding.shuffled_shards` wrote."""
    rows = sharding.shuffled_shards(_table(spark, folder, "documents"))
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return rows.select("doc_id", sharding.row_bytes().alias("size"), crc.cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Repairs of all conversations after planted damage; rows as :func:`conversations.repair_conversations` defines them."""
    return conversations.repair_conversations(conversations.damaged(_table(spark, folder, "conversations")))


@query("op12_best_fit")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 ids; rows as :func:`bestfit.pack_best_fit` defines them."""
    return bestfit.pack_best_fit(_table(spark, folder, "documents")).drop("ids")


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of all documents, one of ten of them looped, with digests of the runs and of the collapsed text."""
    rows = periodic.collapse_runs(periodic.with_loops(_table(spark, folder, "documents").select("doc_id", "text")))
    best = periodic.strongest(F.col("periodic.runs"))
    lines = F.transform("periodic.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise(""))
    rows = rows.select("doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), F.col("periodic.text").alias("left"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("left").cast("binary"), 256).alias("collapsed_sha256"))
