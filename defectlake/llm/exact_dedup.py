"""Exact duplicates by two passes over Bloom filters.

The first pass gathers, for every cell of a Bloom filter, whether rows have hit it once or more often. A text that
repeats has hit all its cells at least twice, so the second pass lets every row with a cell below two pass straight
through; only rows that may repeat are shuffled and compared by their complete digests. Filters never miss a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean_memory, scratch_path, staged, values_of

HASHES = 4
CELLS_PER_ROW = 16
MAX_FILTER_BYTES = 64 << 20
BLOCK_BYTES = 1 << 16


def text_digest(text: bytes | None) -> bytes:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return hashlib.sha256((text or b"").lower()).digest()


def _ranges(rows: int, max_bytes: int) -> int:
    return max(1, -(-rows * CELLS_PER_ROW // (8 * max_bytes)))


def _digests(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` rows as ``(row, doc_id, digest, part)``; ``part`` is the hash range whose filter knows the digest."""

    def run(batches):
        lean_memory()
        for batch in batches:
            digests = [text_digest(t) for t in values_of(batch.column(2))]
            parts = [int.from_bytes(d[:4], "big") % ranges for d in digests]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(parts, pa.int32())], ["row", "doc_id", "digest", "part"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, digest binary, part int")


def _cells(digests: pa.Array, cells: int) -> np.ndarray:
    """One cell per hash and digest; each hash has a quarter of the filter for itself."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), dtype=np.uint8).reshape(-1, 32)
    words = np.ascontiguousarray(raw[:, 8 : 8 + 4 * HASHES]).view("<u4").reshape(-1, HASHES).astype(np.int64)
    each = cells // HASHES
    return words % each + np.arange(HASHES) * each


def repeated_cells(keys: DataFrame, cells: int) -> np.ndarray:
    """Bit map of the cells that rows of ``keys(digest)`` hit at least twice; ``cells // 8`` bytes, made block by block."""

    def gather(batches):
        once, twice = np.zeros(cells // 8, dtype=np.uint8), np.zeros(cells // 8, dtype=np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            hit, count = np.unique(_cells(batch.column(0), cells), return_counts=True)
            byte, bit = hit >> 3, np.left_shift(1, hit & 7).astype(np.uint8)
            again = (count > 1) | ((once[byte] & bit) > 0)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
        size = min(BLOCK_BYTES, cells // 8)
        blocks = [i for i in range(0, cells // 8, size) if once[i : i + size].any()]
        for i in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([once[i : i + size].tobytes()], pa.binary()), pa.array([twice[i : i + size].tobytes()], pa.binary())], ["at", "once", "twice"])

    def merge(key, table):  # a block of 64 KB from each task
        once = twice = None
        for one, two in zip(table.column("once"), table.column("twice")):
            one, two = np.frombuffer(one.as_py(), dtype=np.uint8), np.frombuffer(two.as_py(), dtype=np.uint8)
            once, twice = (one, two) if once is None else (once | one, twice | two | (once & one))
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "twice": pa.array([twice.tobytes()], pa.binary())})

    partial = keys.select("digest").mapInArrow(gather, "at long, once binary, twice binary")
    merged = partial.groupBy("at").applyInArrow(merge, "at long, twice binary").filter(F.col("twice").isNotNull())
    out = np.zeros(cells // 8, dtype=np.uint8)
    for block in merged.toLocalIterator():  # at most the documented filter size
        piece = np.frombuffer(bytes(block["twice"]), dtype=np.uint8)
        out[block["at"] : block["at"] + len(piece)] = piece
    return out


def _flagged(keys: DataFrame, cells: int) -> DataFrame:
    """``keys`` with ``maybe``: whether the digest may repeat."""
    spark = keys.sparkSession
    known = spark.sparkContext.broadcast(repeated_cells(keys, cells))

    def probe(batches):
        for batch in batches:
            hit = _cells(batch.column("digest"), cells) if batch.num_rows else np.zeros((0, HASHES), dtype=np.int64)
            maybe = ((known.value[hit >> 3] >> (hit & 7).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe, pa.bool_())], [*batch.schema.names, "maybe"])

    return keys.mapInArrow(probe, T.StructType([*keys.schema.fields, T.StructField("maybe", T.BooleanType())]))


def flagged_rows(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``(row, doc_id, digest, maybe)`` of every row of ``docs``; rows without ``maybe`` have a text of their own.

    A filter has 16 cells for each row. Where one filter would exceed ``max_filter_bytes``, the table of digests is
    written by hash ranges and each range has a filter of its own, so memory stays bounded and work linear.
    """
    rows = docs.count()
    ranges = _ranges(rows, max_filter_bytes)
    path = scratch_path(docs.sparkSession, "digests")
    table = _digests(docs, ranges)
    table.write.partitionBy(*["part"] * (ranges > 1)).parquet(path)
    read = docs.sparkSession.read.schema(table.schema).parquet(path)
    cells = max(1024, 1 << (rows * CELLS_PER_ROW // ranges).bit_length())
    parts = [_flagged(read.filter(F.col("part") == i) if ranges > 1 else read, cells) for i in range(ranges)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return staged(out.drop("part"), "flagged")


def exact_duplicates(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, shuffled)`` for every row of ``docs``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id
    of a group stays; a null doc_id loses to any other, and of rows that repeat the largest doc_id one stays. ``shuffled``
    tells whether the filters let the row pass straight through. Other columns are not read; no rows give no rows.
    """
    rows = flagged_rows(docs, max_filter_bytes)
    sole = rows.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", F.lit(False).alias("shuffled"))
    some = rows.filter("maybe")
    groups = some.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    groups = staged(groups, "groups")  # so that the join has exchanges of its own, which adaptive execution splits where a group is large
    both = some.join(groups, "digest").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest", F.lit(True).alias("shuffled"))
    return sole.union(both).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "shuffled")


def drop_duplicates(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` drops, all columns kept whatever they are called.

    The row with the largest doc_id of each text stays; of rows that share it, the one that compares largest over all
    columns. A filter of the digests that do repeat lets all other rows pass without a shuffle. It has 16 cells for each
    such digest, up to ``max_filter_bytes``; beyond that more rows shuffle, with the same result.
    """
    spark = docs.sparkSession
    marks = flagged_rows(docs, max_filter_bytes).filter("maybe")
    groups = staged(marks.groupBy("digest").agg(F.max("doc_id").alias("keep__"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("digest__"), "keep__", F.col("n").alias("n__")), "groups")
    cells = max(1024, min(8 * max_filter_bytes, 1 << (groups.count() * CELLS_PER_ROW).bit_length()))
    doubled = groups.select(F.col("digest__").alias("digest"))
    known = spark.sparkContext.broadcast(repeated_cells(doubled.union(doubled), cells))

    def probe(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean_memory()
        for batch in texts:
            digests = pa.array([text_digest(t) for t in values_of(batch)], pa.binary())
            hit = _cells(digests, cells) if len(batch) else np.zeros((0, HASHES), dtype=np.int64)
            maybe = ((known.value[hit >> 3] >> (hit & 7).astype(np.uint8)) & 1).all(axis=1)
            yield pa.StructArray.from_arrays([digests, pa.array(maybe, pa.bool_())], ["digest", "maybe"])

    probe.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Else the optimizer digests each text once for the filter and once more for its column, with two workers at a time for a task.
    mark = F.arrow_udf(probe, "struct<digest: binary, maybe: boolean>").asNondeterministic()
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row__"), mark(F.col("text").cast("string")).alias("mark__"))
    rows = rows.select("row__", F.col("mark__.digest").alias("digest__"), F.col("mark__.maybe").alias("maybe__"))
    sole = rows.filter(~F.col("maybe__")).select("row__.*")
    found = rows.filter("maybe__").join(groups, "digest__", "left").withColumn("hit__", F.col("n__").isNotNull())
    other = found.filter(~F.col("hit__")).select("row__.*")
    best = found.filter(F.col("hit__") & F.col("row__.doc_id").cast("long").eqNullSafe(F.col("keep__"))).groupBy("digest__").agg(F.max("row__").alias("row__")).select("row__.*")
    return sole.union(other).union(best)
