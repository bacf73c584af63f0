"""Shuffled shards by a two-pass external shuffle.

The first pass scatters rows into buckets of a size that fits into memory, by a seeded hash of the row. The second pass
reads one bucket at a time, applies a seeded Fisher-Yates shuffle and writes it. The buckets in order are a uniform
permutation of all rows, which is cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean_memory, scratch_path, without

BUCKET_BYTES = 32 << 20
ROW_BYTES = 8


def row_bytes() -> F.Column:
    """UTF-8 bytes of the text, none for null, and 8 for the row."""
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def fisher_yates(count: int, seed: int, bucket: int, part: int) -> np.ndarray:
    """Seeded permutation of ``count`` rows; NumPy's ``permutation`` swaps by Fisher and Yates."""
    return np.random.default_rng([seed & 0xFFFFFFFF, bucket, part]).permutation(count)


def _permute(seed: int, limit: int, weight: int, at: int):
    """Shuffle runs of equal bucket in a stream of batches sorted by bucket and row hash.

    A bucket over ``limit`` bytes, which only equal rows can make, is shuffled in parts: its rows already come in the
    order of their hashes, so parts are as random as the bucket, and memory stays bounded.
    """

    def run(batches):
        lean_memory()
        held, size, bucket, part, done = [], 0, None, 0, 0

        def flush():
            nonlocal held, size, part, done
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            order = fisher_yates(table.num_rows, seed, bucket, part)
            table = table.take(pa.array(order))
            table = table.append_column("index__", pa.array(np.arange(done, done + table.num_rows), pa.int64()))
            done, part, held, size = done + table.num_rows, part + 1, [], 0
            yield from table.to_batches(max_chunksize=2000)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            sizes = np.cumsum(batch.column(weight).to_numpy())
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != bucket:
                    yield from flush()
                    bucket, part, done = int(keys[a]), 0, 0
                while a < b:
                    base = int(sizes[a - 1]) if a else 0
                    end = min(b, max(a + 1, int(np.searchsorted(sizes, base + limit - size, side="right"))))
                    held.append(batch.slice(a, end - a))
                    size += int(sizes[end - 1]) - base
                    a = end
                    if size >= limit:
                        yield from flush()
        yield from flush()

    return run


def shuffled_shards(docs: DataFrame, shards: int = 24, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write ``docs`` shuffled into Parquet files and return them with ``shard``, ``slot`` and ``bucket``.

    All columns stay, but an input column called shard, slot or bucket is replaced. Law: rows. Shards are numbered from 0,
    slots within a shard from 0 without gaps, and row counts of shards differ by one at most, so that with fewer rows than
    shards the last shards are empty. Null ids, null or empty texts and repeated rows are rows like any other; equal rows
    may swap places between reruns, otherwise seed and content decide. The files go to ``path`` or the shared folder.
    """
    spark = docs.sparkSession
    rows = without(docs, "shard", "slot", "bucket")
    total = rows.agg(F.sum(row_bytes()).alias("bytes"), F.count("*").alias("rows")).first()
    count, buckets = total["rows"], max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    names = [f"`{c}`" for c in rows.columns]
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    # A second hash gives the bucket, so that rows of a bucket are still in random order when sorted by the first.
    keyed = rows.select(F.struct(*names).alias("row__"), row_bytes().alias("size__"), mixed.alias("hash__"), F.pmod(F.xxhash64(mixed, F.lit(seed + 1)), F.lit(buckets)).cast("long").alias("bucket__"))
    dealt = keyed.repartitionById(min(buckets, 100_000), F.col("bucket__").cast("int")).sortWithinPartitions("bucket__", "hash__", "row__.doc_id")
    schema = T.StructType([*dealt.schema.fields, T.StructField("index__", T.LongType())])
    path = path or scratch_path(spark, "shards")
    dealt.mapInArrow(_permute(seed, 2 * bucket_bytes, dealt.columns.index("size__"), dealt.columns.index("bucket__")), schema).drop("size__", "hash__").write.parquet(path)
    written = spark.read.schema(T.StructType([schema["row__"], schema["bucket__"], schema["index__"]])).parquet(path)
    sizes = written.groupBy("bucket__").agg(F.count("*").alias("n")).orderBy("bucket__").collect()  # one row for each bucket of 32 MB
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).tolist()
    offsets = spark.createDataFrame([(r["bucket__"], s) for r, s in zip(sizes, starts)], "bucket__ long, start__ long")
    offsets = F.broadcast(offsets) if len(sizes) <= 200_000 else offsets
    place = F.col("start__") + F.col("index__")
    each, more = divmod(count, shards)
    edge = more * (each + 1)
    shard = F.when(place < edge, F.expr(f"(start__ + index__) div {each + 1}")).otherwise(F.expr(f"{more} + (start__ + index__ - {edge}) div {max(each, 1)}"))
    slot = F.when(place < edge, place % (each + 1)).otherwise((place - edge) % max(each, 1))
    return written.join(offsets, "bucket__").select("row__.*", shard.cast("int").alias("shard"), slot.alias("slot"), F.col("bucket__").alias("bucket"))
