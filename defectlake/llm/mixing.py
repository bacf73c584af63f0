"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its rows in seeded order, form a stream that is cut into blocks. A source gives whole epochs of its
blocks and then a random part of one more, so that its words come to the rounded target. The exact numbers of blocks
are split among output shards from the root of a binary tree: each node draws how many blocks of each source go left,
without replacement. Shards then hold disjoint ranges of each source's permuted blocks and are shuffled locally.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, lean_memory, staged, without

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 4096
CHUNK_ROWS = 2_000
MAX_BLOCKS = 500_000_000  # the draws of NumPy hold below 10^9 blocks; larger corpora have larger blocks

_WORD = re.compile(WORD_PATTERN)
PIECE = T.StructType([T.StructField(n, t) for n, t in (("shard", T.IntegerType()), ("epoch", T.IntegerType()), ("block", T.LongType()), ("place", T.LongType()), ("first_word", T.LongType()), ("words", T.LongType()))])


def word_count(text: str = "text") -> Column:
    """Number of words; null has none."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    gaps = list(" \t\n\x0b\x0c\r")
    count = F.size(F.split(value, r"[\x20\x09-\x0D]+", -1))
    edge = lambda c: F.when(c.isin(gaps), 1).otherwise(0)
    return F.when(value == "", 0).otherwise(count - edge(F.substring(value, 1, 1)) - edge(F.substring(value, -1, 1))).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, repeats: float = MAX_REPEATS) -> dict[str | None, float]:
    """Words that each source should give. Sources by code point, null last, take the weights in turn and share all words;
    none exceeds ``repeats`` times its size, and what it leaves is shared by weight among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = dict.fromkeys(order, 0.0), list(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > repeats * sizes[s]]
        for s in over or open_:
            out[s] = float(repeats * sizes[s]) if over else share * weight[s]
            left -= out[s] if over else 0
        open_ = [s for s in open_ if s not in over] if over else []
    return out


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard, ``(shards, sources)``; rows differ by one block in total at most.

    A node that covers several shards draws the left half's share of every source from the multivariate hypergeometric
    distribution, one source after another; its generator is seeded by its place in the tree, so subtrees can be redrawn.
    """
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    each, more = divmod(int(counts.sum()), shards)
    edges = np.cumsum([0, *[each + (i < more) for i in range(shards)]])
    nodes = [(0, shards, counts.astype(np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            out[low] = have
            continue
        middle = (low + high) // 2
        rng = np.random.default_rng([seed & 0xFFFFFFFF, low, high])
        need, rest, left = int(edges[middle] - edges[low]), int(have.sum()), np.zeros_like(have)
        for i, n in enumerate(have.tolist()):
            rest -= n
            left[i] = rng.hypergeometric(n, rest, need) if need and n else 0
            need -= int(left[i])
        nodes += [(low, middle, left), (middle, high, have - left)]
    return out


def permuted(index: np.ndarray, count: int, key: int) -> np.ndarray:
    """Keyed permutation of ``0 .. count - 1``, applied to each index alone: four Feistel rounds, walked until in range."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            z = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while (far := out >= np.uint64(count)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


class SourcePlan:
    """How a source of ``size`` words gives ``quota`` words: whole epochs of its blocks, then some blocks of one more."""

    def __init__(self, size: int, quota: int, block: int, key: int):
        self.size, self.block, self.key = size, block, key
        self.blocks, self.whole = -(-size // block) if size else 0, size // block
        self.epochs, rest = divmod(quota, size) if size else (0, 0)
        self.partial, self.cut = divmod(rest, block)
        self.draws = self.epochs * self.blocks + self.partial + (self.cut > 0)
        self.edges: np.ndarray | None = None  # of the shards, in draws

    def pieces(self, start: int, size: int) -> list[tuple[int, int, int, int, int, int]]:
        """Pieces of the row that holds words ``start`` to ``start + size`` of the source, as (shard, epoch, block, place, first, words)."""
        out = []
        if not size:
            return out
        at = np.arange(start // self.block, (start + size - 1) // self.block + 1)
        low, high = np.maximum(at * self.block, start), np.minimum((at + 1) * self.block, start + size)
        for epoch in range(self.epochs + 1):
            if epoch < self.epochs:
                rank, end = permuted(at, self.blocks, self.key + epoch), high
            else:  # whole blocks in permuted order; the short last one comes after them
                if not self.partial and not self.cut:
                    break
                rank = at.copy()
                full = at < self.whole
                rank[full] = permuted(at[full], self.whole, self.key + epoch)
                end = np.where(rank < self.partial, high, np.where(rank == self.partial, np.minimum(high, at * self.block + self.cut), low))
            place = epoch * self.blocks + rank
            shard = np.searchsorted(self.edges, place, side="right")
            out += [(s, epoch, b, p, a - start, e - a) for s, b, p, a, e in zip(shard.tolist(), at.tolist(), place.tolist(), low.tolist(), end.tolist()) if e > a]
        return out


def mix_plan(docs: DataFrame, shards: int = 24, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 42, keep_text: bool = True) -> DataFrame:
    """Rows of ``docs`` with ``mix`` = struct(size, source_size, target, pieces): what the mix takes of each.

    Sizes are words; a null or empty text has none and gives no piece. Null is a source of its own. A row is taken at most
    ``repeats`` times over, and a source gives its rounded target exactly. Seeded hashes of doc_id and text give the order
    in a source, so reruns agree; equal rows may swap places. An input column called mix is replaced. One row for each source, not more,
    is gathered on the driver. Without ``keep_text`` texts are measured but not carried along.
    """
    spark = docs.sparkSession
    chunks = -(-docs.count() // CHUNK_ROWS) or 1
    names = [f"`{c}`" for c in without(docs, "mix", *["text"] * (not keep_text)).columns]
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct(*names).alias("row__"), F.col("source").cast("string").alias("source__"), word_count().alias("size__"), mixed.alias("hash__"), F.pmod(F.xxhash64(mixed), F.lit(chunks)).alias("chunk__"))
    sums = staged(rows.groupBy("source__", "chunk__").agg(F.sum("size__").alias("n__")), "sums")
    order = Window.partitionBy("source__").orderBy("chunk__").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source__").alias("s__"), F.col("chunk__").alias("c__"), F.coalesce(F.sum("n__").over(order), F.lit(0)).alias("base__"))
    sizes = {r["source__"]: r["n"] for r in sums.groupBy("source__").agg(F.sum("n__").alias("n")).collect()}
    goal = targets(sizes, weights, repeats)
    block = max(block_words, -(-sum(sizes.values()) // MAX_BLOCKS))
    names_ = list(goal)
    plans = {s: SourcePlan(sizes[s], min(round(goal[s]), int(repeats * sizes[s])), block, seed * 1_000_003 + 7919 * i) for i, s in enumerate(names_)}
    quota = split_tree(np.array([plans[s].draws for s in names_], dtype=np.int64), shards, seed) if names_ else np.zeros((shards, 0), dtype=np.int64)
    for i, s in enumerate(names_):
        plans[s].edges = np.cumsum(quota[:, i])
    known = spark.sparkContext.broadcast((plans, goal))

    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        lean_memory()
        plans, goal = known.value
        kind = pa.struct([("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("pieces", pa.list_(pa.struct([("shard", pa.int32()), ("epoch", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64())])))])
        fields = [f.name for f in PIECE.fields]
        for columns in parts:  # texts stay outside Python
            out = []
            for source, size, start in zip(*(c.to_pylist() for c in columns)):
                plan = plans[source]
                out.append({"size": size, "source_size": plan.size, "target": goal[source], "pieces": [dict(zip(fields, p)) for p in plan.pieces(start, size)]})
            yield pa.array(out, kind)

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    within = Window.partitionBy("chunk__", "source__").orderBy("hash__", "row__.doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before__", F.coalesce(F.sum("size__").over(within), F.lit(0)))
    placed = placed.join(starts, F.col("source__").eqNullSafe(F.col("s__")) & (F.col("chunk__") == F.col("c__")))
    placed = placed.select("row__", "source__", "size__", (F.col("base__") + F.col("before__")).alias("start__"))
    mix = T.StructType([T.StructField("size", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("pieces", T.ArrayType(PIECE))])
    # Else the optimizer plans each row once for a filter before the pieces become rows and once more for its column, with two workers at a time.
    return placed.select("row__.*", F.arrow_udf(run, mix).asNondeterministic()("source__", "size__", "start__").alias("mix"))


def cut_words(text: str, first: int, words: int, whole: int) -> str:
    """Words ``first`` to ``first + words`` of a text of ``whole`` words with the space between and after them; the pieces
    of a text in order add up to the text."""
    if words == whole:
        return text
    begin, end = 0, len(text)
    for i, m in enumerate(_WORD.finditer(text)):
        if i == first and i:
            begin = m.start()
        if i == first + words:
            end = m.start()
            break
    return text[begin:end]


def _with_piece_text(rows: DataFrame) -> DataFrame:
    cut = F.pandas_udf(lambda t, a, n, w: t.combine(a, lambda x, y: (x, y)).combine(n.combine(w, lambda x, y: (x, y)), lambda p, q: cut_words(p[0], int(p[1]), int(q[0]), int(q[1]))), "string")
    whole = F.col("piece__.words") == F.col("mix.size")
    return rows.withColumn("text", F.when(whole, F.col("text")).otherwise(cut(F.when(whole, F.lit("")).otherwise(F.col("text")), "piece__.first_word", "piece__.words", "mix.size")))


def mix(docs: DataFrame, shards: int = 24, seed: int = 42, **options) -> DataFrame:
    """The mix itself: pieces of ``docs`` as rows with all columns, text cut to the piece, n_chars (where it is a column)
    its length, and ``shard``, ``epoch``, ``block``, ``first_word``, ``words``, which replace input columns of these names.

    Rows of a shard come in one partition in locally shuffled order. A text that falls into one block is never cut.
    """
    own = ("shard", "epoch", "block", "first_word", "words")
    rows = mix_plan(without(docs, *own), shards, seed=seed, **options)
    rows = _with_piece_text(rows.withColumn("piece__", F.explode("mix.pieces")))
    if "n_chars" in rows.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(rows.schema["n_chars"].dataType))
    rows = rows.select(*[f"`{c}`" for c in rows.columns if c not in ("mix", "piece__")], *[f"piece__.{c}" for c in own], F.xxhash64(F.lit(seed), "doc_id", "piece__.place", "piece__.first_word").alias("key__"))
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key__").drop("key__")
