"""SimHash near duplicates through multi-index hashing.

A fingerprint has 64 bits over the word shingles of a text. Two fingerprints that differ in at most two bits agree in
the upper half up to one bit, or else agree in the whole lower half. Each fingerprint therefore looks up the table of
upper halves at all members of the Hamming ball of radius one around its own upper half, and the table of lower halves
at its own lower half. Keys also hold a part of the other half, which the bits that are left must leave intact, so that
a bucket stays small even where many different fingerprints share a half. Complete distances are checked last.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean_memory, staged, values_of, word_chunks
from .components import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_DISTANCE = 2

# Similar texts: 256 least values of the set of five-word shingles, a byte of each, in 32 bands of 8. Each byte is equal with the similarity as
# probability, so that a band of two texts of similarity 0.8 is equal with 0.17 and some band with 0.997.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_BYTES = 32, 8
WIDE_BYTES = BANDS * BAND_BYTES
LEAST_EQUAL = 174  # of 256 bytes, of which texts of similarity 0.8 share 205, 4.8 standard deviations more; the shingles themselves decide
NEAR_EQUAL = 205  # where texts cannot be told by their ids
BLOCK_SHINGLES = 2048
# Within a group of like 64-bit fingerprints shorter bands do: one of ten is equal for 0.999 of pairs at 0.8, for 0.01 at 0.1.
SHORT_BANDS, SHORT_BYTES = 10, 3
BROADCAST_IDS = 200_000
LARGE_BUCKET = 64
FEW_LINKS = 0.01  # of all links so far; a round that adds no more is not worth its jobs, the last comparison finds what it would

_OFFSETS = np.arange(8, dtype=np.int64) * 256
_FACTORS = np.random.default_rng(HASH_SEED).integers(1 << 31, size=WIDE_BYTES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _shingle_hashes(text: bytes, k: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 values of the k-word shingles, repeats included, in arrays of bounded length."""
    carry: list[bytes] = []
    full = False
    for words in word_chunks(text.lower()):
        words = carry + words
        if len(words) >= k:
            full = True
            joined = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends]
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :])], dtype=np.uint64)
        carry = words[-(k - 1) :] if k > 1 else []
    if not full and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), seed)], dtype=np.uint64)


def fingerprint(text: bytes | None, k: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """The fingerprint as a signed 64-bit number: bit i is set if over half of the shingle hashes set it; no words give zero."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in _shingle_hashes(text or b"", k, seed):
        total += len(hashes)
        counts = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048)
        ones += (counts.reshape(8, 256) @ _BITS).ravel()
    value = sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; null and empty texts have fingerprint zero. Texts are read whole."""

    def run(batches):
        lean_memory()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, k, seed) for t in values_of(batch.column(1))], pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _piece(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


# How 32 bits are cut so that two changed bits leave one of three pieces intact, and one changed bit one of two.
_THIRDS = ((0, 11), (11, 11), (22, 10))
_HALVES = ((0, 16), (16, 16))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """All pairs ``(u, v)``, u < v, of the fingerprints in ``distinct(fp)`` that differ in one or two bits; each once.

    Every fingerprint gives eight table entries and about 38 look-ups, whatever the size of its neighbourhood.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    key = lambda kind, a, b: F.struct(F.lit(kind).cast("int").alias("kind"), a.cast("long").alias("a"), b.cast("int").alias("b"))
    same = [key(i, high, _piece(low, *cut)) for i, cut in enumerate(_THIRDS)] + [key(5 + i, low, _piece(high, *cut)) for i, cut in enumerate(_THIRDS)]
    # Of two halves one bit apart, the one with that bit set looks up the other.
    flips = F.array(*[F.when(F.shiftright(high, i).bitwiseAND(F.lit(1)) == 1, high.bitwiseXOR(F.lit(1 << i))) for i in range(32)])
    ball = F.filter(flips, lambda x: x.isNotNull())
    look = lambda i, cut: F.transform(ball, lambda x: key(3 + i, x, _piece(low, *cut)))
    near = [look(i, cut) for i, cut in enumerate(_HALVES)]
    entries = F.array(*same, *[key(3 + i, high, _piece(low, *cut)) for i, cut in enumerate(_HALVES)])
    table = distinct.select(F.inline(entries), F.col("fp").alias("v"))
    probes = distinct.select(F.inline(F.concat(F.array(*same), *near)), F.col("fp").alias("u"))
    found = probes.join(table, ["kind", "a", "b"]).filter("u <> v and (kind between 3 and 4 or u < v)").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE)
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _bits(text: bytes | None) -> bytes:
    """Sketch of the set of five-word shingles: a byte of the least of their hashes under each of 256 orders. Repeats change nothing; no words give zeros."""
    least, some = np.full(WIDE_BYTES, 0xFFFFFFFF, dtype=np.uint32), False
    for hashes in _shingle_hashes(text or b"", SIMILAR_WORDS, HASH_SEED):
        some, short = True, (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(short), BLOCK_SHINGLES):
            np.minimum(least, (short[i : i + BLOCK_SHINGLES] * _FACTORS).min(axis=1), out=least)
    # The low byte is that of the hash that is least; the high ones are small for all.
    return least.astype(np.uint8).tobytes() if some else bytes(WIDE_BYTES)


def _both_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, wide)`` of every row."""

    def run(batches):
        lean_memory()
        for batch in batches:
            marks = [(fingerprint(t), _bits(t)) for t in values_of(batch.column(1))]
            columns = [batch.column(0), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "wide"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, wide binary")


def _buckets(classes: DataFrame, both: DataFrame) -> DataFrame:
    """``(key, id)``: sketches of ``classes(id, wide)`` with the same key have an equal band, or a shorter one and 64-bit fingerprints of
    ``both(fp, id)`` in the same group of :func:`near_duplicates`."""
    cut = lambda i, width: F.substring("wide", width * i + 1, width)
    bands = classes.select(F.explode(F.array(*[F.xxhash64(F.lit(i), cut(i, BAND_BYTES)) for i in range(BANDS)])).alias("key"), "id")
    roots = connected_components(fingerprint_links(both.select("fp").distinct()))
    pools = both.join(roots, both.fp == roots.node, "left").select("id", F.coalesce("root", "fp").alias("pool")).distinct()
    pools = pools.join(pools.groupBy("pool").count().filter("count > 1").select("pool"), "pool", "left_semi").join(classes.select("id", "wide"), "id")
    short = F.array(*[F.xxhash64(F.lit(BANDS + i), "pool", cut(i, SHORT_BYTES)) for i in range(SHORT_BANDS)])
    return _shared(bands.union(pools.select(F.explode(short).alias("key"), "id")))


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of the buckets ``keys(key, id)`` with two members or more, each once."""
    keys = staged(keys.distinct(), "keys")
    return staged(keys.join(keys.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi"), "buckets")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(u, v, equal)`` of pairs of ids whose sketches have at least ``LEAST_EQUAL`` bytes in common."""
    one, two = classes.select(F.col("id").alias("u"), F.col("wide").alias("a")), classes.select(F.col("id").alias("v"), F.col("wide").alias("b"))

    def run(batches):
        lean_memory()
        sketches = lambda column: np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, WIDE_BYTES)
        for batch in batches:
            equal = (sketches(batch.column(2)) == sketches(batch.column(3))).sum(axis=1)
            kept = pa.array(equal >= LEAST_EQUAL)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal, pa.int64())], ["u", "v", "equal"]).filter(kept)

    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, equal long")


def _grown(docs: DataFrame, classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Components ``(node, root)`` of all similar pairs that share a bucket.

    Each round compares the members of a bucket with one or two of its members, picked anew by round, that are in other components.
    Near copies thus join one component without the square of their number. Once a round adds few of the links, or few pairs are left, all pairs
    that share a bucket, are in different components and were never compared are compared, so that none is left out; large buckets give
    the pairs that :func:`_prefix_pairs` leaves, which holds all similar ones.
    """
    known, tested, turn, last, total, added = classes.count(), None, 0, False, 0, 0
    links = buckets.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    while True:
        roots = connected_components(links)
        if last:
            return roots
        members = staged(buckets.join(roots, buckets.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root")), "members")
        sizes = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")).filter("s * s > q")
        left = sizes.agg(F.sum(F.expr("cast(s as double) * s - q") / 2)).first()[0] or 0
        if not left:
            return roots
        last = turn > 0 and (left <= known or added <= FEW_LINKS * total)
        if last:
            pairs = _last_pairs(docs, classes, members)
        else:
            pick = F.struct(F.xxhash64("id", F.lit(turn)).alias("order"), "id", "root")
            ends = members.groupBy("key").agg(F.min(pick).alias("low"), F.max(pick).alias("high"), F.min("root").alias("one"), F.max("root").alias("two")).filter("one <> two")
            pairs = members.join(ends, "key").select("id", "root", F.explode(F.array("low", "high") if turn else F.array("low")).alias("end")).filter("root <> end.root").select("id", F.col("end.id").alias("other"))
        pairs = pairs.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        found = staged(_similar_links(docs, classes, _likely(pairs, classes)), "similar")
        added = found.count()
        total += added
        links, tested, turn = links.union(found), pairs if tested is None else tested.union(pairs), turn + 1


def _last_pairs(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, other)`` of ``members(key, id, root)`` that share a bucket and are in different groups, without those that cannot be similar."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.countDistinct("root").alias("roots")).filter("roots > 1")
    rows = staged(members.join(sizes, "key").drop("roots"), "last")
    small, large = rows.filter(F.col("size") <= LARGE_BUCKET).drop("size"), rows.filter(F.col("size") > LARGE_BUCKET).drop("size")
    other = small.toDF("key", "other", "other_root")
    pairs = small.join(other, "key").filter("id < other and root <> other_root").select("id", "other")
    # Texts without an id cannot be read again, so that their buckets give all their pairs.
    lost = large.join(classes.filter("first is null").select("id"), "id", "left_semi")
    again = large.toDF("key", "other", "other_root")
    pairs = pairs.union(lost.join(again, "key").filter("id <> other and root <> other_root").select("id", "other"))
    return pairs.union(_prefix_pairs(docs, classes, staged(large.select("id", "root").distinct(), "large")))


def _prefix_pairs(docs: DataFrame, classes: DataFrame, large: DataFrame) -> DataFrame:
    """``(id, other)`` of ``large(id, root)`` in different groups that may be similar.

    Two sets of which 0.8 is common share one of the rarest ``floor(0.2 n) + 1`` shingles of each, in one order of all shingles. Rare
    shingles come first, so that a template that many texts share makes no pairs. Of rows with one doc_id each text counts.
    """
    wanted = large.join(classes.select("id", F.col("first").alias("first__")), "id").filter("first__ is not null").select("first__", "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("first__"), F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted, "first__").select("id", "text")

    def run(batches):
        lean_memory()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1))):
                own = xxhash.xxh64_intdigest(text or b"") >> 1
                held = np.array(sorted(shingle_set(text)), dtype=np.uint64).astype(np.int64)
                for i in range(0, len(held), 10_000):
                    part = held[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(np.full(len(part), own)), pa.array(part), pa.array(np.full(len(part), len(held)))], ["id", "own", "shingle", "n"])

    shingles = staged(texts.mapInArrow(run, "id long, own long, shingle long, n long").distinct(), "shingles")
    often = shingles.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    # A shingle of one text alone joins nothing: only how many of them come before the others counts.
    shared = shingles.join(often, "shingle")
    alone = shared.groupBy("id", "own").agg((F.max("n") - F.count("*")).alias("alone"))
    place = F.row_number().over(Window.partitionBy("id", "own").orderBy("often", "shingle"))
    prefix = shared.join(alone, ["id", "own"]).withColumn("place", F.col("alone") + place).filter(F.col("place") <= F.floor(F.col("n") * F.lit(1 - SIMILARITY + 1e-9)) + 1)
    rows = staged(prefix.select("id", "shingle").distinct().join(large, "id"), "prefixes")
    other = rows.toDF("other", "shingle", "other_root")
    return rows.join(other, "shingle").filter("id < other and root <> other_root").select("id", "other").distinct()


def shingle_set(text: str | bytes | None) -> set[int]:
    text = text.encode() if isinstance(text, str) else text or b""
    return {h for part in _shingle_hashes(text, SIMILAR_WORDS, HASH_SEED) for h in part.tolist()}


def _similar_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Those of the candidate pairs of ``classes(id, first)`` whose texts have a Jaccard similarity of shingles of 0.8 or more."""
    pairs = staged(candidates, "candidates")
    first = classes.select("id", "first")
    pairs = pairs.join(first.toDF("u", "u_id"), "u").join(first.toDF("v", "v_id"), "v")
    ids = staged(pairs.select(F.explode(F.array("u_id", "v_id")).alias("id__")).filter("id__ is not null").distinct(), "ids")
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if small else ids, F.col("doc_id").cast("long") == F.col("id__"), "left_semi").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = staged(texts, "texts")

    def run(batches):
        lean_memory()
        last, held = None, set()
        for batch in batches:
            kept = []
            for x, y in zip(values_of(batch.column(2)), values_of(batch.column(3))):
                if last is None or x != last:
                    last, held = x, shingle_set(x)
                other = shingle_set(y)
                kept.append(len(held & other) >= SIMILARITY * len(held | other))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    # Sorting by the first text lets its shingles be reused.
    sides = pairs.join(texts.toDF("u_id", "a"), "u_id").join(texts.toDF("v_id", "b"), "v_id").sortWithinPartitions("u_id")
    alike = sides.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")
    return alike.union(pairs.filter("(u_id is null or v_id is null)").filter(F.col("equal") >= NEAR_EQUAL).select("u", "v"))


def _members(docs: DataFrame) -> DataFrame:
    rows = staged(fingerprints(docs), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp")))
    classes = staged(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root")), "classes")
    lowest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(classes.join(lowest, "root").select("fp", "component_id", "copies", "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id, copies)`` for every row of ``docs``.

    Rows link where their fingerprints differ in at most two bits; ``component_id`` is the smallest doc_id that can be
    reached and ``copies`` the number of rows with the same fingerprint. Equal rows stay apart as rows. A null doc_id is
    never the smallest unless the component has no other; null and empty texts share fingerprint zero. Other columns of
    ``docs`` are not read. No rows give no rows.
    """
    return _members(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


def _groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, id, root, component_id)`` of every row, by the links of similar texts; like 64-bit fingerprints only make candidates."""
    rows = staged(_both_fingerprints(docs).withColumn("id", F.xxhash64("wide")), "fingerprints")
    classes = staged(rows.groupBy("id").agg(F.min("wide").alias("wide"), F.min("doc_id").alias("first")), "classes")
    roots = _grown(docs, classes, _buckets(classes, staged(rows.select("fp", "id").distinct(), "both")))
    known = staged(classes.join(roots, classes.id == roots.node, "left").select("id", "first", F.coalesce("root", "id").alias("root")), "roots")
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "id").join(known.join(lowest, "root").select("id", "root", "component_id"), "id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns: that with the smallest doc_id.

    Rows are linked where their texts have a Jaccard similarity of five-word shingles of 0.8 or more and an equal band of their
    sketches finds them, which 0.997 of pairs at exactly 0.8 have, or :func:`near_duplicates` groups them. Its groups alone link
    nothing, since a line that a text repeats can set its fingerprint. Where rows share the smallest doc_id of a group,
    or the group has none, the row of it that compares largest over all columns stays, so reruns agree. Extra columns are
    kept whatever they are called.
    """
    members = staged(_groups(docs), "members")
    stay = members.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id__"), "id", "root").distinct()
    again = staged(members.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("id__")), "repeated")
    plain = stay.join(again, "id__", "left_anti").filter("id__ is not null").select("id__")
    own = F.col("doc_id").cast("long")
    single = docs.join(plain, own == F.col("id__"), "left_semi")
    # Rows with a repeated or missing doc_id are told apart by their sketches.
    rest = docs.join(again, own.eqNullSafe(F.col("id__")), "left_semi").select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row__"))
    mark = F.pandas_udf(lambda texts: texts.map(lambda t: _bits(t.encode() if t else b"")), "binary")
    rest = rest.withColumn("id__", F.col("row__.doc_id").cast("long")).withColumn("mark__", F.xxhash64(mark(F.col("row__.text").cast("string"))))
    kept = rest.join(stay.withColumnRenamed("id__", "key__"), F.col("id__").eqNullSafe(F.col("key__")) & (F.col("mark__") == F.col("id"))).groupBy("root").agg(F.max("row__").alias("row__"))
    return single.unionByName(kept.select("row__.*"))
