"""I-Match document fingerprints, in DataFrame functions alone.

A lexicon keeps the terms whose inverse document frequency lies in a band. Of each text, the distinct terms in the lexicon
are sorted, and those of several random subsets of the lexicon are hashed, one hash for each subset. Subsets hold a half
down to a hundredth of the lexicon, so that short and long texts both have some that an edit leaves alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, without

TERM_SPLIT = r"[^\p{L}\p{N}]+"
LEAST_SHARE, MOST_SHARE = 0.001, 0.2  # of documents that hold a term: the band of inverse document frequencies
# A subset keeps a term if so many bits of its hash, from a place of their own on, are zero.
SUBSETS = tuple((16 * i + at, bits) for i in range(4) for bits, at in ((1, 0), (3, 1), (5, 4), (7, 9)))
EMPTY = "0" * 8
SLOT_TERMS = 2


def terms(text: Column) -> Column:
    """Sorted 64-bit hashes of the distinct terms of a text: runs of letters and digits in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), TERM_SPLIT), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """``(term, docs)`` of the terms in the band, over all documents.

    A text adds its distinct terms once each, so the band holds at most (mean distinct terms of a text) / ``least`` terms,
    however many documents there are. Terms of a single document are never in the band.
    """
    count = docs.count()
    low, high = max(2, math.ceil(least * count)), max(2, math.floor(most * count))
    each = docs.select(F.explode(terms(F.col("text"))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("docs")).filter(F.col("docs").between(low, high))


def _lookup(words: DataFrame) -> tuple[DataFrame, int]:
    """One row with an array of slots of terms, for tests of membership without a join, and its number of slots."""
    size = max(1, words.count() // SLOT_TERMS)
    slots = words.groupBy(F.pmod("term", F.lit(size)).alias("slot")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    every = words.sparkSession.range(size).select(F.col("id").alias("slot")).join(slots, "slot", "left").select("slot", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "terms"))), lambda s: s["terms"]).alias("slots")), size


def _subset_hash(band: str, at: int, bits: int) -> Column:
    kept = F.filter(F.col(band), lambda t: F.shiftrightunsigned(t, at).bitwiseAND(F.lit((1 << bits) - 1)) == 0)
    return F.when(F.size(kept) > 0, F.substring(F.lpad(F.hex(F.xxhash64(kept)), 16, "0"), 9, 8)).otherwise(EMPTY)


class Fingerprinter:
    """Adds fingerprints to tables by the lexicon of a corpus."""

    def __init__(self, corpus: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE):
        words = staged(lexicon(corpus, least, most), "lexicon")
        table, self.size = _lookup(words)
        self.table = staged(table, "lexicon-slots")

    def add(self, rows: DataFrame, texts: dict[str, str]) -> DataFrame:
        """``rows`` with a fingerprint for each of ``texts`` (result name to text column), which replaces a column of that name.

        A fingerprint is 16 groups of 8 hex digits; a group without terms is zero. A text whose terms all lie outside the
        band is represented by all its terms; a null or empty text, or one without terms, is zero throughout. Equal texts
        have equal fingerprints.
        """
        rows = without(rows, *texts).withColumn("slots__", self.table.select("slots").scalar())
        size = self.size
        # The slots must enter the lambda as a column; the optimiser puts the subquery's value there.
        for name, text in texts.items():
            rows = rows.withColumn(f"all_{name}__", terms(F.col(f"`{text}`")))
        for name in texts:
            inside = F.filter(F.col(f"all_{name}__"), lambda t: F.array_contains(F.element_at(F.col("slots__"), (F.pmod(t, F.lit(size)) + 1).cast("int")), t))
            rows = rows.withColumn(f"in_{name}__", inside)
        rows = rows.drop("slots__")
        for name in texts:
            rows = rows.withColumn(f"band_{name}__", F.when(F.size(f"in_{name}__") > 0, F.col(f"in_{name}__")).otherwise(F.col(f"all_{name}__")))
        for name in texts:
            rows = rows.withColumn(name, F.upper(F.concat(*[_subset_hash(f"band_{name}__", at, bits) for at, bits in SUBSETS])))
        for name in texts:
            rows = rows.withColumn(name, F.lower(name))
        return rows.drop(*[f"{p}_{n}__" for n in texts for p in ("all", "in", "band")])


def likeness(a: str, b: str) -> Column:
    """Share of the subsets, without those that neither text has terms of, whose hashes agree; 1 if neither has any term."""
    parts = [(F.substring(a, 8 * i + 1, 8), F.substring(b, 8 * i + 1, 8)) for i in range(len(SUBSETS))]
    some = sum((F.when((x != EMPTY) | (y != EMPTY), 1).otherwise(0) for x, y in parts), F.lit(0))
    same = sum((F.when((x != EMPTY) & (x == y), 1).otherwise(0) for x, y in parts), F.lit(0))
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some)


def fingerprints(docs: DataFrame, result: str = "fingerprint") -> DataFrame:
    """``docs`` with the I-Match fingerprint of ``text`` in column ``result``, by the lexicon of ``docs`` itself."""
    return Fingerprinter(docs).add(docs, {result: "text"})


def next_ids(ids: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(doc_id, n_chars, next_id)``: the next smaller doc_id, after the smallest the largest. ``ids(doc_id, n_chars)`` are unique and not null.

    Ranges of ids are numbered by themselves; only the largest id of each range is gathered.
    """
    spark = ids.sparkSession
    spread = ids.repartitionByRange(partitions, "doc_id") if partitions else ids.repartitionByRange("doc_id")
    spread = staged(spread.withColumn("range__", F.spark_partition_id()), "ids")
    tops = sorted(((r["range__"], r["top"]) for r in spread.groupBy("range__").agg(F.max("doc_id").alias("top")).collect()))
    if not tops:
        return spread.select("doc_id", "n_chars", F.col("doc_id").alias("next_id"))
    after = [(r, tops[i - 1][1]) for i, (r, _) in enumerate(tops)]
    after = F.broadcast(spark.createDataFrame(after, "range__ int, after__ long"))  # one row for each partition
    follow = F.lead("doc_id").over(Window.partitionBy("range__").orderBy(F.desc("doc_id")))
    return spread.join(after, "range__").select("doc_id", "n_chars", F.coalesce(follow, F.col("after__")).alias("next_id"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the start of the next document.

    Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Edits go by descending
    doc_id. Rows without a doc_id are left out and ids must be unique, for an edit needs a place in that order; plain
    :func:`fingerprints` takes any rows. Null texts count as empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = staged(next_ids(rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"))), "order")
    wanted = order.select(F.col("doc_id").alias("owner"), F.col("next_id"), F.expr("n_chars div 2").alias("half"))
    heads = rows.join(wanted, rows.doc_id == wanted.next_id).select("owner", "next_id", "half", F.expr("substring(text, 1, cast(half as int))").alias("head"))
    both = rows.join(heads, rows.doc_id == heads.owner).select("doc_id", "next_id", "text", "half", "head")
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - half as int))"), "head")).drop("half", "head")
    marked = Fingerprinter(rows).add(both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), {"fingerprint": "text", "edited_fingerprint": "edited"})
    marked = staged(marked.drop("text", "edited"), "fingerprints")
    other = marked.select(F.col("doc_id").alias("other_id"), F.col("fingerprint").alias("other"))
    joined = marked.join(other, F.col("next_id") == F.col("other_id"))
    return joined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "other").alias("near_next"))
