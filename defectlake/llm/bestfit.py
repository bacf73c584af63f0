"""Packing documents into few sequences by exact-complement hashing.

Documents longer than a sequence are cut into full ones and a rest. What is to be packed is then told by the number of
pieces of each length alone, a table bounded by the sequence length. For each length, longest first, the gap it leaves is
looked up among the sums of one, two and three lengths; a combination that fills the gap exactly is consumed as often as
its lengths are available. What fits nothing exactly is packed best-fit in descending order. Pieces are numbered within
their length, and their number says which sequence they belong to, so that no piece moves for the plan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean_memory, of_worker, staged, values_of

WINDOW = 2048
END_ID = 0
MEMO_WORDS = 800_000  # about 200 bytes each
GROUP_BYTES = 1 << 20  # of texts that are encoded together
BATCH_IDS = 1 << 20
BROADCAST_ROWS = 200_000

PIECES = "doc_id long, piece int, start long, length long, doc_tokens long, ids binary, ids_crc32 long, task int, no long"
PLACE = "struct<sequence_id: long, offset: long>"


def word_bpe(vocabulary: str | None = None):
    """Encoder of the 49k word-end BPE vocabulary: lists of UTF-8 texts to ids as little-endian 32-bit numbers.

    The vocabulary folds case and drops white space before it looks at words, so that folded words are encoded once and
    remembered. New words are encoded together, told apart by ids that end a word or by separators that none of them holds.
    Texts that may hold the names of special tokens are encoded as they are. ``vocabulary`` is the tokenizer file, the
    public one by default.
    """
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    ids_of = lambda text: np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
    mark = ids_of("|")
    ends_word = np.zeros(coder.get_vocab_size(), dtype=bool)
    ends_word[[i for token, i in coder.get_vocab().items() if token.endswith("</w>")]] = True
    known: dict[bytes, bytes] = {}

    def cut(words: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            known[word], start = raw[start:end], end + gap

    def learn(new: list[bytes]) -> None:
        letters, stopped, mixed, odd = [], [], [], []
        for word in new:
            # Letters are one word to the vocabulary and a stop after them another; the ids that end words tell them apart.
            text = word.decode()
            core = text[:-1] if text[-1] in ".,;:!?" else text
            plain = core.isalpha() and (core.isascii() or max(core) < "\u0500" and core.lower().isalpha())
            (letters if plain and core is text else stopped if plain else odd if "|" in text else mixed).append(word)
        for kind, each in ((letters, 1), (stopped, 2)):
            for i in range(0, len(kind), 1000):
                part = kind[i : i + 1000]
                ids = ids_of(b" ".join(part).decode())
                cut(part, ids, np.flatnonzero(ends_word[ids])[each - 1 :: each] + 1, 0)
        for i in range(0, len(mixed), 1000):
            part = mixed[i : i + 1000]
            ids = ids_of(b" | ".join(part).decode())
            cut(part, ids, np.append(np.flatnonzero(ids == mark[0]), len(ids)), 4)
        for word in odd:
            known[word] = ids_of(word.decode()).tobytes()

    def encode(texts: list[bytes]) -> Iterator[bytes]:
        plain = [b"<|" not in text for text in texts]
        words = [text.lower().split() if p else [] for p, text in zip(plain, texts)]
        held = set(chain.from_iterable(words))
        if len(known) + len(held) > MEMO_WORDS:
            known.clear()
        learn(list(held.difference(known)))
        for text, p, own in zip(texts, plain, words):
            yield b"".join(map(known.__getitem__, own)) if p else ids_of(text.decode()).tobytes()

    return encode


class Complements:
    """Combinations of at most three available lengths with a given sum. Numbers only fall, so what is gone stays gone."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pairs: dict[int, tuple[int, int] | None] = {}
        self.triples: dict[int, tuple[int, int, int] | None] = {}

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        return min(int(self.counts[n]) // need for n, need in Counter(lengths).items())

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair with this sum that can be taken most often."""
        found = self.pairs.get(total, ())
        if found == () or (found and not self.times(found)):
            low = np.arange(1, total // 2 + 1)
            often = np.minimum(self.counts[low], self.counts[total - low])
            if total % 2 == 0 and len(low):
                often[-1] = self.counts[total // 2] // 2
            best = int(often.argmax()) if len(low) else 0
            self.pairs[total] = found = (total - best - 1, best + 1) if len(low) and often[best] else None
        return found

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three lengths with this sum, by a length and the pair index, plentiful lengths first."""
        found = self.triples.get(total, ())
        if found == () or (found and not self.times(found)):
            found = None
            have = np.flatnonzero(self.counts[: max(total - 1, 0)])
            for n in have[np.argsort(-self.counts[have], kind="stable")].tolist():
                rest = self.pair(total - n)
                if rest and self.times((n, *rest)):
                    found = (n, *rest)
                    break
            self.triples[total] = found
        return found

    def filler(self, gap: int, size: int) -> tuple[int, ...] | None:
        if size == 1:
            return (gap,) if self.counts[gap] else None
        return self.pair(gap) if size == 2 else self.triple(gap)


def _sequences(counts: np.ndarray, window: int, sizes: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if left[window]:
        plan.append((((window, 1),), int(left[window])))
        left[window] = 0
    index = Complements(left)
    for size in range(1, sizes + 1):
        for host in range(window - 1, window // (size + 1) - 1, -1):
            while left[host] and (found := index.filler(window - host, size)) and (times := index.times((host, *found))):
                need = Counter((host, *found))
                for n, k in need.items():
                    left[n] -= times * k
                plan.append((tuple(sorted(need.items(), reverse=True)), times))
    return plan + _best_fit(left, window)


def plan_sequences(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences for ``counts[n]`` pieces of length n, as (((length, repeats), ...), times).

    Gaps are filled by one length, then by two and by three; where pieces are few, triples can use up short ones that
    best-fit needs, so the fewest sequences of the three depths count.
    """
    plans = [_sequences(counts, window, sizes) for sizes in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _best_fit(left: np.ndarray, window: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over like pieces and like sequences at once."""
    gaps = np.zeros(window + 1, dtype=np.int64)
    groups: list[list[tuple[tuple[tuple[int, int], ...], int]]] = [[] for _ in range(window + 1)]

    def put(held, times, gap):
        if times:
            groups[gap].append((held, times))
            gaps[gap] += times

    for n in np.flatnonzero(left)[::-1].tolist():
        count = int(left[n])
        while count:
            fits = int((gaps[n:] > 0).argmax()) + n
            held, times, gap = (), -(-count // (window // n)), window
            if gaps[fits]:
                (held, times), gap = groups[fits].pop(), fits
                gaps[fits] -= times
            each = gap // n
            whole = min(times, count // each)
            rest = min(count - whole * each, each - 1) if whole < times else 0
            put((*held, (n, each)), whole, gap - each * n)
            if rest:
                put((*held, (n, rest)), 1, gap - rest * n)
            if held:
                put(held, times - whole - (rest > 0), gap)
            count -= whole * each + rest
    return [group for at in groups for group in at]


class Places:
    """Sequence and offset of the r-th piece of a length, for all lengths of a plan."""

    def __init__(self, plan: list[tuple[tuple[tuple[int, int], ...], int]]):
        taken: Counter = Counter()
        rows, base = [], 0
        for parts, times in plan:
            at = 0
            for length, repeats in parts:
                rows.append((length, taken[length], base, at, repeats))
                taken[length] += times * repeats
                at += length * repeats
            base += times
        self.sequences = base
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.key, self.table = (table[:, 0] << 48) + table[:, 1], table

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, base, at, repeats = self.table[np.searchsorted(self.key, (length << 48) + rank, side="right") - 1].T
        turn, place = np.divmod(rank - first, repeats)
        return base + turn, at + place * length


def coded_rows(batches, encode) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and coded text of every row; texts of some bytes are coded together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1))):
            ids.append(doc_id)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= GROUP_BYTES or len(ids) >= 1000:
                yield from zip(ids, encode(texts))
                ids, texts, size = [], [], 0
    yield from zip(ids, encode(texts))


def cut_pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their ids, and ``no``, their number among those of their length in a ``task``."""

    def run(batches):
        import zlib

        lean_memory()
        encode = of_worker(f"word_bpe {vocabulary}", lambda: word_bpe(vocabulary))
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        names = [f.split()[0] for f in PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
        end, rows, held = np.array(END_ID, dtype="<u4").tobytes(), [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for doc_id, coded in coded_rows(batches, encode):
            ids = coded + end
            total = len(ids) // 4
            for piece, start in enumerate(range(0, total, window)):
                part = ids[4 * start : 4 * (start + window)]
                length = len(part) // 4
                rows.append((doc_id, piece, start, length, total, part, zlib.crc32(part), task, int(seen[length])))
                seen[length] += 1
                held += length
                if held >= BATCH_IDS or len(rows) >= 4000:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack_best_fit(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, doc_tokens, ids, ids_crc32, sequence_id, offset)`` of every piece of every document.

    Only documents longer than ``window`` ids are cut, into full pieces and a rest. Sequences are numbered from 0 without
    gaps, pieces lie in them without gaps, and a sequence may end early. A null or empty text is the end id alone; null and
    repeated doc_ids are documents of their own; other columns are not read. No rows give no rows. The driver gathers one
    number for each length, ``window`` at most. Which of several pieces of a length comes first follows the partitions.
    """
    pieces = staged(cut_pieces(docs, window, vocabulary), "pieces")
    sizes = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "sizes")
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    known = docs.sparkSession.sparkContext.broadcast(Places(plan_sequences(counts, window)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("task").alias("task__"), F.col("length").alias("length__"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base__"))
    if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)

    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        lean_memory()
        places = known.value
        for length, rank in parts:
            found = places(length.to_numpy(), rank.to_numpy())
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found], ["sequence_id", "offset"])

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    ranked = pieces.join(bases, (F.col("task") == F.col("task__")) & (F.col("length") == F.col("length__")))
    placed = ranked.withColumn("place__", F.arrow_udf(run, PLACE)("length", F.col("no") + F.col("base__")))
    return placed.select("doc_id", "piece", "start", "length", "doc_tokens", "ids", "ids_crc32", "place__.sequence_id", "place__.offset")
