"""Periodic runs of words by online dyadic square catching.

Completed blocks of 2^k words at multiples of 2^k are catchers. Each appended word completes one window of 2^k words per
level, and that window can only be the echo of one live catcher: the block that began between 2^k and 2^(k+1) words before
it. An echo at distance q is a square in the making; where the next words go on repeating with period q the stretch is
widened word by word to its maximal run, which stays open while appended words extend it. A run of four periods holds an
aligned block within its first period, and the two periods after it, so that no run is missed. Windows are named by hashes
that double from level to level; the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, values_of, word_chunks

LEAST_WORDS, LEAST_POWER = 6, 4
PENDING_WORDS = 1 << 14  # appended words that wait until catchers look at them together
JOIN_WORDS = 1 << 16

SPAN = "struct<start: long, length: long, period: long>"
RESULT = f"struct<words: long, runs: array<{SPAN}>, text: string>"
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.struct([("words", pa.int64()), ("runs", pa.list_(_SPAN)), ("text", pa.string())])

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _A
    return (x ^ (x >> _HALF)) * _B


def _ahead(same: np.ndarray) -> int:
    """How many leading values are true."""
    stop = int(same.argmin()) if len(same) else 0
    return len(same) if len(same) and same[stop] else stop


class SquareCatcher:
    """Finds the maximal runs of a growing sequence of word numbers: ``append`` words, then ``close``."""

    def __init__(self):
        self.words, self.n, self.seen = np.empty(256, dtype=np.int64), 0, 0
        self.names: list[np.ndarray] = []  # by level: of the windows that start at first[k] and later
        self.first: list[int] = []
        self.due: list[int] = []  # by level: the next block whose echoes are to be caught
        self.open: dict[int, int] = {}  # period to start of the stretch that reaches the last word
        self.past: dict[int, int] = {}  # period to end of its last stretch
        self.runs: list[tuple[int, int, int]] = []  # (start, end, period)

    def append(self, ids: np.ndarray) -> None:
        end = self.n + len(ids)
        if end > len(self.words):
            self.words = np.concatenate([self.words[: self.n], np.empty(max(end, 2 * self.n) - self.n, dtype=np.int64)])
        self.words[self.n : end] = ids
        self.n = end
        if self.n - self.seen >= PENDING_WORDS:
            self._catch(last=False)

    def close(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period), by start and then period."""
        self._catch(last=True)
        for period, start in self.open.items():
            self._report(start, self.n, period)
        self.open = {}
        return sorted((s, e - s, q) for s, e, q in self.runs)

    def _report(self, start: int, end: int, period: int) -> None:
        self.past[period] = end
        if end - start >= max(LEAST_WORDS, LEAST_POWER * period):
            self.runs.append((start, end, period))

    def _catch(self, last: bool) -> None:
        w = self.words
        for q, start in list(self.open.items()):
            more = _ahead(w[self.seen : self.n] == w[self.seen - q : self.n - q])
            if self.seen + more < self.n:
                del self.open[q]
                self._report(start, self.seen + more, q)
        self._name()
        self.seen = self.n
        for k in range(len(self.names) - 1):
            block = 1 << k
            # All echoes of a block are judged once the third period of the longest has come; at the end, of those that fit.
            past = (self.n - (3 if last else 6) * block) // block + 1
            begin = self.due[k] // block
            if past > begin:
                self._judge(k, begin, past)
                self.due[k] = past * block
        if not last:
            for k, at in enumerate(self.due[: len(self.names)]):
                self.names[k], self.first[k] = self.names[k][at - self.first[k] :], at

    def _name(self) -> None:
        """Names of the windows that the words since the last look complete, level by level."""
        k = 0
        while (1 << k) <= self.n:
            if k == len(self.names):
                self.names.append(np.empty(0, dtype=np.uint64))
                self.first.append(0)
                self.due.append(0)
            at, until = self.first[k] + len(self.names[k]), self.n - (1 << k) + 1
            if k == 0:
                new = _mixed(self.words[at:until].astype(np.uint64) + _B)
            else:
                half, low = 1 << (k - 1), at - self.first[k - 1]
                below = self.names[k - 1]
                new = _mixed(below[low : low + until - at] + (below[low + half : low + half + until - at] << np.uint64(1)))
            self.names[k] = np.concatenate([self.names[k], new]) if len(self.names[k]) else new
            k += 1

    def _judge(self, k: int, begin: int, past: int) -> None:
        """Echoes of the blocks ``begin`` to ``past`` of level k: each is compared with the windows 2^k to 2^(k+1) - 1 words later."""
        block, names, upper = 1 << k, self.names[k], self.names[k + 1]
        base, over = begin * block - self.first[k], self.first[k + 1]
        count = past - begin
        blocks = names[base : base + count * block : block]
        windows = names[base + block : base + (count + 1) * block]
        if len(windows) < count * block:
            windows = np.concatenate([windows, np.zeros(count * block - len(windows), dtype=np.uint64)])
        hit = np.flatnonzero(windows.reshape(count, block) == blocks[:, None])
        if not len(hit):
            return
        a = begin * block + (hit >> k << k)
        q = block + (hit & (block - 1))
        fits = a + 3 * q <= self.n
        a, q = a[fits], q[fits]
        # Two periods from the block on must repeat: two windows of the next level cover them.
        far = a + 2 * q - 2 * block
        cube = (upper[a - over] == upper[a + q - over]) & (upper[far - over] == upper[far + q - over])
        a, q = a[cube], q[cube]
        if not len(a):
            return
        # Multiples of the period of a known run are not smallest periods.
        known = np.array([*self.runs, *((s, self.n, p) for p, s in self.open.items())], dtype=np.int64).reshape(-1, 3)
        for start, end, p in known[(known[:, 2] < block) & (known[:, 1] - known[:, 0] >= 3 * block) & (known[:, 1] > a[0])].tolist():
            low, high = np.searchsorted(a, (start, end))
            if low < high:
                keep = np.ones(len(a), dtype=bool)
                keep[low:high] = (a[low:high] + 3 * q[low:high] > end) | (q[low:high] % p != 0)
                a, q = a[keep], q[keep]
        for period in np.unique(q).tolist():
            self._widen(period, a[q == period])

    def _widen(self, q: int, starts: np.ndarray) -> None:
        """The maximal stretches of period q around ``starts``, in ascending order."""
        w, n, i = self.words, self.n, 0
        starts = starts[(starts + 3 * q > self.past.get(q, 0)) & (starts < self.open.get(q, n))]
        while i < len(starts):
            a, low, high, step = int(starts[i]), int(starts[i]), int(starts[i]), 2 * q
            while high + q < n:
                part = min(step, n - q - high)
                more = _ahead(w[high : high + part] == w[high + q : high + q + part])
                high, step = high + more, 2 * step
                if more < part:
                    break
            step = 2 * q
            while low > 0:
                part = min(step, low)
                more = _ahead((w[low - part : low] == w[low + q - part : low + q])[::-1])
                low, step = low - more, 2 * step
                if more < part:
                    break
            end = high + q
            if end == n:
                self.open[q] = low
            else:
                self._report(low, end, q)
            i = int(np.searchsorted(starts, max(end - 3 * q, a), side="right"))


def runs_of(text: bytes | None) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Number of words, runs (start, length, period) and the words left once each run keeps its first period, joined by a space."""
    catcher, known, pieces = SquareCatcher(), {}, []
    for words in word_chunks(text or b""):
        ids = np.fromiter((known.setdefault(word, len(known)) for word in words), dtype=np.int64, count=len(words))
        catcher.append(ids)
    runs = catcher.close()
    n = catcher.n
    kept = catcher.words[:n]
    if runs:
        keep = np.ones(n, dtype=bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        kept = kept[keep]
    vocabulary = list(known)
    for i in range(0, len(kept), JOIN_WORDS):
        pieces.append(b" ".join([vocabulary[j] for j in kept[i : i + JOIN_WORDS].tolist()]))
    return n, runs, b" ".join(pieces)


def collapse_runs(docs: DataFrame, result: str = "periodic") -> DataFrame:
    """``docs`` with a column ``result`` = struct(words, runs, text), which replaces one of that name.

    A run is a maximal stretch of words whose smallest period q repeats at least four times, six words at least; runs are
    (start, length, period) by start and then period. ``text`` holds the words, joined by one space, that no run contains
    after its first q words. Words are maximal runs of other characters than space and the control characters 9-13. Null,
    empty and blank texts have no words, no runs and an empty text. Rows are taken alone, whole and in any number of
    copies; other columns and ids are not read.
    """

    def run(texts):
        lean_memory()
        for batch in texts:
            rows = []
            for text in values_of(batch):
                n, runs, left = runs_of(text)
                rows.append({"words": n, "runs": [{"start": s, "length": m, "period": q} for s, m, q in runs], "text": left.decode()})
            yield pa.array(rows, _RESULT)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(result, F.arrow_udf(run, RESULT)(F.col("text").cast("string")))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first. Null without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(SPAN), lambda best, r: F.when(better(best, r), r).otherwise(best))


def looped(text: bytes, g: int) -> bytes:
    """``text`` whose words from number a = g % n on repeat with period 1 + (n - a) // (3 + g % 8)."""
    raw = np.frombuffer(text, dtype=np.uint8)
    gap = np.zeros(len(raw) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    n = len(starts)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    first = int(starts[a])
    parts = [text[first : ends[a + p - 1]]] * whole + [text[first : ends[a + rest - 1]]] * (rest > 0)
    return text[:first] + b" ".join(parts)


def with_loops(docs: DataFrame) -> DataFrame:
    """``docs`` in which one of ten texts repeats itself, as :func:`looped` says, chosen by the checksum h of the decimal
    doc_id: those with h % 10 = 0, with g = h // 10. Rows without a doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def run(parts):
        for texts, numbers in parts:
            yield pa.array([None if t is None else looped(t, g).decode() for t, g in zip(values_of(texts), numbers.to_pylist())], pa.string())

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    text = F.col("text").cast("string")
    changed = F.arrow_udf(run, "string")(F.when(chosen, text), F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10"), F.lit(0).cast("long")))
    return docs.withColumn("text", F.when(chosen, changed).otherwise(text))
