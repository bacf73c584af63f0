"""Toxic passages by maximum-scoring segments.

Tokens get log-odds of toxic against clean labelled documents under an informative Dirichlet prior, whose shape is the
corpus. Words that say nothing cost a small constant, so that a linear scan finds every maximal-scoring run of words. Under the clean
distribution such scores follow an extreme-value law; its two parameters turn scores into expected numbers of equal or
better passages by chance. The significant passages of a text together give its probability by a logistic curve.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, staged, values_of, word_chunks

MAX_TRAINING = 20_000
FOLDS = 5
GAP = 0.1
PREFIXES = (6, 5, 4)  # characters; an unknown word counts as the longest known beginning
SCREEN_Z = 3.0
MIN_Z = 4.0
MIN_DOCS = 3
SIGNIFICANT = 0.05
CACHE_WORDS = 200_000
COUNTED = 100_000

# A-Z become a-z; other ASCII characters than letters and digits separate words.
_FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))

PASSAGE = "struct<first_word: long, words: long, score: double, expected: double>"
RESULT = f"struct<score: double, predicted: int, passages: array<{PASSAGE}>>"
_PASSAGE = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
_RESULT = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("passages", pa.list_(_PASSAGE))])


def tokens(text: bytes | None):
    """Lists of tokens of a text; lists are of bounded length."""
    return word_chunks((text or b"").translate(_FOLD))


def features(word: bytes) -> list[tuple[int, bytes]]:
    """The word and its beginnings, as (kind, value); kind 0 is the word."""
    out = [(0, word)]
    letters = word.decode("utf-8", "ignore")
    return out + [(n, letters[:n].encode()) for n in PREFIXES if len(letters) > n]


@dataclass
class Model:
    weights: dict[tuple[int, bytes], float] = field(default_factory=dict)
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # its K
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def word_score(self, word: bytes) -> float:
        for key in features(word):
            if (weight := self.weights.get(key)) is not None:
                return weight
        return -GAP


class Scorer:
    """Scores texts by a model; keeps the scores of words that it has met, in bounded memory."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _scores(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        for word in new:
            known[word] = self.model.word_score(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))

    def segments(self, text: bytes | None) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal-scoring segments (first word, end, score) and the number of words.

        The scan needs the positive words alone, with the cumulative score before and after each. It keeps candidate
        segments in order; a new one joins back to the nearest earlier segment that starts lower, if that ended lower too.
        """
        hits, before, after, at, total = [], [], [], 0, 0.0
        for words in tokens(text):
            if not words:
                continue
            scores = self._scores(words)
            where = np.flatnonzero(scores > 0)
            if len(where):
                sums = total + np.cumsum(scores)
                hits += (where + at).tolist()
                after += sums[where].tolist()
                before += (sums[where] - scores[where]).tolist()
            total += float(scores.sum())
            at += len(words)
        stack: list[list] = []  # [first, end, low, high, previous candidate that starts lower]
        for hit, low, high in zip(hits, before, after):
            new = [hit, hit + 1, low, high, -1]
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= new[2]:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= new[3]:
                    new[4] = j
                    stack.append(new)
                    break
                new = [stack[j][0], new[1], stack[j][2], new[3], -1]
                del stack[j:]
        return [(a, b, high - low) for a, b, low, high, _ in stack], at

    def evidence(self, text: bytes | None) -> tuple[float, float, list[dict]]:
        """Logarithmic evidence of all and of the best significant passage, and the passages."""
        found, words = self.segments(text)
        out, total, best = [], 0.0, 0.0
        for first, end, score in found:
            expected = self.model.scale * max(words, 1) * math.exp(-min(self.model.decay * score, 700.0))
            if expected <= SIGNIFICANT:
                out.append({"first_word": first, "words": end - first, "score": score, "expected": expected})
                total, best = total - math.log(max(expected, 1e-300)), max(best, -math.log(max(expected, 1e-300)))
        return math.log1p(total), math.log1p(best), out

    def score(self, text: bytes | None) -> dict:
        total, best, passages = self.evidence(text)
        a, b, c = self.model.curve
        value = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * total + c * best))))
        return {"score": value, "predicted": int(value >= 0.5), "passages": passages}


def _presence(rows: DataFrame, features_: set | None) -> DataFrame:
    """``(kind, value, toxic, docs)``: documents of ``rows(text, toxic)`` that hold each feature; kind -1 - k sums those of kind k.

    With ``features_``, only those are told apart.
    """
    shared = rows.sparkSession.sparkContext.broadcast(features_)

    def run(batches):
        lean_memory()
        wanted = shared.value
        counts: Counter = Counter()

        def rows_of():
            kinds, values, toxic = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.binary()), pa.array(toxic, pa.int32()), pa.array(counts.values(), pa.int64())], ["kind", "value", "toxic", "docs"])
            counts.clear()

        known: dict[bytes, list] = {}
        for batch in batches:
            for text, toxic in zip(values_of(batch.column(0)), batch.column(1).to_pylist()):
                held = set()
                for words in tokens(text):
                    held.update(words)
                if wanted is None:
                    found = {key for word in held for key in features(word)}
                else:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    for word in held.difference(known):
                        known[word] = [key for key in features(word) if key in wanted]
                    found = {key for word in held for key in known[word]}
                counts.update((k, v, toxic) for k, v in found)
                counts.update({(-1, b"", toxic): len(held)})
                if len(counts) > COUNTED:
                    yield from rows_of()
        if counts:
            yield from rows_of()

    parts = rows.select(F.col("text").cast("string").alias("text"), "toxic").mapInArrow(run, "kind int, value binary, toxic int, docs long")
    return parts.groupBy("kind", "value", "toxic").agg(F.sum("docs").alias("docs"))


def _log_odds(toxic: np.ndarray, clean: np.ndarray, share: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio and its z value, under a Dirichlet prior of the corpus shares that weighs as much as the toxic side."""
    prior = np.maximum(n_toxic * share, 1e-3)
    one, zero = toxic + prior, clean + prior
    delta = np.log(one / np.maximum(2 * n_toxic - one, 1)) - np.log(zero / np.maximum(n_clean + n_toxic - zero, 1))
    return delta, delta / np.sqrt(1 / one + 1 / zero)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge-regularised logistic regression by Newton steps; slopes are kept from falling below zero."""
    design, w = np.column_stack([np.ones(len(y)), x]), np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
    return float(w[0]), float(w[1]), float(w[2])


def train(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Model:
    """Fit a model to labelled documents outside the held-out fold.

    ``labels(doc_id, toxic)`` with crc32(doc_id as text) mod 5 = 0 are never read. Of the others, a seeded hash picks about
    ``max_training`` for the fit; the shares of the prior come from all documents. A doc_id with several labels counts as
    toxic if one says so, null labels are skipped. Without both kinds of labels every text gets the base rate.
    """
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(crc % FOLDS != 0)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("id__")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    count = usable.count()
    keep = min(1.0, max_training / max(count, 1))
    sample = usable.filter(F.pmod(F.xxhash64("id__"), F.lit(1_000_000)) < int(keep * 1_000_000) + (keep == 1.0))
    rows = staged(docs.join(F.broadcast(sample), F.col("doc_id").cast("long") == F.col("id__")).select(F.col("text").cast("string").alias("text"), "toxic"), "training")
    sides = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model, one, zero = Model(), sides.get(1, 0), sides.get(0, 0)
    model.curve = (math.log((one + 0.5) / (zero + 0.5)) if one + zero else -4.0, 0.0, 0.0)
    if not one or not zero:
        return model
    counted = staged(_presence(rows, None), "presence")
    totals = {r["toxic"]: r["docs"] for r in counted.filter("kind = -1").collect()}
    pivot = counted.filter("kind >= 0").groupBy("kind", "value").agg(F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("y0"))
    n1, n0 = float(totals.get(1, 1)), float(totals.get(0, 1))
    share = (F.col("y1") + F.col("y0")) / F.lit(n1 + n0)
    a, b = F.col("y1") + share * n1, F.col("y0") + share * n1
    z = (F.log(a / (2 * n1 - a)) - F.log(b / (n0 + n1 - b))) / F.sqrt(1 / a + 1 / b)
    # A screened feature needs several documents of the bounded sample, which bounds their number.
    found = pivot.filter(F.col("y1") + F.col("y0") >= MIN_DOCS).filter(F.abs(z) >= SCREEN_Z).collect()
    if not found:
        return model
    keys = [(r["kind"], bytes(r["value"])) for r in found]
    corpus = {(r["kind"], bytes(r["value"])): r["docs"] for r in _presence(docs.select("text", F.lit(0).alias("toxic")), set(keys)).collect()}
    everything = float(max(corpus.get((-1, b""), 1), 1))
    y1, y0 = np.array([r["y1"] for r in found], dtype=float), np.array([r["y0"] for r in found], dtype=float)
    shares = np.array([corpus.get(k, 0) for k in keys]) / everything
    delta, z = _log_odds(y1, y0, shares, n1, n0)
    sure = np.flatnonzero(np.abs(z) >= MIN_Z)
    model.weights = {keys[i]: float(delta[i]) - (GAP if delta[i] > 0 else 0.0) for i in sure}
    rate = (y0 + n1 * shares) / (n0 + n1)  # of a feature in clean text
    own = [i for i in sure if keys[i][0] == 0]
    model.decay = _decay(np.array([model.weights[keys[i]] for i in own]), rate[own])
    return _calibrated(model, rows)


def _decay(scores: np.ndarray, rates: np.ndarray) -> float:
    """Positive root of the clean moment equation sum p exp(lambda s) = 1, neutral words included."""
    neutral = max(1e-9, 1.0 - rates.sum())
    low, high = 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if neutral * math.exp(-mid * GAP) + float((rates * np.exp(np.minimum(mid * scores, 600))).sum()) < 1 else (low, mid)
    return max(low, 1e-2)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """Fit K to the best scores of clean training texts, then the curve to all of them; both see one row for each text of the bounded sample."""

    def best(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.segments(t) for t in values_of(batch.column(0))]
            chance = [max(n, 1) * math.exp(-min(model.decay * max((s for _, _, s in f), default=0.0), 700.0)) for f, n in found]
            yield pa.RecordBatch.from_arrays([pa.array(chance, pa.float64())], ["chance"])

    # Under the law, K times the words times exp(-lambda best) is exponential with mean one.
    clean = rows.filter("toxic = 0").select("text").mapInArrow(best, "chance double").agg(F.avg("chance")).first()[0]
    model.scale = 1.0 / max(clean or 1.0, 1e-9)

    def points(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.evidence(t)[:2] for t in values_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column(1)], ["total", "best", "toxic"])

    table = rows.select("text", "toxic").mapInArrow(points, "total double, best double, toxic int").collect()  # the bounded sample
    data = np.array(sorted((r["total"], r["best"], float(r["toxic"])) for r in table))
    model.curve = _logistic(data[:, :2], data[:, 2])
    return model


def scored(docs: DataFrame, model: Model, result: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``result`` = struct(score, predicted, passages), which replaces one of that name.

    The score reads the text alone, whole. Passages are ranges of tokens with the number expected by chance. Null and empty
    texts score as texts without passages; equal texts score alike.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        lean_memory()
        scorer = Scorer(known.value)
        for batch in texts:
            yield pa.array([scorer.score(t) for t in values_of(batch)], _RESULT)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(result, F.arrow_udf(run, RESULT)(F.col("text").cast("string")))
