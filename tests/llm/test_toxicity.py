"""Toxic passages: the scan against brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import math
import random
import zlib

import pytest

from defectlake.llm import toxicity

from .tables import SCHEMA, frame, odd_rows, prose, with_clashes

BAD = ("grumblefish", "snarkwit", "bogtrotter")


def slow_segments(scores: list[float]) -> list[tuple[int, int]]:
    """Maximal scoring segments by their definition: the best one, then those left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    a, b = best[3], best[4]
    return slow_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in slow_segments(scores[b:])]


def test_segments_equal_brute_force():
    rng = random.Random(2)
    values = {b"p%d" % i: 0.37 + 1.1 * i for i in range(4)} | {b"n%d" % i: -0.4137 - 0.5311 * i for i in range(4)}
    model = toxicity.Model(weights={(0, w): v for w, v in values.items()})
    for _ in range(120):
        words = [rng.choice(list(values)) for _ in range(rng.randint(0, 16))]
        found, count = toxicity.Scorer(model).segments(b" ".join(words))
        assert count == len(words)
        assert [(a, b) for a, b, _ in found] == slow_segments([values[w] for w in words])
        assert all(abs(s - sum(values[w] for w in words[a:b])) < 1e-9 for a, b, s in found)


def test_unknown_words_count_by_their_beginning():
    model = toxicity.Model(weights={(0, b"idiot"): 3.0, (4, "ébah".encode()): 2.0})
    assert model.word_score(b"idiot") == 3.0 and model.word_score("ébahissant".encode()) == 2.0 and model.word_score(b"idiots") == -toxicity.GAP


def corpus(count: int = 500) -> tuple[list[tuple], list[tuple]]:
    rng, docs, labels = random.Random(8), [], []
    for i in range(count):
        words = prose(i, rng.randint(20, 200)).split()
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame(spark, docs), table)
    assert {(0, w.encode()) for w in BAD} <= set(model.weights) and model.decay > 0 and model.scale > 0
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(with_clashes(frame(spark, docs + [(900 + i, *r[1:]) for i, r in enumerate(odd_rows())])), model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == dict(labels)[i] for i in held) >= 0.95 * len(held)
    for s in got.values():
        assert 0 <= s["score"] <= 1 and s["predicted"] == int(s["score"] >= 0.5)
    assert got[900]["score"] == got[901]["score"] and not got[900]["passages"]
    # Passages cover the words that were put in.
    found = [i for i in held if dict(labels)[i] and got[i]["passages"]]
    words = docs[found[0]][1].split()
    inside = {w for p in got[found[0]]["passages"] for w in words[p["first_word"] : p["first_word"] + p["words"]]}
    assert inside & set(BAD)


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(200)
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    assert toxicity.train(frame(spark, docs), table(labels)) == toxicity.train(frame(spark, docs), table(turned))


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(None, 1), (1, None)]])
def test_few_labels_give_the_base_rate(spark, labels):
    model = toxicity.train(frame(spark, odd_rows()), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r["toxicity"]["score"] for r in toxicity.scored(frame(spark, odd_rows()), model).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(empty, model).count() == 0


def test_decay_solves_the_moment_equation():
    import numpy as np

    scores, rates = np.array([3.0, 4.0]), np.array([1e-3, 5e-4])
    decay = toxicity._decay(scores, rates)
    assert abs((1 - rates.sum()) * math.exp(-decay * toxicity.GAP) + (rates * np.exp(decay * scores)).sum() - 1) < 1e-6
