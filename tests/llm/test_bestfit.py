"""Best-fit packing: ids, laws of the sequences and their number."""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from defectlake.llm import bestfit, queries

from .tables import frame, odd_rows, prose, with_clashes


def public_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: coder.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_public_tokenizer():
    odd = ["<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a b c \u0085 d\x0be\x0cf\x1cg", "don't WE'LL 's ' s", "  \n\n\t x  ", "½ ² Ⅷ 一二三", "z" * 5000, "e ́x ́", "Á ΑΣ Σ", " a　b\xa0c", "İ ß ﬁ ﻿ ​",
           "a, b. c., d|e | f|, 3.14. x'. y, ", "", "É, é. A. 12, 5. '., ", "é. x́, ", "|", "k K K", None, prose(1, 3000)]
    reference, encode = public_ids(), bestfit.word_bpe()
    for _ in range(2):
        got = list(encode([(t or "").encode() for t in odd]))
        assert [np.frombuffer(g, dtype="<u4").tolist() + [0] for g in got] == [reference(t) for t in odd]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bestfit, "MEMO_WORDS", 20)
    reference, encode = public_ids(), bestfit.word_bpe()
    for i in range(30):
        texts = [prose(i, 15), prose(i + 1, 5), ""]
        assert [np.frombuffer(g, dtype="<u4").tolist() + [0] for g in encode([t.encode() for t in texts])] == [reference(t) for t in texts]


def best_fit_decreasing(lengths, window):
    gaps = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(i) if i < len(gaps) else window) - n)
    return len(gaps)


def test_plans_hold_every_piece_and_few_sequences():
    rng = random.Random(3)
    total, plain = 0, 0
    for _ in range(200):
        window, size, kind = rng.choice([16, 64, 256, 2048]), rng.randint(0, 400), rng.random()
        lengths = [rng.randint(1, window) if kind < 0.4 else min(window, 1 + int(rng.expovariate(5 / window))) if kind < 0.8 else rng.choice([1, window // 3, window // 2, window // 5 + 1]) for _ in range(size)]
        counts = np.bincount(lengths, minlength=window + 1) if lengths else np.zeros(window + 1, dtype=int)
        plan = bestfit.plan_sequences(counts, window)
        used = np.zeros_like(counts)
        for parts, times in plan:
            assert times > 0 and sum(n * k for n, k in parts) <= window
            for n, k in parts:
                used[n] += times * k
        assert (used == counts).all()
        places, held = bestfit.Places(plan), defaultdict(list)
        for n in np.flatnonzero(counts).tolist():
            for sequence, offset in zip(*map(np.ndarray.tolist, places(np.full(counts[n], n), np.arange(counts[n])))):
                held[sequence].append((offset, n))
        assert sorted(held) == list(range(places.sequences))
        for parts in held.values():
            assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
        slow = best_fit_decreasing(lengths, window)
        assert len(held) <= slow + 1 + slow // 50
        total, plain = total + len(held), plain + slow
    assert total <= plain


def test_exact_complements_are_consumed():
    counts = np.zeros(2049, dtype=np.int64)
    for n, k in {2000: 10**9, 48: 10**9, 1000: 7, 500: 7, 548: 7, 700: 3, 600: 3, 400: 3, 348: 3}.items():
        counts[n] = k
    plan = bestfit.plan_sequences(counts)
    assert sum(times for _, times in plan) == 10**9 + 7 + 3 and all(sum(n * k for n, k in parts) == 2048 for parts, _ in plan)


def test_query_round_trip(spark, tmp_path):
    rows = odd_rows() + [(1000 + i, prose(i, 1 + i * 137 % 900), "en", "s", 0) for i in range(120)] + [(2000 + i, "", "en", "s", 0) for i in range(40)]
    with_clashes(frame(spark, rows)).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = queries.QUERIES["op12_best_fit"](spark, str(tmp_path)).collect()
    ids = public_ids()
    want, lengths = Counter(), []
    for doc_id, text, *_ in rows:
        coded = np.array(ids(text), dtype="<u4")
        for piece, start in enumerate(range(0, len(coded), 2048)):
            part = coded[start : start + 2048]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), len(coded)] += 1
            lengths.append(len(part))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == want
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert len(held) <= best_fit_decreasing(lengths, 2048) + 1


def test_ids_are_kept_and_empty_tables(spark):
    rows = [(i, prose(i, 50 + i), "en", "s", 0) for i in range(20)]
    pieces = bestfit.pack_best_fit(frame(spark, rows), window=64).collect()
    ids = public_ids()
    for doc_id, text, *_ in rows:
        own = sorted((r["start"], bytes(r["ids"])) for r in pieces if r["doc_id"] == doc_id)
        assert b"".join(part for _, part in own) == np.array(ids(text), dtype="<u4").tobytes()
    assert bestfit.pack_best_fit(frame(spark, [])).count() == 0
