"""Periodic runs against all periods and all stretches, and the query against a plain version of its contract."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from defectlake.llm import periodic, queries

from .tables import frame, odd_rows, with_clashes, words


def slow_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        x = 0
        while x < len(w) - q:
            y = x
            while y < len(w) - q and w[y] == w[y + q]:
                y += 1
            start, end = x, y + q
            if y > x and end - start >= max(6, 4 * q) and not any(all(w[i] == w[i + p] for i in range(start, end - p)) for p in range(1, q)):
                out.append((start, end - start, q))
            x = y + 1
    return sorted(out)


def random_words(rng, longest=140):
    w, letters = [], rng.choice([1, 2, 3, 6])
    while len(w) < longest:
        block = [rng.randrange(letters) for _ in range(rng.randint(1, 15))]
        w += (block * rng.randint(1, 7))[: rng.randint(1, 90)]
    return w[: rng.randint(0, longest)]


def test_catcher_equals_all_stretches(monkeypatch):
    rng, found = random.Random(5), 0
    for _ in range(1500):
        monkeypatch.setattr(periodic, "PENDING_WORDS", rng.choice([1, 3, 8, 50, 1 << 14]))
        w, catcher, at = random_words(rng), periodic.SquareCatcher(), 0
        while at < len(w):
            step = rng.randint(1, 40)
            catcher.append(np.array(w[at : at + step]))
            at += step
        got = catcher.close()
        assert got == slow_runs(w), w
        found += len(got)
    assert found > 500


def test_long_texts_in_parts():
    rng = random.Random(3)
    noise = lambda n: [rng.randrange(1 << 40) for _ in range(n)]
    big = noise(7001)
    w = noise(500) + big * 5 + noise(900) + [1] * 30_000 + noise(10) + ([1] * 200 + [2]) * 100 + noise(3) + big[:3]
    catcher = periodic.SquareCatcher()
    for i in range(0, len(w), 977):
        catcher.append(np.array(w[i : i + 977]))
    base = 500 + 5 * 7001 + 900
    assert set(catcher.close()) == {(500, 5 * 7001, 7001), (base, 30_000, 1), (base + 30_010, 20_100, 201)} | {(base + 30_010 + 201 * i, 200, 1) for i in range(100)}


def slow_loop(w, g):
    n = len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def slow_row(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        w = slow_loop(w, h // 10)
    runs = slow_runs(w) if len(w) < 400 else [(s, m, q) for s, m, q in periodic.runs_of(b" ".join(w))[1]]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(9)
    rows = odd_rows() + [(100 + i, " \n".join(f"w{x}é" for x in random_words(rng)), "en", "s", 0) for i in range(300)]
    with_clashes(frame(spark, rows)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((slow_row(r[0], r[1]) for r in rows), key=key)
    assert sum(r["n_runs"] for r in got) > 50


def test_loops_only_change_words():
    rng = random.Random(4)
    for _ in range(300):
        text = rng.choice([" ", "", "\t"]) + rng.choice([" ", "\n ", "  "]).join(f"é{rng.randrange(9)}" for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n"])
        g = rng.randrange(1 << 28)
        assert periodic.looped(text.encode(), g).split() == (slow_loop(words(text), g) if words(text) else [])


def test_collapse_keeps_other_columns(spark):
    rows = with_clashes(frame(spark, odd_rows()))
    out = periodic.collapse_runs(rows)
    assert out.drop("periodic").columns == rows.columns and out.count() == len(odd_rows())
    assert periodic.collapse_runs(frame(spark, [])).count() == 0
