"""SimHash and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from defectlake.llm import components, exact_dedup, simhash

from .tables import SCHEMA, frame, odd_rows, prose, with_clashes


def slow_fingerprint(text: str | None, k: int = 3) -> int:
    """The contract, word for word."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in folded + " ":
        if c == " " or 9 <= ord(c) <= 13:
            words, word = words + [word] if word else words, ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keys: list, linked) -> list[int]:
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(keys))]


def near_rows() -> list[tuple]:
    rng, rows = random.Random(9), odd_rows()
    for n in range(12):
        base = prose(100 + n, 300).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 + len(rows), " ".join(copy), "en", "s0", 1))
    return rows


def test_fingerprint_follows_the_contract():
    for text in [r[1] for r in odd_rows() if r[1] is None or len(r[1]) < 5000]:
        assert simhash.fingerprint((text or "").encode()) & (2**64 - 1) == slow_fingerprint(text)


def test_long_text_in_chunks_equals_one_pass(monkeypatch):
    from defectlake.llm import common

    text = prose(6, 400).encode()
    whole, wide = simhash.fingerprint(text), simhash._bits(text)
    monkeypatch.setattr(common.word_chunks, "__defaults__", (64,))
    assert simhash.fingerprint(text) == whole and simhash._bits(text) == wide


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(with_clashes(frame(spark, rows))).collect())
    prints = [slow_fingerprint(t) for _, t, *_ in rows if t is None or len(t) < 5000 or True]
    roots = slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    lowest = defaultdict(lambda: None)
    for r, root in zip(rows, roots):
        if r[0] is not None:
            lowest[root] = r[0] if lowest[root] is None else min(lowest[root], r[0])
    want = sorted((r[0] is None, r[0] or 0, f"{p:016x}", lowest[root]) for r, p, root in zip(rows, prints, roots))
    assert got == want


def test_links_find_every_pair_within_two_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for flips in (1, 1, 2, 2, 3):
            prints.add(b ^ sum(1 << i for i in rng.sample(range(64), flips)))
    prints |= {base[0] ^ (1 << 5) ^ (1 << 40), base[0] ^ (1 << 33) ^ (1 << 63), base[0] ^ 3, 0, 1, 3, 2**64 - 1}
    signed = sorted(p - 2**64 if p >> 63 else p for p in prints)
    got = {(r["u"], r["v"]) for r in simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001)] + [(2000, n) for n in range(2001, 2100)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1002] == 1000 and got[2099] == 2000


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    rows = near_rows()
    kept = simhash.drop_near_duplicates(with_clashes(frame(spark, rows)))
    assert kept.columns == with_clashes(frame(spark, [])).columns
    kept = kept.collect()
    sets = [simhash.shingle_set(t) for _, t, *_ in rows]
    prints = [slow_fingerprint(t) for _, t, *_ in rows]

    def linked(i, j):
        a, b = sets[i], sets[j]
        return (prints[i] ^ prints[j]).bit_count() <= 2 or (bool(a | b) and len(a & b) / len(a | b) >= 0.8)

    roots = slow_components(list(range(len(rows))), linked)
    groups = defaultdict(list)
    for r, root in zip(rows, roots):
        groups[root].append(r)
    assert len(kept) == len(groups)
    want = {min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values()}
    assert {r["doc_id"] for r in kept} == want


def test_recall_of_similar_texts(spark):
    """At least 0.9 of the pairs with a similarity of 0.85 or more are candidates."""
    rng, rows, pairs = random.Random(5), [], []
    for n in range(60):
        base = prose(500 + n, 400).split()
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = f"new{n}"
        rows += [(2 * n, " ".join(base), None, None, None), (2 * n + 1, " ".join(copy), None, None, None)]
        a, b = simhash.shingle_set(rows[-2][1]), simhash.shingle_set(rows[-1][1])
        if len(a & b) / len(a | b) >= 0.85:
            pairs.append(2 * n + 1)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).select("doc_id").collect()}
    assert len(pairs) > 30 and sum(p not in kept for p in pairs) >= 0.9 * len(pairs)
    assert all(2 * n in kept for n in range(60))


def test_chains_of_edited_versions_end_in_one_group(spark):
    """Versions far from the first one of their chain are found through those between, as often as all pairs would be."""
    rows, groups = [], 0
    for n in range(20):
        rng, words = random.Random(700 + n), prose(700 + n, 300).split()
        for k in range(20):
            rows.append((1000 * k + n, " ".join(words), None, None, None))
            for _ in range(2):
                words[rng.randrange(len(words))] = f"new{n}x{k}"
        groups += 1
    sets = [simhash.shingle_set(r[1]) for r in rows]
    assert len(sets[0] & sets[19]) / len(sets[0] | sets[19]) < 0.6
    kept = simhash.drop_near_duplicates(frame(spark, rows)).count()
    assert groups <= kept <= groups + 2


def test_recall_close_to_the_required_similarity(spark):
    """At least 0.9 of the pairs with a similarity between 0.80 and 0.85 go, and texts that differ in the repeats of a line."""
    rng, rows, pairs = random.Random(15), [], []
    for n in range(150):
        base = prose(2500 + n, 300).split()
        copy = list(base)
        for i in rng.sample(range(5, 295), 6):
            copy[i] = f"new{n}"
        a, b = simhash.shingle_set(" ".join(base)), simhash.shingle_set(" ".join(copy))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            rows += [(2 * n, " ".join(base), None, None, None), (2 * n + 1, " ".join(copy), None, None, None)]
            pairs.append(2 * n + 1)
    for n, (few, many) in enumerate([(1, 20), (3, 60)] * 10):
        body, line = prose(3500 + n, 300), prose(4500 + n, 12)
        rows += [(5000 + 2 * n + k, " ".join([body] + [line] * times), None, None, None) for k, times in enumerate((few, many))]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).select("doc_id").collect()}
    assert len(pairs) > 50 and sum(p not in kept for p in pairs) >= 0.9 * len(pairs)
    assert {i for i in kept if i >= 5000} == {5000 + 2 * n for n in range(20)}


def test_different_texts_with_a_repeated_line_stay(spark):
    """A line that outweighs the rest sets the 64-bit fingerprint, but does not make texts similar; rows without doc_id neither."""
    line = prose(5500, 9)
    rows = [(n if n < 50 else None, " ".join([prose(5600 + n, 50)] + [line] * 30), None, None, None) for n in range(60)]
    prints = [simhash.fingerprint(r[1].encode()) & (2**64 - 1) for r in rows]
    assert sum((prints[0] ^ p).bit_count() <= 2 for p in prints) > 50
    kept = simhash.drop_near_duplicates(frame(spark, rows)).select("text").collect()
    assert sorted(r["text"] for r in kept) == sorted(r[1] for r in rows)


@pytest.mark.parametrize("operator", [simhash.near_duplicates, simhash.drop_near_duplicates, exact_dedup.exact_duplicates, exact_dedup.drop_duplicates])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def _fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("max_bytes", [exact_dedup.MAX_FILTER_BYTES, 64])
def test_exact_duplicates_equal_brute_force(spark, max_bytes):
    rows = odd_rows() + [(200 + i, f"copy {i % 7}", "en", "s0", 6) for i in range(60)]
    got = exact_dedup.exact_duplicates(with_clashes(frame(spark, rows)), max_bytes).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[_fold(r[1])].append(r[0])
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[3])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert all(r["shuffled"] for r in got if r["group_size"] > 1)  # no false negatives


def test_filters_let_most_sole_texts_pass(spark):
    rows = [(i, f"text {i}", None, None, None) for i in range(3000)]
    got = exact_dedup.exact_duplicates(frame(spark, rows))
    assert got.filter("shuffled").count() < 100 and got.filter("kept").count() == 3000


@pytest.mark.parametrize("max_bytes", [exact_dedup.MAX_FILTER_BYTES, 64])
def test_drop_duplicates_keeps_one_of_each_text(spark, max_bytes):
    rows = odd_rows() + [(200 + i, f"copy {i % 7}", "en", "s0", 6) for i in range(60)]
    kept = exact_dedup.drop_duplicates(with_clashes(frame(spark, rows)), max_bytes)
    assert kept.columns == with_clashes(frame(spark, [])).columns
    groups = defaultdict(list)
    for r in rows:
        groups[_fold(r[1])].append(r[0])
    want = sorted((t, max((i for i in ids if i is not None), default=-1)) for t, ids in groups.items())
    assert sorted((_fold(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == want


def test_texts_of_one_template_are_not_compared_pairwise(spark, monkeypatch):
    """Texts that share half their shingles meet in many buckets; a few similar ones among them must still be found."""
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 8)
    frame_, rows, same = prose(9000, 200), [], 0
    for i in range(600):
        own = prose(9100 + i, 90).split()
        rows.append((i, " ".join([frame_, *own]), None, None, None))
        if i % 60 == 0:
            own[40] = "changed"
            rows.append((10_000 + i, " ".join([frame_, *own]), None, None, None))
            same += 1
    a, b = simhash.shingle_set(rows[0][1]), simhash.shingle_set(rows[2][1])
    assert 0.4 < len(a & b) / len(a | b) < 0.6
    compared = []
    likely = simhash._likely
    monkeypatch.setattr(simhash, "_likely", lambda pairs, classes: compared.append(pairs.count()) or likely(pairs, classes))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).select("doc_id").collect()}
    assert kept == set(range(600)) and same == 10
    assert sum(compared) < 30 * len(rows)


def test_rounds_end_when_few_links_come(spark, monkeypatch):
    """A large bucket that gives a pair or two in each round must not take a round for each of them, nor lose any."""
    rounds, wanted = [], {(i, i + 1) for i in [*range(0, 400, 2), *range(10_000, 11_000, 2)]}

    def similar(docs, classes, candidates):
        rounds.append(1)
        assert len(rounds) <= 5
        return candidates.filter("u % 2 = 0 and v = u + 1").select("u", "v")

    monkeypatch.setattr(simhash, "LARGE_BUCKET", 1000)
    monkeypatch.setattr(simhash, "_likely", lambda pairs, classes: pairs)
    monkeypatch.setattr(simhash, "_similar_links", similar)
    buckets = spark.createDataFrame([(0, i) for i in range(400)] + [(i // 2, i) for i in range(10_000, 11_000)], "key long, id long")
    roots = simhash._grown(frame(spark, []), buckets.select("id", F.col("id").alias("first")), buckets)
    assert {(r["root"], r["node"]) for r in roots.filter("node <> root").collect()} == wanted


def test_texts_are_digested_once_in_a_branch(spark):
    """Three branches read the texts; the digests of each must not be taken once for its filter and once for its column."""
    kept = exact_dedup.drop_duplicates(frame(spark, odd_rows()))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 3
