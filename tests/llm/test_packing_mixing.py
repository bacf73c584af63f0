"""Packing, mixing and sharding: exact round trips, laws and edge cases."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from defectlake.llm import mixing, packing, sharding

from .tables import SCHEMA, frame, odd_rows, prose, with_clashes, words


def mixed_rows(count: int = 120) -> list[tuple]:
    return odd_rows() + [(1000 + i, prose(i, 1 + i * 37 % 400), "en", f"s{i % 3}", 0) for i in range(count)]


def test_ids_equal_the_public_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.byte_bpe()
    odd = ["<|endoftext|> x", "a b c \u0085 d", "don't WE'LL 's", "  \n\n\t x  ", "\U0001f468‍\U0001f469", "½ ² Ⅷ 一二三", "z" * 5000, "퟿̀", "a <|endoftext|> x<|endoftext|>"]
    for text in [r[1] or "" for r in odd_rows()] + odd:
        assert encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    rows = mixed_rows()
    pieces = packing.pack_documents(with_clashes(frame(spark, rows)).repartition(2)).toPandas()
    encode = packing.byte_bpe()
    want = Counter()
    for doc_id, text, *_ in rows:
        want[(-1 if doc_id is None else doc_id, encode(text or "").tobytes() + b"\0\0\0\0")] += 1
    # Within a sequence offsets have no gap; its length is the window or it is the last of its task.
    lengths = []
    for _, seq in pieces.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset.values == np.concatenate([[0], np.cumsum(seq.length.values)[:-1]])).all()
        lengths.append(int(seq.length.sum()))
        assert lengths[-1] <= 1024 and (seq.window == lengths[-1]).all() and lengths[-1].bit_count() == 1
    assert sum(n not in packing.WINDOWS for n in lengths) <= 2 * 7  # two tasks, what is left of each in powers of two
    assert (pieces.ids.map(len) == 4 * pieces.length).all()
    # Pieces of documents, by start, add up to every document once.
    got = Counter()
    for doc_id, part in pieces.fillna({"doc_id": -1}).groupby("doc_id"):
        copies = defaultdict(list)
        for r in part.sort_values("start").itertuples():
            copies[r.start].append(r)
        whole = sum(want[k] for k in want if k[0] == doc_id)
        assert sum(len(r.ids) for r in part.itertuples()) == sum(len(k[1]) * n for k, n in want.items() if k[0] == doc_id)
        if whole == 1:
            got[(int(doc_id), b"".join(bytes(r[0].ids) for _, r in sorted(copies.items())))] += 1
    assert got == Counter({k: n for k, n in want.items() if sum(m for j, m in want.items() if j[0] == k[0]) == 1})


def test_steps_are_balanced(spark):
    rows = [(i, prose(i, 300), None, None, None) for i in range(150)]
    pieces = packing.pack_documents(frame(spark, rows).coalesce(1)).toPandas()
    tokens = pieces.groupby("step").length.sum().tolist()
    assert len(tokens) > 5 and all(t == packing.STEP_TOKENS for t in tokens[:-1])


def test_packer_fills_gaps_from_shorter_tiers():
    packer = packing.Packer()
    for doc, length in enumerate([700, 300, 20, 90, 400, 2000]):
        packer.route(doc, length)
    full = packer.pack()
    assert all(sum(p[2] for p in seq) == window for window, seq in full)
    rest = packer.pack(last=True)
    assert sum(p[2] for _, seq in full + rest for p in seq) == 3510


def slow_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        out = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_targets_share_and_cap():
    for sizes in ({"b": 100, "a": 10, None: 1000}, {"x": 5}, {"a": 1, "b": 1, "c": 10_000, "d": 2, None: 0}, {}):
        got, want = mixing.targets(sizes), slow_targets(sizes) if sizes else {}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


@pytest.mark.parametrize("block", [16, mixing.BLOCK_WORDS])
def test_mix_takes_what_targets_ask(spark, block):
    rows = mixed_rows()
    plan = mixing.mix_plan(with_clashes(frame(spark, rows)), shards=5, block_words=block).collect()
    assert len(plan) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    goal, taken = slow_targets(sizes), defaultdict(int)
    ranges = defaultdict(list)
    for r in plan:
        size, own = len(words(r["text"])), sum(p["words"] for p in r["mix"]["pieces"])
        assert r["mix"]["size"] == size and r["mix"]["source_size"] == sizes[r["source"]] and own <= 3 * size
        assert abs(r["mix"]["target"] - goal[r["source"]]) < 1e-6
        taken[r["source"]] += own
        for p in r["mix"]["pieces"]:
            assert 0 <= p["first_word"] and p["first_word"] + p["words"] <= size
            ranges[r["source"], p["place"]].append((p["shard"], p["words"]))
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)
    # Blocks are disjoint and each lies in one shard; shards hold equal numbers of blocks.
    assert all(len({s for s, _ in parts}) == 1 and sum(n for _, n in parts) <= block for parts in ranges.values())
    shards = Counter(parts[0][0] for parts in ranges.values())
    assert max(shards.values()) - min(shards.get(i, 0) for i in range(5)) <= 1
    again = {(r["doc_id"], r["text"]): r["mix"]["pieces"] for r in mixing.mix_plan(frame(spark, rows).repartition(3), shards=5, block_words=block).collect() if r["doc_id"] not in (7, None)}
    assert again == {(r["doc_id"], r["text"]): r["mix"]["pieces"] for r in plan if r["doc_id"] not in (7, None)}


def test_mix_cuts_texts_into_their_pieces(spark):
    rows = [(i, prose(i, 50 + i), "en", f"s{i % 2}", 0) for i in range(40)]
    mixed = mixing.mix(with_clashes(frame(spark, rows)), shards=3, block_words=64).collect()
    texts = {r[0]: r[1].split() for r in rows}
    for r in mixed:
        assert r["text"].split() == texts[r["doc_id"]][r["first_word"] : r["first_word"] + r["words"]] and r["n_chars"] == len(r["text"])
    whole = defaultdict(dict)
    for r in mixed:
        whole[r["doc_id"], r["epoch"]][r["first_word"]] = r["text"]
    full = [k for k, parts in whole.items() if sum(len(t.split()) for t in parts.values()) == len(texts[k[0]])]
    assert full and all("".join(t for _, t in sorted(whole[k].items())) == next(r[1] for r in rows if r[0] == k[0]) for k in full)


def test_split_tree_is_exact():
    counts = np.array([100, 0, 7, 1001])
    out = mixing.split_tree(counts, 24, 1)
    assert (out.sum(axis=0) == counts).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1 and (out >= 0).all()
    assert (out == mixing.split_tree(counts, 24, 1)).all() and (out != mixing.split_tree(counts, 24, 2)).any()
    shares = np.mean([mixing.split_tree(counts, 4, s)[0] for s in range(400)], axis=0)
    assert np.abs(shares - counts / 4).max() < 2


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 5).tolist() != mixing.permuted(np.arange(1000), 1000, 6).tolist()


def test_word_counts_are_native_and_exact(spark):
    rows = odd_rows()
    got = frame(spark, rows).select("text", mixing.word_count().alias("n")).collect()
    assert all(r["n"] == len(words(r["text"])) for r in got)


@pytest.mark.parametrize("bucket_bytes", [2000, sharding.BUCKET_BYTES])
def test_shards_hold_every_row_once(spark, bucket_bytes):
    rows = mixed_rows()
    out = sharding.shuffled_shards(with_clashes(frame(spark, rows)), shards=7, bucket_bytes=bucket_bytes)
    assert len(set(out.columns)) == len(out.columns)
    got = out.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(((r[0], r[1]) for r in rows), key=key)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(7))


def test_shards_are_shuffled_and_seeded(spark):
    rows = [(i, f"t{i}", None, None, None) for i in range(400)]
    order = lambda seed, parts: [r["doc_id"] for r in sharding.shuffled_shards(frame(spark, rows).repartition(parts), 4, seed, 1000).orderBy("shard", "slot").collect()]
    first = order(1, 2)
    assert first == order(1, 5) and first != order(2, 2) and first != sorted(first)
    assert abs(np.corrcoef(range(400), first)[0, 1]) < 0.2


def test_equal_rows_over_the_memory_limit_are_split(spark):
    rows = [(1, "same text", None, None, None)] * 500
    got = sharding.shuffled_shards(frame(spark, rows), 4, bucket_bytes=300).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [125] * 4


@pytest.mark.parametrize("operator", [packing.pack_documents, mixing.mix_plan, mixing.mix, sharding.shuffled_shards])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fewer_rows_than_shards(spark):
    got = sharding.shuffled_shards(frame(spark, odd_rows()[:3]), 24).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (1, 0), (2, 0)]


def test_crc_of_ids(spark):
    from pyspark.sql import functions as F

    piece = packing.pack_documents(frame(spark, [(1, "a b", None, None, None)])).select("ids", F.crc32("ids").alias("c")).first()
    assert piece["c"] == zlib.crc32(bytes(piece["ids"]))


def test_pieces_are_planned_once(spark):
    """The step that plans pieces must not run for a filter and once more for its column, with a worker for each."""
    plan = mixing.mix(frame(spark, mixed_rows(20)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython [run(") == 1
