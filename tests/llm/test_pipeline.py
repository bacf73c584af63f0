"""The pipeline against a brute-force version of its stages, and the registration of all queries."""

from __future__ import annotations

from collections import defaultdict

import __spark_entry__
import corpus_pipeline
from defectlake.llm import packing, simhash, toxicity

from .tables import frame, odd_rows, prose, with_clashes, words
from .test_dedup import _fold, slow_components
from .test_packing_mixing import slow_targets
from .test_toxicity import corpus


def write(spark, folder, rows, labels):
    frame(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_equal_brute_force(spark, tmp_path):
    docs, marks = corpus(260)
    rows = docs + [(1000 + i, t, lang, source, n) for i, (_, t, lang, source, n) in enumerate(odd_rows())]
    rows += [(2000 + i, docs[i][1].upper(), "en", "t", 0) for i in range(30)]  # exact copies
    near = [prose(9000 + i, 400).split() for i in range(8)]
    rows += [(3000 + 10 * i + k, " ".join(w if j != 50 * k else "other" for j, w in enumerate(base)), "en", "t", 0) for i, base in enumerate(near) for k in range(4)]
    folder = write(spark, tmp_path, rows, [(i, 1, t) for i, t in marks])
    out, table = [], spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if i < 4:
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        stage(spark, table, folder).write.parquet(f"{tmp_path}/out{i}")
        table = spark.read.parquet(f"{tmp_path}/out{i}")
        out.append(table.collect())

    scorer = toxicity.Scorer(toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")))
    kept = {r[0]: r[1] for r in rows if not scorer.score((r[1] or "").encode())["predicted"]}
    assert {r["doc_id"]: r["text"] for r in out[0]} == kept and 0 < len(kept) < len(rows)

    last = {}
    for doc_id, text in kept.items():
        last[_fold(text)] = max(doc_id, last.get(_fold(text), doc_id))
    kept = {i: kept[i] for i in last.values()}
    assert {r["doc_id"]: r["text"] for r in out[1]} == kept

    ids = sorted(kept)
    sets = {i: simhash.shingle_set(kept[i]) for i in ids}
    roots = slow_components(ids, lambda a, b: not sets[a] | sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    lowest = {}
    for doc_id, root in zip(ids, roots):
        lowest[root] = min(doc_id, lowest.get(root, doc_id))
    assert {r["doc_id"]: r["text"] for r in out[2]} == {i: kept[i] for i in lowest.values()} and len(lowest) < len(kept)

    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out[2]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in out[3]:
        taken[r["source"]] += len(words(r["text"]))
        assert r["text"] in kept[r["doc_id"]]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in slow_targets(sizes).items())

    encode = packing.byte_bpe()
    assert sum(r["length"] for r in out[4]) == sum(len(encode(r["text"] or "")) + 1 for r in out[3])
    assert sorted({r["doc_id"] for r in out[4]}) == sorted({r["doc_id"] for r in out[3]})


def test_run_applies_all_stages(spark, tmp_path):
    docs, marks = corpus(40)
    folder = write(spark, tmp_path, docs, [(i, 1, t) for i, t in marks])
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0


def test_stages_take_clashing_columns(spark, tmp_path):
    docs, marks = corpus(60)
    folder = write(spark, tmp_path, docs, [(i, 1, t) for i, t in marks])
    table = with_clashes(frame(spark, docs + [(5000 + i, t, lang, source, n) for i, (_, t, lang, source, n) in enumerate(odd_rows())]))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = table.columns
        stage(spark, table, folder).write.parquet(f"{tmp_path}/clash{i}")
        table = spark.read.parquet(f"{tmp_path}/clash{i}")
        assert i == 4 or table.columns == columns
        assert table.count() > 0


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert {"op2_exact_dedup", "op5_warc", "op9_license_scan"} <= set(__spark_entry__.oracle_sql())
