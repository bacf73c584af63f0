"""I-Match fingerprints, licence digests and the secret forest."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import regex
import xxhash

from defectlake.llm import imatch, license_scan, secret_scan

from .tables import SCHEMA, frame, odd_rows, prose, with_clashes


def corpus() -> list[tuple]:
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 60)) + " " + prose(i, 20), "en", "s", 0) for i in range(60)]
    return rows + [(1000 + i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(odd_rows())]


def slow_terms(text: str | None) -> set[str]:
    return {w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w}


def slow_prints(rows: list[tuple], texts: list[str]) -> list[str]:
    count, seen = len(rows), Counter(w for _, t, *_ in rows for w in slow_terms(t))
    low, high = max(2, math.ceil(imatch.LEAST_SHARE * count)), max(2, math.floor(imatch.MOST_SHARE * count))
    band = {w for w, n in seen.items() if low <= n <= high}
    code = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    out = []
    for text in texts:
        own = slow_terms(text)
        codes = sorted((code(w) for w in (own & band) or own), key=lambda h: h - 2**64 if h >> 63 else h)
        groups = []
        for at, bits in imatch.SUBSETS:
            kept = [h for h in codes if not h >> at & ((1 << bits) - 1)]
            seed = 42
            for h in kept:
                seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
            groups.append(f"{seed & 0xFFFFFFFF:08x}" if kept else imatch.EMPTY)
        out.append("".join(groups))
    return out


def test_fingerprints_equal_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(with_clashes(frame(spark, rows))).collect()}
    assert got == {r[0]: p for r, p in zip(rows, slow_prints(rows, [r[1] for r in rows]))}
    assert got[1000] == got[1001] == got[1002] == imatch.EMPTY * 16  # null, empty, blanks


def test_fingerprints_take_repeated_and_missing_ids(spark):
    assert imatch.fingerprints(frame(spark, odd_rows())).count() == len(odd_rows())


def test_edited_texts(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(frame(spark, rows).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    prints = dict(zip([r[0] for r in rows], slow_prints(rows, [r[1] for r in rows])))
    edited = []
    for i, (_, text, *_) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited.append(text[: len(text) - half] + other[:half])

    def alike(a, b):
        pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, 128, 8)]
        some = [p for p in pairs if p != (imatch.EMPTY, imatch.EMPTY)]
        return sum(x == y for x, y in some) / len(some) if some else 1.0

    for i, (row, text, mark) in enumerate(zip(order, edited, slow_prints(rows, edited))):
        r = got[row[0]]
        assert r["n_chars"] == len(row[1] or "") and r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["fingerprint"] == prints[row[0]] and r["edited_fingerprint"] == mark
        assert abs(r["near_edited"] - alike(prints[row[0]], mark)) < 1e-12
        assert abs(r["near_next"] - alike(prints[row[0]], prints[order[(i + 1) % len(order)][0]])) < 1e-12
    assert len(got) == len(rows)


def test_order_over_many_ranges(spark):
    ids = [(i * 7 % 101, i) for i in range(101)]
    got = {r["doc_id"]: r["next_id"] for r in imatch.next_ids(spark.createDataFrame(ids, "doc_id long, n_chars long"), 7).collect()}
    assert got == {i: i - 1 if i else 100 for i in range(101)}


def test_plans_hold_no_python(spark):
    docs = frame(spark, corpus())
    for plan in (imatch.fingerprints(docs), license_scan.scan(docs), secret_scan.scan(docs)):
        text = plan._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|ArrowEval|MapInArrow", text)


def license_rows() -> list[tuple]:
    mit = license_scan._MIT
    texts = [
        mit, "Copyright (c) 2020 A. Author\n\n" + mit.upper(), mit.replace("\n\n", "\n\n  ").replace(" to deal", "\nto deal"), mit + "\n\nextra words", "intro\nReleased under the MIT Licence!\nend",
        "© 2021 somebody\nLICENSED under the apache license; version 2.0", "SPDX-License-Identifier: MIT\r\ncode", "The MIT License\n\n" + mit, "Released under the MIT Licenses.", "no licence here", "copyrighted: Released under the MIT License.",
        license_scan._ZLIB.replace("acknowledgment", "acknowledgment"), "Released under\nthe MIT License.\n\nmore",
    ]
    return odd_rows() + [(300 + i, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_licenses(spark):
    got = {(r["doc_id"] - 300, r["unit"], r["license_id"]) for r in license_scan.scan(with_clashes(frame(spark, license_rows()))).collect()}
    assert got == {(0, "text", "MIT"), (1, "text", "MIT"), (2, "text", "MIT"), (4, "line", "MIT"), (5, "line", "Apache-2.0"), (6, "line", "MIT"), (7, "text", "MIT"), (10, "line", "MIT")} - {(10, "line", "MIT")} | {(11, "text", "Zlib"), (12, "paragraph", "MIT")}


def test_licenses_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.register("rows", frame(spark, license_rows()).toPandas())
    con.execute("create table documents as select doc_id::bigint as doc_id, text from rows")
    want = sorted(map(str, con.execute(license_scan.scan_sql()).fetchall()))
    got = sorted(str(tuple(r)) for r in license_scan.scan(frame(spark, license_rows())).collect())
    assert got == want


def test_whole_texts_and_notices_of_common_licenses(spark):
    from pathlib import Path

    folder = Path(license_scan.__file__).parent / "licenses"
    texts = {name: "Copyright (c) 2021 A. Author\n\n" + (folder / f"{file}.txt").read_text() for file, name in license_scan._FILES.items()}
    texts |= {"AGPL-3.0-only": "x\nThis program is licensed under the GNU Affero General Public License v3.0\ny", "CC-BY-SA-3.0": "Released under CC BY-SA 3.0", "LGPL-2.1-or-later": "SPDX-License-Identifier: LGPL-2.1-or-later"}
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts.values())]
    got = {(r["doc_id"], r["license_id"], r["unit"]) for r in license_scan.scan(frame(spark, rows)).collect()}
    for i, name in enumerate(texts):
        assert (i, name, "text" if name in license_scan._FILES.values() else "line") in got, name


def test_own_license_table(spark):
    known = spark.createDataFrame([("X", "My own terms."), ("Y", "my OWN terms")], "license_id string, text string")
    got = license_scan.scan(frame(spark, [(1, "x\nMy own terms", None, None, None)]), known).collect()
    assert {r["license_id"] for r in got} == {"X", "Y"}


def secret_rows() -> list[tuple]:
    rows = odd_rows()
    for i in range(120):
        key = hashlib.sha1(str(i).encode()).hexdigest()
        shapes = [f'some text token = "{key}" more', f"put password={key[:20]} here", f"at commit {key} we", f"sha1: {key}", f"see https://h/{key}/x ok", f"order 4371{i:012d} paid"]
        rows.append((500 + i, prose(i, 10) + " " + shapes[i % 6] + " " + prose(i + 1, 10), "en", "src/test/x" if i % 2 else None, 0))
    return rows


def test_secrets(spark):
    rows = secret_rows()
    found = secret_scan.scan(with_clashes(frame(spark, rows)), path="source").collect()
    texts = {r[0]: r[1] for r in rows}
    hits = defaultdict(list)
    for r in found:
        assert r["value"] in re.split(r"[\x20\x09-\x0D]+", texts[r["doc_id"]])[r["word_no"]] and 0 <= r["probability"] <= 1
        hits[r["doc_id"]].append(r["secret"])
    for i in range(120):
        assert hits[500 + i] == [i % 6 < 2], i


def test_every_candidate_is_found(spark):
    rows = secret_rows()
    got = Counter((r["doc_id"], r["word_no"], r["part_no"], r["value"]) for r in secret_scan.candidates(frame(spark, rows)).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        for n, word in enumerate(re.split(r"[\x20\x09-\x0D]+", text or "")):
            for part, value in enumerate(re.findall(r"[A-Za-z0-9+/_\-]{16,}", word)):
                if re.search("[0-9]", value):
                    want[doc_id, n, part, value] += 1
    assert got == want and want


def test_short_and_odd_values_beside_names_are_candidates(spark):
    texts = {"login password=hunter2 now": "hunter2", "pwd: Tr0ub4dor&3, ok": "Tr0ub4dor&3", "x secret=CorrectHorseBatteryStaple": "CorrectHorseBatteryStaple", 'the passwd = "a!b"': "a!b", "password swordfish": "swordfish", "api_key:x": "x"}
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {(r["doc_id"], r["value"]) for r in secret_scan.scan(frame(spark, rows + [(99, "plain words only", None, None, None)])).collect()}
    assert got >= set(enumerate(texts.values())) and not any(i == 99 for i, _ in got)


@pytest.mark.parametrize("operator", [imatch.fingerprints, imatch.edited_fingerprints, license_scan.scan, secret_scan.scan])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_candidates_of_one_kind_keep_their_label(spark):
    only = secret_scan.scan(frame(spark, [(1, "see 4371549438645904 ok", None, None, None)])).first()
    assert only["probability"] == 0.0 and not only["secret"]
