"""Archives: exact round trips, revisits, and salvage of damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from defectlake.llm import warc

SCHEMA = "page_id long, url string, html string"


def page_rows() -> list[tuple]:
    html = ["<p>same</p>"] * 4 + [None, "", "É 漢字 \U0001f600\r\n\r\nWARC/1.1\r\nfake: record\r\n\r\n", "x" * 300_000] + [f"<p>{i}</p>" * i for i in range(30)]
    rows = [(i, f"http://h/{i}?q=é\n" if i % 4 else None, h) for i, h in enumerate(html)]
    return rows + [(50, "u", "<b>twice</b>"), (50, "u", "<b>twice</b>"), (51, "u", "<b>twice</b>"), (None, "u", "<p>none</p>"), (None, None, "<p>none</p>")]


def expected(rows, least=0):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        lead = first.get(html or "") if len(data) >= least else None
        revisit = lead is not None and page_id != lead
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


def fields(rows):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("least", [0, 50])
def test_round_trip(spark, tmp_path, zipped, least):
    from pyspark.sql import functions as F

    rows = page_rows()
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit("x")).withColumn("sha", F.lit(1)).repartition(3)
    warc.write_archives(pages, f"{tmp_path}/a", min_bytes=least, gzip=zipped)
    got = warc.read_archives(spark, f"{tmp_path}/a").collect()
    assert all(r["gap"] is None for r in got)
    assert fields(got) == expected(rows, least)
    payloads = {(r["page_id"], bytes(r["payload"])) for r in got if r["record_type"] == "response"}
    assert payloads == {(r[0], (r[2] or "").encode()) for r, e in zip(rows, rows) if (r[0], len((r[2] or "").encode())) in {(p, n) for p, n, _, kind, _ in expected(rows, least) if kind == "response"}}
    # Every file is a plain sequence of gzip members or records.
    for file in Path(f"{tmp_path}/a").glob("part-*"):
        data = file.read_bytes()
        data = gzip.decompress(data) if zipped and data else data
        assert not data or data.startswith(b"WARC/1.1\r\n")
        end = 0
        while end < len(data):
            parsed = warc.parse_record(data, end)
            assert not isinstance(parsed, str)
            end = parsed[1]


def test_member_of_16_mb_and_more():
    data = warc.record_bytes(1, None, bytes(random.Random(1).randbytes(1000)) * 17_000, None, False, "x")
    out = warc.gzip_member(data, 1)
    assert out[-1] == 0 and gzip.decompress(out) == data


def archive(zipped: bool, count: int = 6) -> tuple[list[bytes], bytes]:
    records = []
    for i in range(count):
        payload = f"<p>payload {i}</p>".encode() * 50
        records.append(warc.record_bytes(i, f"http://h/{i}", payload, None, False, warc.base32_sha1(payload)))
    parts = [warc.gzip_member(r) if zipped else r for r in records]
    return parts, b"".join(parts)


def split(data: bytes):
    found = list(warc.salvage(data))
    return [r["page_id"] for _, _, r, _ in found if r], [(a, b) for a, b, _, gap in found if gap]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_after_damage(zipped):
    parts, data = archive(zipped)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    assert split(data) == (list(range(6)), [])
    broken = bytearray(data)
    middle = starts[2] + len(parts[2]) // 2
    broken[middle] ^= 0xFF  # a flipped byte inside record 2
    assert split(bytes(broken)) == ([0, 1, 3, 4, 5], [(starts[2], starts[3])])
    assert split(data[: starts[5] + 40]) == ([0, 1, 2, 3, 4], [(starts[5], starts[5] + 40)])  # cut short
    assert split(b"junk" + data) == (list(range(6)), [(0, 4)])
    assert split(data[: starts[3]] + b"\x07garbage" + data[starts[3] :]) == (list(range(6)), [(starts[3], starts[3] + 8)])
    lost = data[: starts[1] + 10] + data[starts[2] - 10 :]  # bytes lost from the middle of record 1
    assert split(lost)[0] == [0, 2, 3, 4, 5]
    assert split(b"") == ([], []) and split(b"nothing here") == ([], [(0, 12)])
    assert split(data[: starts[2]] + bytes(7) + data[starts[2] :])[0] == list(range(6))  # padding


def test_wrong_length_and_digest():
    parts, data = archive(False, 3)
    longer = parts[1].replace(b"Content-Length: ", b"Content-Length: 9", 1) if parts[1].count(b"Content-Length: ") else parts[1]
    assert split(parts[0] + longer + parts[2])[0] == [0, 2]
    swapped = parts[1].replace(b"payload 1", b"payload 9")
    ids, gaps = split(parts[0] + swapped + parts[2])
    assert ids == [0, 2] and gaps == [(len(parts[0]), len(parts[0] + swapped))]
    member = warc.gzip_member(swapped)  # the member's own checks hold, the record's do not
    assert split(member + warc.gzip_member(parts[2])) == ([2], [(0, len(member))])


def test_random_damage_never_crashes_and_gaps_are_exact():
    rng = random.Random(4)
    for zipped in (True, False):
        _, data = archive(zipped)
        for _ in range(60):
            bad = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(bad))
                bad[at : at + rng.randint(1, 30)] = rng.randbytes(rng.randint(0, 30))
            end = 0
            for a, b, record, gap in warc.salvage(bytes(bad)):
                assert a >= end and b > a and (record is None) == (gap is not None)
                end = b


def test_members_of_several_records():
    _, data = archive(False)
    assert split(gzip.compress(data)) == (list(range(6)), [])
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"abcdefgh ", k=3000)) for _ in range(6)]
    packed = gzip.compress(b"".join(warc.record_bytes(i, None, t, None, False, warc.base32_sha1(t)) for i, t in enumerate(texts)))
    cut = len(packed) * 2 // 3
    ids, gaps = split(packed[:cut])
    assert ids == [0, 1, 2] and len(gaps) == 1 and gaps[0][1] == cut
    ids, gaps = split(packed[:-8] + bytes(8) + gzip.compress(data))  # checks of the member fail
    assert ids == [*range(6), *range(6)] and len(gaps) == 1 and len(packed) - 12 <= gaps[0][0] <= len(packed) - 8 and gaps[0][1] == len(packed)


def test_a_gap_in_own_archives_is_an_error(spark, tmp_path):
    parts, _ = archive(True)
    (tmp_path / "x.warc.gz").write_bytes(parts[0] + parts[1][:30] + parts[2])
    with pytest.raises(Exception, match="gap in archive"):
        warc.intact(warc.read_archives(spark, str(tmp_path))).collect()


def test_gaps_reach_the_log(spark, tmp_path):
    parts, data = archive(True)
    (tmp_path / "x.warc.gz").write_bytes(parts[0] + parts[1][:30] + parts[2])
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r["page_id"] for r in got if r["gap"] is None] == [0, 2]
    gap = next(r for r in got if r["gap"])
    assert (gap["at"], gap["size"]) == (len(parts[0]), 30) and gap["file"].endswith("x.warc.gz")


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    rows = [(i, f"http://e/{i}", "".join(random.Random(i).choices("abcdefgh ", k=40_000))) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w", gzip=False)
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) >= 3 and all(f.stat().st_size <= 200_000 for f in files)
    assert {r["page_id"] for r in warc.intact(warc.read_archives(spark, f"{tmp_path}/w")).collect()} == set(range(12))
