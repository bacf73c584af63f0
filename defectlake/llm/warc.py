"""WARC archives: a writer that turns repeated payloads into revisits, and a reader that salvages damaged files.

Archives are written by Spark's own text writer, so they reach any store that Spark reaches. Each record is a gzip member.
The writer ends every row with one fixed byte; a gzip member of less than 16 MB ends with a zero byte, which is therefore
left to the writer, and a longer one is followed by an empty member, which does. Plain records end with a line feed.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_memory, scratch_path, staged, values_of

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
END = b"\r\n\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"

DATE = "1970-01-01T00:00:00Z"
RECORDS_PER_FILE, FILE_BYTES = 2000, 1 << 30  # a file holds no more of either
GZIP_LEVEL = 4
BROADCAST_GROUPS = 100_000
PIECE_BYTES = 64

RECORDS = "file string, at long, size long, record_type string, page_id long, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary, gap string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str, date: str = DATE) -> bytes:
    """One record; a revisit holds the HTTP header alone, whose Content-Length is that of the full payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{RECORD_URN}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{RECORD_URN}{'' if refers_to is None else refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def gzip_member(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    """A gzip member that ends with a zero byte; one of 16 MB and more is followed by an empty member."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    return out if out[-1] == 0 else out + gzip_member(b"", level)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, gzip: bool = True, date: str = DATE) -> None:
    """Write one record for each row of ``pages(page_id, url, html)`` into files of at most 2,000 records and 1 GB below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is a response and the others
    revisit it; rows that share that id, and groups without any id, are responses all. A null html is an empty payload, a
    null url has no header, a null page_id an empty record id. Other columns are not read; no rows give no records.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload"))
    groups = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    groups = staged(groups.select(F.col("sha").alias("sha__"), "first"), "payloads")
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    known = keyed.join(F.broadcast(groups) if small else groups, F.col("sha") == F.col("sha__"), "left")

    def run(batches):
        lean_memory()
        for batch in batches:
            out = []
            ids, urls, payloads, digests, firsts = batch.columns
            for page_id, url, payload, sha, first in zip(ids.to_pylist(), urls.to_pylist(), values_of(payloads), digests.to_pylist(), firsts.to_pylist()):
                revisit = first is not None and page_id != first
                data = record_bytes(page_id, url, payload, first if revisit else None, revisit, base64.b32encode(bytes.fromhex(sha)).decode(), date)
                out.append((gzip_member(data) if gzip else data)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = known.select("page_id", "url", "payload", "sha", "first").mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record"))
    # The largest record tells how many surely fit; compression only makes files smaller.
    largest = keyed.agg(F.max(F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0)) * 3)).first()[0] or 0
    per_file = max(1, min(RECORDS_PER_FILE, FILE_BYTES // (largest + 4096)))
    lines.write.option("lineSep", "\x00" if gzip else "\n").option("maxRecordsPerFile", per_file).text(path)


def _number(urn: str | None) -> int | None:
    match = re.fullmatch(rf"<{RECORD_URN}(-?\d+)>", urn or "")
    return int(match[1]) if match else None


def parse_record(data: bytes, start: int = 0, whole: bool = False) -> tuple[dict, int] | str:
    """The record at ``start`` and where it ends, or why it is not valid. ``whole``: nothing may follow."""
    head = data.find(END, start)
    if not data.startswith(b"WARC/1.", start) or head < 0:
        return "no version line" if head >= 0 else "header without end"
    lines = data[start:head].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = fields.get("content-length", "")
    if not length.isdigit():
        return "no content length"
    begin, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != END or whole and end + 4 != len(data):
        return "length does not fit"
    block = data[begin:end]
    claimed = fields.get("warc-block-digest", "")
    if claimed.startswith("sha1:") and claimed != f"sha1:{base32_sha1(block)}":
        return "block digest differs"
    http, _, payload = block.partition(END)
    size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    if kind == "response" and digest.startswith("sha1:") and digest != f"sha1:{base32_sha1(payload)}":
        return "payload digest differs"
    found = {"record_type": kind, "page_id": _number(fields.get("warc-record-id")), "refers_to": _number(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri")}
    return found | {"payload_bytes": int(size[1]) if size else len(payload), "payload_digest": digest.removeprefix("sha1:") or None, "payload": payload if kind == "response" else None}, end + 4


def _member(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``, or None where its checks fail."""
    unpack = zlib.decompressobj(31)
    out, used = [], at
    try:
        while used < len(data) and not unpack.eof:
            chunk = data[used : used + (1 << 20)]
            out.append(unpack.decompress(chunk))
            used += len(chunk)
    except zlib.error:
        return None
    return (b"".join(out), used - len(unpack.unused_data)) if unpack.eof else None


def _pieces(data: memoryview, at: int) -> tuple[bytes, list[tuple[int, int]], bool]:
    """What the gzip member at ``at`` gives up to its end or first damage, (length of content, place in the file) as it grows, and whether it ended."""
    unpack, out, marks, size, used = zlib.decompressobj(31), [], [(0, at)], 0, at
    step = PIECE_BYTES
    while used < len(data) and not unpack.eof:
        before = unpack.copy() if step > 1 else None
        try:
            part = unpack.decompress(data[used : used + step])
        except zlib.error:
            if before is None:
                break
            unpack, step = before, 1  # what the damaged piece gives before its damage
            continue
        used = min(used + step, len(data)) - len(unpack.unused_data)
        out.append(part)
        size += len(part)
        marks.append((size, used))
    return b"".join(out), marks, unpack.eof


def _inside(data: memoryview, at: int) -> tuple[list, int, bool]:
    """Records and gaps inside the member at ``at``, as :func:`salvage` gives them, how far they reach, and whether the member ended there.

    Places in the file are those of the compressed bytes that had to be read for the record.
    """
    content, marks, ended = _pieces(data, at)
    sizes = [m[0] for m in marks]
    place = lambda n: marks[min(bisect.bisect_left(sizes, n), len(marks) - 1)][1]
    found, done, start = [], 0, content.find(b"WARC/1.")
    while start >= 0:
        parsed = parse_record(content, start)
        if isinstance(parsed, str):
            start = content.find(b"WARC/1.", start + 1)
            continue
        if content[done:start].strip(b"\r\n"):
            found.append((place(done), place(start), None, "no record in a part of a member"))
        found.append((place(start) if done < start else place(done), place(parsed[1]), parsed[0], None))
        done = parsed[1]
        start = content.find(b"WARC/1.", done)
    end = marks[-1][1] if ended else place(done)
    if ended and found and content[done:].strip(b"\r\n"):
        found.append((place(done), end, None, "no record in a part of a member"))
    return found, end, ended


def salvage(data: bytes):
    """Records and gaps of an archive in order, as (start, end, record or None, reason of the gap or None).

    Where a member or record fails its checks, the search goes on for the next valid member or version line; the bytes
    up to there are one gap. A member that holds several records, or is damaged, is searched for records like a plain archive. Padding (zero bytes between members, empty members, line ends between records) is no gap.
    """
    view, at, bad, why = memoryview(data), 0, None, ""
    starts = re.compile(re.escape(GZIP_MAGIC) + rb"|WARC/1\.")
    while at < len(data):
        found, inside = None, None
        if data.startswith(GZIP_MAGIC, at):
            member = _member(view, at)
            if member is None:
                reason = "member fails its checks"
            elif not member[0]:
                found = (None, member[1])
            else:
                parsed = parse_record(member[0], 0, True)
                found, reason = ((parsed[0], member[1]), "") if not isinstance(parsed, str) else (None, parsed)
            if found is None:
                inside = _inside(view, at)
        elif data.startswith(b"WARC/1.", at):
            parsed = parse_record(data, at)
            found, reason = (parsed, "") if not isinstance(parsed, str) else (None, parsed)
        elif bad is None and data[at] in b"\x00\r\n":
            at += 1
            continue
        else:
            reason = "neither member nor version line"
        if found:
            if bad is not None:
                yield bad, at, None, why
                bad = None
            if found[0] is not None:
                yield at, found[1], found[0], None
            at = found[1]
            continue
        if inside and inside[0]:
            if bad is not None:
                yield bad, at, None, why
                bad = None
            yield from inside[0]
            at = inside[1]
            if inside[2] or at >= len(data):
                continue
        if bad is None:
            bad, why = at, reason
        match = starts.search(data, at + 1)
        at = match.start() if match else len(data)
    if bad is not None:
        yield bad, len(data), None, why


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``, gzip or plain.

    A row is a record (``gap`` null) or a quarantined range of bytes (``gap`` says why; record_type null). ``at`` and ``size``
    give its place in the file. Digests of blocks and payloads are checked. An empty file gives no rows. ``payloads`` false
    leaves the column payload null.
    """

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for start, end, record, gap in salvage(content.as_py()):
                    record = record or {}
                    rows.append({"file": file, "at": start, "size": end - start, "gap": gap} | record | ({} if payloads else {"payload": None}))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in RECORDS.split(", "))])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0, gzip: bool = True) -> DataFrame:
    """Write ``pages`` as archives (into the shared folder without ``path``) and read them back, payloads left out."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes, gzip)
    return read_archives(pages.sparkSession, path, payloads=False)


def intact(records: DataFrame) -> DataFrame:
    """``records`` of :func:`read_archives`, which fails where they hold a gap."""
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in archive"), "file", F.lit("at"), "at", F.lit(":"), "gap")).cast("boolean")
    return records.filter(F.when(F.col("gap").isNull(), F.lit(True)).otherwise(lost))
