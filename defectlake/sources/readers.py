"""Sources: stored tables, engine catalog, point text and LAS files, asset listings, samples."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import ordered_positions
from ..session import measured
from . import schemas

# File kinds by extension.
KINDS = {"2d": ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"], "3d": ["las", "laz", "xyz", "txt", "csv", "pts", "ply"], "spatial": ["ifc", "ifczip", "step", "stp"]}


def read_inspection_tables(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The stored tables found under ``folder``, with their declared schema (columns a file lacks read as null)."""
    return {name: spark.read.schema(schema).format(fmt).load(f"{folder.rstrip('/')}/{name}") for name, schema in schemas.TABLES.items()}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per engine of a JSON catalog document."""
    return spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path).select(F.inline("engines"))


def parse_xyz(lines: DataFrame) -> DataFrame:
    """Text lines (``value``) to points with optional colour and intensity; ``valid`` tells unreadable lines apart."""
    text = F.trim(F.col("value"))
    rows = lines.where((text != "") & ~text.startswith("#") & ~text.startswith("//"))
    parts = F.filter(F.split(F.trim("value"), r"[\s,;]+"), lambda p: p != "")
    rows = rows.select("value", F.transform(parts, lambda p: p.try_cast("double")).alias("v"))
    at = lambda i: F.get("v", F.lit(i))
    finite = lambda i: at(i).isNotNull() & ~F.isnan(at(i)) & (F.abs(at(i)) < float("inf"))
    rgb = finite(3) & finite(4) & finite(5)
    rows = rows.withColumn("valid", F.coalesce(finite(0) & finite(1) & finite(2), F.lit(False)))
    has_rgb = F.coalesce(rgb, F.lit(False))
    return rows.select("value", "valid", *[F.when(F.col("valid"), at(i)).alias(a) for i, a in enumerate("xyz")],
                       *[F.when(F.col("valid") & has_rgb, at(i)).alias(a) for i, a in ((3, "r"), (4, "g"), (5, "b"))],
                       F.when(F.col("valid"), F.when(has_rgb, at(6)).otherwise(at(3))).alias("intensity"))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    return parse_xyz(spark.read.text(path))


def xyz_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if("valid").alias("valid_points"), F.count_if(~F.col("valid")).alias("skipped_lines"), F.coalesce(F.bool_and(F.when(F.col("valid"), F.col("r").isNotNull())), F.lit(False)).alias("has_rgb"))


def asset_kind(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for kind, exts in KINDS.items():
        out = F.when(ext.isin(exts), kind) if out is None else out.when(ext.isin(exts), kind)
    return out.otherwise("unknown")


# Files up to this size are read whole by Spark's binary reader; it refuses files of 2 GB, and a row holds all of one.
WHOLE_BYTES = 16 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the files named by ``path``, read in blocks: the digest needs a file in order, but no more than a block of it."""
    from hashlib import sha256
    from urllib.parse import quote

    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            store, place = fs.FileSystem.from_uri(quote(re.sub("^file:/*", "file:///", re.sub("^s3[an]:", "s3:", path)), safe=":/@"))
            digest = sha256()
            with store.open_input_file(place) as source:
                while block := source.read(4 << 20):
                    digest.update(block)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "sha256"])


def list_assets(spark: SparkSession, path: str, digest: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Files below ``path`` with kind, size and, unless switched off, SHA-256 (only then are contents read).

    Files over ``whole_bytes`` are read in blocks through Arrow, which knows local paths and the public stores.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    columns = [F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), asset_kind(F.col("path")).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at")]
    if not digest:
        return files.select(*columns)
    small = files.where(F.col("length") <= whole_bytes).select(*columns, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select(*columns)
    return small.unionByName(large.mapInArrow(_digests, T.StructType([*large.schema.fields, T.StructField("sha256", T.StringType())])))


def stride_sample(rows: DataFrame, keys: list[str], order: str, chunk: Column, max_rows: int) -> DataFrame:
    """Every k-th row of each key in ``order``, k = ceil(n / max_rows).

    Rows are numbered per (key, chunk); with a uniformly distributed text id a short id prefix is a balanced chunk.
    """
    placed = ordered_positions(rows, keys, [order], chunk)
    stride = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(max_rows)))).alias("_k"))
    # A join by the key alone would bring a whole key to one task: the strides of a few keys go to all tasks.
    joined = placed.join(measured(stride), keys) if keys else placed.withColumn("_one", F.lit(1)).join(F.broadcast(stride.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return joined.where((F.col("pos") - 1) % F.col("_k") == 0).drop("pos", "_k")


# Fixed values of the LAS format: places in the header and in point records.
LAS_HEADER_BYTES = 227
LAS_RGB_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
LAS_POINT = "path string, index long, x double, y double, z double, intensity int, cls int, r int, g int, b int, error string"
LAS_BATCH = 50_000


_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
LAS_SCHEMA = pa.schema([(n, _KINDS[t]) for n, t in (f.split() for f in LAS_POINT.split(", "))])


def las_header(data, length: int | None = None) -> dict | str:
    """Layout of an uncompressed LAS file, or why it cannot be read; ``data`` may be the beginning of a file of ``length`` bytes."""
    length = len(data) if length is None else length
    if len(data) < LAS_HEADER_BYTES:
        return "shorter than a header"
    at = lambda form, place: struct.unpack_from("<" + form, data, place)
    if bytes(data[:4]) != b"LASF":
        return "no LASF signature"
    (start,), (kind,), (size,) = at("I", 96), at("B", 104), at("H", 105)
    if kind & 0x80:
        return "compressed points"
    if not size or start >= length:
        return "offset or record length"
    (declared,) = at("I", 107)
    if data[25] >= 4 and len(data) >= 255:
        declared = at("Q", 247)[0] or declared
    held = (length - start) // size
    count = min(declared or held, held)
    if count < 1 or size < 12:
        return "no point records"
    return {"start": start, "format": kind & 0x3F, "size": size, "count": count, "scale": at("3d", 131), "shift": at("3d", 155)}


def decode_las(path: str, head: dict, first: int, raw: np.ndarray) -> pa.RecordBatch:
    """Points of consecutive records (rows of bytes), the first of which has number ``first``."""
    def field(place: int, form: str) -> np.ndarray:
        width = np.dtype(form).itemsize
        return np.ascontiguousarray(raw[:, place : place + width]).view(form).ravel()

    size, kind = head["size"], head["format"]
    place = [field(4 * i, "<i4") * head["scale"][i] + head["shift"][i] for i in range(3)]
    keep = np.isfinite(place).all(axis=0)
    own = lambda at, form: field(at, form).astype(np.int32)[keep] if size >= at + np.dtype(form).itemsize else None
    cls = own(15, "u1") if kind <= 5 else own(16, "u1")
    rgb = LAS_RGB_AT.get(kind)
    colour = [own(rgb + 2 * i, "<u2") if rgb is not None else None for i in range(3)]
    columns = [np.arange(first, first + len(raw))[keep], *[p[keep] for p in place], own(12, "<u2"), cls & 0x1F if kind <= 5 and cls is not None else cls, *colour]
    m = int(keep.sum())
    arrays = [pa.array([path] * m, pa.string()), *[pa.nulls(m, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, list(LAS_SCHEMA)[1:10])], pa.nulls(m, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, schema=LAS_SCHEMA)


def parse_las(files: DataFrame) -> DataFrame:
    """Points of LAS files (``path``, ``content``), decoded in batches of 50,000; a file that cannot be read gives one row with its error.

    Intensity, class and colour are null where the point format has none. Points with an infinite coordinate are left out.
    """
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer()) if content.is_valid else memoryview(b"")
                head = las_header(data)
                if isinstance(head, str):
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": head}], LAS_SCHEMA)
                    continue
                for first in range(0, head["count"], LAS_BATCH):
                    n = min(LAS_BATCH, head["count"] - first)
                    raw = np.frombuffer(data, dtype=np.uint8, count=n * head["size"], offset=head["start"] + first * head["size"])
                    yield decode_las(path, head, first, raw.reshape(n, head["size"]))

    return files.select("path", "content").mapInArrow(run, LAS_POINT)


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """Points of all LAS files below ``path``; a file is read by one task and may have up to 2 GB.

    :func:`.las_ranges.read_las_ranges` reads a file by many tasks, from the stores that Arrow opens.
    """
    return parse_las(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def las_summary(points: DataFrame) -> DataFrame:
    """Points, channels and class counts per file."""
    counts = points.where("error is null").groupBy("path", "cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") + F.col("g") + F.col("b") > 0).alias("c"), F.count_if(F.col("intensity") > 0).alias("i"))
    classes = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("cls", "n")))))
    return counts.groupBy("path").agg(F.sum("n").alias("points"), (F.sum("c") > 0).alias("has_rgb"), (F.sum("i") > 0).alias("has_intensity"), classes.alias("classes"))
