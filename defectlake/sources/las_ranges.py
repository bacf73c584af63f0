"""LAS files as a Spark data source whose partitions are ranges of point records.

The planner reads the header of each file; a range of fixed-length records is then a partition of its own, so that one file
feeds many tasks and its size has no limit. Files are opened through Arrow, which knows local paths and the public stores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import LAS_BATCH, LAS_POINT, LAS_SCHEMA, decode_las, las_header

RANGE_BYTES = 64 << 20
HEAD_BYTES = 375


class LasRange(InputPartition):
    """Records ``first`` to ``first + count`` of a file, or why it cannot be read."""

    def __init__(self, path: str, head: dict | str, first: int = 0, count: int = 0):
        self.path, self.head, self.first, self.count = path, head, first, count


class LasRangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[LasRange]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for file in files:
            if file.type != fs.FileType.File or file.base_name.startswith((".", "_")):
                continue
            with store.open_input_file(file.path) as source:
                head = las_header(source.read_at(min(HEAD_BYTES, file.size), 0) if file.size else b"", file.size)
            if isinstance(head, str):
                out.append(LasRange(file.path, head))
                continue
            step = max(1, self.range_bytes // head["size"])
            out += [LasRange(file.path, head, first, min(step, head["count"] - first)) for first in range(0, head["count"], step)]
        return out

    def read(self, partition: LasRange) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if isinstance(partition.head, str):
            yield pa.RecordBatch.from_pylist([{"path": partition.path, "error": partition.head}], LAS_SCHEMA)
            return
        head, size = partition.head, partition.head["size"]
        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        with store.open_input_file(partition.path) as source:
            for first in range(partition.first, partition.first + partition.count, LAS_BATCH):
                n = min(LAS_BATCH, partition.first + partition.count - first)
                raw = np.frombuffer(source.read_at(n * size, head["start"] + first * size), dtype=np.uint8)
                yield decode_las(partition.path, head, first, raw.reshape(-1, size))


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las_ranges"

    def schema(self) -> str:
        return LAS_POINT

    def reader(self, schema) -> LasRangeReader:
        return LasRangeReader(self.options)


def read_las_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Points of all LAS files below ``path``, in tasks of about ``range_bytes``; rows as :func:`.readers.parse_las` gives them."""
    spark.dataSource.register(LasSource)
    return spark.read.format("las_ranges").option("rangeBytes", range_bytes).load(path)
