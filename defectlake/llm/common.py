"""Helpers that the training-data operators share: staged tables, column hygiene and word streams."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Words are maximal runs of bytes other than space and the control characters 9-13, which is how bytes.split() cuts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_GAP = re.compile(rb"[\x20\x09-\x0D]")
CHUNK_BYTES = 1 << 20
ROW_GROUP_BYTES = 16 << 20  # of staged tables; a task holds one while it writes and one while it reads


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a local master may run without that setting; then a temporary folder is set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="defectlake-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, on storage that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add; names compare without case, as Spark resolves them."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def word_chunks(text: bytes, size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Lists of the words of ``text`` in order; one list never stems from much more than ``size`` bytes plus one word."""
    if len(text) <= size:
        yield text.split()
        return
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + size)
        end = gap.start() if gap else len(text)
        yield text[start:end].split()
        start = end


def values_of(column: pa.Array, step: int = 256) -> Iterator[bytes | None]:
    """The texts of an Arrow column as UTF-8, a few hundred at a time, so that a task never holds a second copy of a batch."""
    column = column.cast(pa.binary())
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def of_worker(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once for each Python worker and kept between its tasks.

    Functions of this package travel by value, so that what their modules hold ends with the task.
    """
    holder = sys.modules.setdefault("defectlake_worker_state", types.ModuleType("defectlake_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def lean_memory() -> None:
    """Let Arrow return the memory of finished batches to the system, for workers that live long beside an executor."""
    pa.set_memory_pool(pa.system_memory_pool())
