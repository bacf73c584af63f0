"""Order-dependent building blocks that do not put a whole key into one task.

A window over ``PARTITION BY key`` sends every row of the key to one task. Here a key is cut into chunks of its order
column (months, days, id ranges): rows are numbered inside (key, chunk) and shifted by the number of rows in earlier
chunks, which are counted with partial aggregation. Previous or next rows are then equi-joins on (key, position), which
hash evenly whatever the size of the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                      position: str = "pos") -> DataFrame:
    """Add the 1-based position of each row inside its key, in ``order``.

    ``chunk`` must be a non-decreasing function of the first order column. The rows themselves are windowed per
    (key, chunk); only one counter row per (key, chunk) is windowed per key.
    """
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = rows.withColumn("_rn", F.row_number().over(inside))
    same = [numbered[k].eqNullSafe(offsets[k]) for k in keys] + [numbered["_chunk"].eqNullSafe(offsets["_chunk"])]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = numbered.join(offsets, condition, "left")
    return joined.select(*[numbered[c] for c in df.columns],
                         (offsets["_offset"] + numbered["_rn"]).cast("long").alias(position))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: Mapping[str, Column]) -> DataFrame:
    """Add for each name of ``values`` the sum of its column over the rows of the key up to this one, in ``order``.

    ``chunk`` is as in :func:`ordered_positions`: one row of sums per (key, chunk) is all that a window over a key reads.
    """
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in values.items()])
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_at"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    parts = rows.select("*", *[F.sum(c).over(inside).alias(f"_p_{n}") for n, c in values.items()])
    same = F.col("_chunk").eqNullSafe(F.col("_at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return parts.join(offsets, same).select(*df.columns, *[(F.col(f"_p_{n}") + F.col(f"_b_{n}")).alias(n) for n in values])


def shifted(df: DataFrame, source: DataFrame, keys: Sequence[str], step: int, columns: Mapping[str, str],
            position: str = "pos") -> DataFrame:
    """Bring ``columns`` (source name → new name) from the row ``step`` positions away (negative = earlier)."""
    keys = list(keys)
    other = source.select(*keys, (F.col(position) - F.lit(step)).alias(position),
                          *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(other, [*keys, position], "left")
