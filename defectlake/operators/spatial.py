"""Spatial join helpers: grid bucketing, island splitting and ordered folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import box_iou
from ..session import broadcast_if_small, checkpoint, stored

BOX = ("x1", "y1", "x2", "y2")


def cell_range(low: Column, high: Column, cell: float) -> Column:
    """Grid cells touched by the interval ``[low, high]`` as an array."""
    return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))


def axis_islands(df: DataFrame, keys: Sequence[str], low: Column, high: Column, cell: float, name: str) -> DataFrame:
    """Number the groups of rows whose intervals are separated by at least one empty grid cell.

    Works on the distinct occupied cells only (bounded by extent / cell), so a key with many rows is reduced by partial
    aggregation before anything is ordered. Rows of different islands never overlap and never lie within ``cell``.
    """
    keys = list(keys)
    rows = checkpoint(df.withColumn("_first_cell", F.floor(low / cell).cast("long")))  # read for the cells and for the rows
    cells = rows.withColumn("_cell", F.explode(cell_range(low, high, cell))).select(*keys, "_cell").distinct()
    order = Window.partitionBy(*keys).orderBy("_cell")
    marked = cells.withColumn("_new", (F.coalesce(F.lag("_cell").over(order), F.col("_cell") - 2) < F.col("_cell") - 1).cast("int"))
    islands = marked.select(*keys, F.col("_cell").alias("_first_cell"), F.sum("_new").over(order).cast("long").alias(name))
    return rows.join(islands, [*keys, "_first_cell"]).drop("_first_cell")


def box_islands(df: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Split every key into parts along x, then y, that no pair of overlapping boxes can straddle."""
    df = axis_islands(df, keys, F.col("x1"), F.greatest("x1", "x2"), cell, "island_x")
    return axis_islands(df, [*keys, "island_x"], F.col("y1"), F.greatest("y1", "y2"), cell, "island_y")


TASK_ROWS = 500_000  # rows that a task sorts, where the number of tasks is set by the number of rows


def tasks_for(df: DataFrame, task_rows: int | None = None) -> int:
    """Tasks that sort the rows of ``df`` (which are counted) with memory that does not grow with their number.

    Adaptive execution joins shuffle partitions up to a size in compressed bytes; narrow rows are then millions to a task.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (task_rows or TASK_ROWS)))


def dealt(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Rows of equal ``keys`` in one partition each, for functions that Spark does not know to need that.

    A plain ``repartition(keys)`` above a join on the same keys is taken out of the plan as done already; adaptive execution may
    then turn the join into a broadcast join that reads its shuffle by map tasks, and keys are torn apart. No join partitions
    by the hash of its keys, so this exchange stays.
    """
    place = F.xxhash64(*[F.col(k) for k in keys])
    return df.repartition(place) if tasks is None else df.repartition(tasks, place)


def key_runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list]]:
    """Batches of sorted rows with their runs of equal keys, as (key, first row, row after the last)."""
    for batch in batches:
        if batch.empty:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.ones(len(batch), dtype=bool)
        change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.flatnonzero(change).tolist()
        yield batch, [(tuple(c[begin] for c in columns), begin, end) for begin, end in zip(starts, [*starts[1:], len(batch)])]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[Column], start: Callable[[], object],
                 step: Callable[[object, list], Sequence], inputs: Sequence[str], output: str, output_type: T.DataType, tasks: int | None = None) -> DataFrame:
    """Fold the rows of every key in ``order`` through a Python state, batch by batch, adding column ``output``.

    Rows are hash-partitioned by key and sorted externally by Spark; the task streams Arrow batches and keeps only the
    state of the current key, never the key's rows. ``step(state, arrays)`` receives the ``inputs`` of consecutive rows
    of one key and returns their output values.
    """
    keys, inputs = list(keys), list(inputs)
    placed = dealt(df, keys, tasks).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField(output, output_type, True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch, runs in key_runs(batches, keys):
            arrays = [batch[c].to_numpy() for c in inputs]
            values: list = []
            for key, begin, end in runs:
                if key != current:
                    current, state = key, start()
                values.extend(step(state, [a[begin:end] for a in arrays]))
            yield batch.assign(**{output: values})

    return placed.mapInPandas(run, schema)


def box_pairs(boxes: DataFrame, keys: Sequence[str], min_iou: float, cell: float = 64.0) -> DataFrame:
    """Pairs of distinct boxes of one key with IoU of at least ``min_iou``, with the number of copies on both sides.

    Equal boxes are counted first, so copies never multiply; candidates meet in the grid cells both touch, and each pair
    is produced only in the cell that holds the corner of its intersection. A box with several copies also pairs with
    itself (``n_pairs = n·(n−1)/2``).
    """
    keys = list(keys)
    distinct = boxes.groupBy(*keys, *BOX).agg(F.count(F.lit(1)).alias("n"))
    gridded = (distinct.withColumn("cx", F.explode(cell_range(F.col("x1"), F.greatest("x1", "x2"), cell)))
               .withColumn("cy", F.explode(cell_range(F.col("y1"), F.greatest("y1", "y2"), cell))))
    a = gridded.select(*keys, "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in BOX], F.col("n").alias("n_a"))
    b = gridded.select(*keys, "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in BOX], F.col("n").alias("n_b"))
    first = F.struct(*[f"a_{c}" for c in BOX])
    second = F.struct(*[f"b_{c}" for c in BOX])
    home = ((F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("cx"))
            & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("cy")))
    iou = box_iou([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX])
    pairs = (a.join(b, [*keys, "cx", "cy"]).where(home & ((first < second) | ((first == second) & (F.col("n_a") > 1))))
             .withColumn("iou", iou).where(F.col("iou") >= min_iou))
    n_pairs = F.when(first == second, (F.col("n_a") * (F.col("n_a") - 1) / 2).cast("long")).otherwise(F.col("n_a") * F.col("n_b"))
    return pairs.withColumn("n_pairs", n_pairs).drop("cx", "cy")


PAIR_BLOCK = 1024  # rows, of one side, of the boxes that are compared at a time


def box_pair_totals(boxes: DataFrame, keys: Sequence[str], min_iou: float, cell: float = 64.0) -> DataFrame:
    """Number of pairs of :func:`box_pairs`, sum and maximum of their IoU, for every key; no pair becomes a row.

    A task compares the distinct boxes of one grid cell after another, block by block; a pair counts in the cell that holds the
    corner of its intersection. Of a cell it keeps the boxes seen so far, far fewer than their pairs.
    """
    keys = list(keys)
    cells = [*keys, "cx", "cy"]
    distinct = boxes.dropna(subset=keys).groupBy(*keys, *BOX).agg(F.count(F.lit(1)).alias("n"))
    gridded = (distinct.withColumn("cx", F.explode(cell_range(F.col("x1"), F.greatest("x1", "x2"), cell)))
               .withColumn("cy", F.explode(cell_range(F.col("y1"), F.greatest("y1", "y2"), cell))))
    placed = dealt(gridded.select(*cells, *[F.col(c).cast("double").alias(c) for c in BOX], "n"), cells).sortWithinPartitions(*cells)
    schema = T.StructType([*distinct.select(*keys).schema.fields, T.StructField("pairs", T.LongType()), T.StructField("iou_sum", T.DoubleType()), T.StructField("iou_max", T.DoubleType())])

    def compare(a: np.ndarray, b: np.ndarray, corner: tuple, total: list, same: bool) -> None:
        """Add the pairs of two blocks (columns of x1, y1, x2, y2, n), or of the rows of one."""
        x, y = np.maximum(a[0][:, None], b[0]), np.maximum(a[1][:, None], b[1])
        inter = np.maximum(np.minimum(a[2][:, None], b[2]) - x, 0) * np.maximum(np.minimum(a[3][:, None], b[3]) - y, 0)
        area = [np.maximum(s[2] - s[0], 0) * np.maximum(s[3] - s[1], 0) for s in (a, b)]
        union = area[0][:, None] + area[1] - inter
        iou = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        keep = (iou >= min_iou) & (np.floor(x / cell) == corner[0]) & (np.floor(y / cell) == corner[1])
        count = a[4][:, None] * b[4]
        if same:  # a box with copies pairs with itself
            keep = np.triu(keep)
            np.fill_diagonal(count, a[4] * (a[4] - 1) / 2)
            keep &= count > 0
        if keep.any():
            count, iou = count[keep], iou[keep]
            total[0] += int(count.sum())
            total[1] += float((count * iou).sum())
            total[2] = max(total[2], float(iou.max()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seen = None, []
        for batch, runs in key_runs(batches, cells):
            values, out = np.ascontiguousarray(batch[[*BOX, "n"]].to_numpy(dtype=float).T), []
            for key, begin, end in runs:
                if key != current:
                    current, seen = key, []
                total = [0, 0.0, -1.0]
                for first in range(begin, end, PAIR_BLOCK):
                    block = values[:, first:min(end, first + PAIR_BLOCK)].copy()
                    for before in seen:
                        compare(block, before, key[-2:], total, False)
                    compare(block, block, key[-2:], total, True)
                    seen.append(block)
                if total[0]:
                    out.append((*key[:-2], *total))
            yield pd.DataFrame(out, columns=schema.names)

    return placed.mapInPandas(run, schema).groupBy(*keys).agg(F.sum("pairs").alias("pairs"), F.sum("iou_sum").alias("iou_sum"), F.max("iou_max").alias("iou_max"))


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], axes: Sequence[str], radius: float,
               left_prefix: str = "l_", right_prefix: str = "r_", cell: float | None = None, nearest: bool = False, tasks: int | None = None, sparse: bool = False) -> DataFrame:
    """Exact distance join: pairs within ``radius`` on ``axes``, found through a grid of that cell size or of ``cell``.

    With ``nearest`` only the pair with the nearest right row, of the smallest ``point_id`` on ties, by so many ``tasks``, for ``sparse`` left rows or not, see :func:`_nearest_pairs`.

    The left side is copied into the cells it reaches, the right side stays in its own; each pair appears once. Wider cells
    mean fewer copies and more candidates. Columns of both sides come back prefixed, plus ``distance``. The sides are merged
    and not broadcast: Spark's estimate for a checkpointed table comes from its compressed files, some hundredth of the copies.
    """
    keys, cell = list(keys), cell or radius
    if nearest:
        return _nearest_pairs(left, right, keys, list(axes), radius, left_prefix, right_prefix, cell, tasks, sparse)
    near = left
    cells = []
    for axis in axes:
        name = f"_c_{axis}"
        near = near.withColumn(name, F.explode(cell_range(F.col(axis) - radius, F.col(axis) + radius, cell)))
        cells.append(name)
    l = near.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *cells,
                    *[F.col(c).alias(left_prefix + c) for c in left.columns])
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                     *[F.floor(F.col(axis) / cell).cast("long").alias(f"_c_{axis}") for axis in axes],
                     *[F.col(c).alias(right_prefix + c) for c in right.columns])
    joined = l.join(r.hint("merge"), [*[f"_k{i}" for i in range(len(keys))], *cells])
    squares = [(F.col(left_prefix + a) - F.col(right_prefix + a)) * (F.col(left_prefix + a) - F.col(right_prefix + a)) for a in axes]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return (joined.withColumn("distance", F.sqrt(total)).where(F.col("distance") <= radius)
            .drop(*[f"_k{i}" for i in range(len(keys))], *cells))


SETTLED_ROWS = 1 << 18  # rows of whole blocks that a task settles at a time


def _nearest_pairs(left: DataFrame, right: DataFrame, keys: list[str], axes: list[str], radius: float, left_prefix: str, right_prefix: str, cell: float, tasks: int | None, sparse: bool) -> DataFrame:
    """Left rows with their nearest right row within ``radius``, its ``distance``, and as ``other`` a distance that no other right row comes below.

    Both sides are dealt once to blocks of ``cell``, the right rows near a border also beyond it. A task sorts its rows by block,
    right before left and by ``point_id``; it holds the right rows of one block, and no candidate becomes a row. Where left rows
    are ``sparse``, right rows of other blocks are left out before, if the blocks are few enough.
    """
    def side(rows: DataFrame, number: int, prefix: str) -> DataFrame:
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        return places(rows, axes).select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(a).cast("double").alias(f"_x{i}") for i, a in enumerate(axes)], F.lit(number).cast("byte").alias("_side"),
            *[F.col(c).alias(prefix + c) for c in rows.columns if c not in axes and c not in keys])

    wide, blocks = radius * (1 + 1e-9), [f"_c{i}" for i in range(len(axes))]
    l, r = side(left, 1, left_prefix), side(right, 0, right_prefix)
    for i, block in enumerate(blocks):
        l = l.withColumn(block, F.floor(F.col(f"_x{i}") / cell).cast("long"))
        r = r.withColumn(block, F.explode(cell_range(F.col(f"_x{i}") - wide, F.col(f"_x{i}") + wide, cell)))
    place = [*[f"_k{i}" for i in range(len(keys))], *blocks]
    wanted = l.select(*place).distinct()
    if sparse and (known := broadcast_if_small(wanted)) is not wanted:
        r = r.join(known, place, "left_semi").select(*r.columns)
    rows = dealt(r.unionByName(l, allowMissingColumns=True), place, tasks).sortWithinPartitions(*place, "_side", right_prefix + "point_id")
    own = [c for c in rows.columns if c not in (*place, "_side") and not c.startswith("_x")]
    kinds = {left_prefix + c: left.schema[c].dataType for c in left.columns} | {right_prefix + c: right.schema[c].dataType for c in right.columns if c not in keys}
    spot_columns = {f"{p}{a}" for p in (left_prefix, right_prefix) for a in axes}
    out = T.StructType([T.StructField(c, T.DoubleType() if c in spot_columns else kind) for c, kind in (kinds | {"distance": T.DoubleType(), "other": T.DoubleType()}).items()])

    def settle(rows: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
        new = np.zeros(len(rows), dtype=bool)
        for c in place:
            values = rows[c].combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= values[1:] != values[:-1]
        block, right_side = np.cumsum(new), rows["_side"].to_numpy() == 0
        at = np.column_stack([rows[f"_x{i}"].to_numpy() for i in range(len(axes))])
        spots = np.flatnonzero(~right_side)
        met = np.zeros(block[-1] + 1, dtype=bool)
        met[block[spots]] = met[-1] = True  # left rows of the last block may follow
        points = np.flatnonzero(right_side & met[block])
        index = NearestIndex(block[points], at[points], radius)
        found, distance, other = index.query(block[spots], at[spots])
        hit = np.flatnonzero(found >= 0)
        mine, theirs = spots[hit], points[found[hit]]
        columns = {"distance": distance[hit], "other": other[hit]}
        for c in own:
            columns[c] = rows[c].take(mine if c.startswith(left_prefix) else theirs).combine_chunks()
        for i, k in enumerate(keys):
            columns[left_prefix + k] = rows[f"_k{i}"].take(mine).combine_chunks()
        for i, a in enumerate(axes):
            columns[left_prefix + a], columns[right_prefix + a] = at[mine, i], at[theirs, i]
        keep = points[index.kept]
        return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name]) for f in out], names=out.names), rows.take(keep[block[keep] == block[-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, count = [], [], 0
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= SETTLED_ROWS:
                done, rest = settle(pa.Table.from_batches([*held, *waiting]))
                held, waiting, count = rest.to_batches(), [], 0
                yield done
        if count:
            yield settle(pa.Table.from_batches([*held, *waiting]))[0]

    return rows.mapInArrow(run, out).select(*[F.col(f.name).cast(kinds[f.name]).alias(f.name) if f.name in spot_columns else f.name for f in out])


class NearestIndex:
    """Exact nearest search among points in memory, by hashed cells that are halved until few points share one.

    ``group`` numbers the part that a point belongs to, ``points`` has a row of coordinates each. Of points at one distance the
    first counts, copies of a point are left out (``kept`` has the others). A place goes on to wider cells, up to ``radius``,
    until a point is no farther than a cell is wide.
    """

    PAIRS = 1 << 21  # candidates that are compared at a time
    STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

    def __init__(self, group: np.ndarray, points: np.ndarray, radius: float):
        # Copies share the bits of their coordinates (and 0.0 those of -0.0).
        code = group.astype(np.uint64) * self.STEPS[-1]
        for i in range(points.shape[1]):
            code = (code ^ (code >> np.uint64(31))) * self.STEPS[i] + (points[:, i] + 0.0).view(np.uint64)
        _, first, at = np.unique(code, return_index=True, return_inverse=True)
        copy = (first[at] != np.arange(len(code))) & (group == group[first[at]]) & (points == points[first[at]]).all(axis=1)
        self.kept = np.flatnonzero(~copy)
        group, points = group[self.kept], points[self.kept]
        self.group, self.points, self.radius = group, points, radius
        self.bits = max(4, int(2 * len(points)).bit_length())
        self.levels: list[tuple[float, np.ndarray, np.ndarray] | None] = [None]
        if len(points):
            _, share = np.unique(self._code(group, points, radius), return_counts=True)
            crowd = float((share.astype(float) ** 2).sum() / share.sum())  # points that a point meets in its cell
            self.levels *= 1 + min(24, max(0, int(np.log2(max(1.0, 2 * crowd)) / points.shape[1])))

    def _cells(self, points: np.ndarray, size: float) -> np.ndarray:
        return np.floor(points / (size * (1 + 1e-6))).astype(np.int64)  # a little wider than the search, for rounding

    def _code(self, group: np.ndarray, points: np.ndarray, size: float) -> np.ndarray:
        code = group.astype(np.uint64) * self.STEPS[-1]
        for i, cell in enumerate(self._cells(points, size).T):
            code = code + cell.astype(np.uint64) * self.STEPS[i]
        return code

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _level(self, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        if self.levels[k] is None:
            size = self.radius / 2 ** k
            slot = self._slot(self._code(self.group, self.points, size))
            order = np.argsort(slot, kind="stable")
            self.levels[k] = size, order, np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << self.bits))])
        return self.levels[k]

    def query(self, group: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest point within the radius, or -1, its distance, and one that no other point comes below, for each place."""
        best, distance, other = np.full(len(places), -1), np.full(len(places), np.inf), np.full(len(places), np.inf)
        left = np.flatnonzero(np.isfinite(places).all(axis=1)) if len(self.points) else np.arange(0)
        for k in reversed(range(len(self.levels))):
            if not len(left):
                break
            size = self._level(k)[0]
            best[left], distance[left], other[left] = -1, np.inf, size
            for part in np.array_split(left, -(-len(left) // 32768)):
                self._search(k, part, group, places, best, distance, other)
            left = left[distance[left] > size]
        far = distance > self.radius
        best[far], distance[far] = -1, np.inf
        best[~far] = self.kept[best[~far]]
        return best, distance, other

    def _search(self, k: int, at: np.ndarray, group: np.ndarray, places: np.ndarray, best: np.ndarray, distance: np.ndarray, other: np.ndarray) -> None:
        size, order, starts = self._level(k)
        code = self._code(group[at], places[at], size)
        for offset in np.ndindex(*[3] * places.shape[1]):
            step = np.uint64(sum((o - 1) * int(self.STEPS[i]) for i, o in enumerate(offset)) % (1 << 64))
            slot = self._slot(code + step)
            begin, count = starts[slot], starts[slot + 1] - starts[slot]
            some = np.flatnonzero(count)
            while len(some):  # as many places at a time as their candidates allow, one at least
                total = np.cumsum(count[some])
                n = max(1, int(np.searchsorted(total, self.PAIRS, side="right")))
                self._compare(at[some[:n]], order, begin[some[:n]], count[some[:n]], group, places, best, distance, other)
                some = some[n:]

    def _compare(self, at, order, begin, count, group, places, best, distance, other) -> None:
        first = np.cumsum(count) - count
        row = np.repeat(np.arange(len(at)), count)
        found = order[np.arange(len(row)) - first[row] + begin[row]]
        square = np.zeros(len(row))
        for i in range(places.shape[1]):
            gap = places[at, i][row] - self.points[found, i]
            square += gap * gap
        d = np.where(self.group[found] == group[at][row], np.sqrt(square), np.inf)
        low = np.minimum.reduceat(d, first)
        which = np.minimum.reduceat(np.where(d == low[row], found, len(self.points)), first)
        after = np.minimum.reduceat(np.where(found == which[row], np.inf, d), first)
        # A slot may hold several cells and be met twice: the best point again is no other one.
        after = np.minimum(after, np.where(which == best[at], np.inf, np.maximum(low, distance[at])))
        other[at] = np.minimum(other[at], after)
        better = np.isfinite(low) & ((low < distance[at]) | ((low == distance[at]) & (which < best[at])))
        best[at[better]], distance[at[better]] = which[better], low[better]


def nearest_within(queries: DataFrame, points: DataFrame, keys: Sequence[str], axes: Sequence[str], point_id: str, radius: float | None, start: float,
                   factor: float = 3.0) -> DataFrame:
    """Nearest point (smallest id on ties) of every distinct query position, at most ``radius`` away (None = any distance).

    The search radius grows from ``start``; a round settles all positions with a point in reach and passes on the rest,
    so dense places are settled with few candidates. Places with a missing or infinite coordinate have no nearest point.
    Returns keys, axes, ``point_id`` and ``distance``.
    """
    keys, axes = list(keys), list(axes)
    points = stored(places(points, axes).groupBy(*keys, *axes).agg(F.min(point_id).alias("point_id")))
    rest = places(queries, axes).select(*keys, *axes).distinct()
    rest = stored(rest.join(points.select(*keys).distinct(), keys, "left_semi") if keys else rest)
    return nearest_places(rest, points, keys, axes, radius, start, factor).select(*keys, *axes, "point_id", "distance")


def places(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Rows whose coordinates are all finite."""
    finite = None
    for a in axes:
        ok = F.abs(F.col(a)) < F.lit(float("inf"))  # false for null and NaN, which compares as the largest
        finite = ok if finite is None else finite & ok
    return rows.where(finite)


# Blocks of the nearest search, in radii, in a plane and in space: a point is copied into some 1.1 of them an axis.
NEAREST_CELL = {1: 16.0, 2: 16.0, 3: 32.0}


def nearest_places(rest: DataFrame, points: DataFrame, keys: Sequence[str], axes: Sequence[str], radius: float | None, start: float, factor: float, ids: bool = True) -> DataFrame:
    """The search of :func:`nearest_within` on materialised distinct places and points (keys, axes, ``point_id``).

    Further columns of ``rest`` come back, the coordinates of the point found as ``to_<axis>``, and as ``other`` a distance that
    no other point comes below; ``point_id`` only with ``ids``.
    """
    place = rest.columns
    reach, parts, known = start if radius is None else min(start, radius), [], points.count()
    open_rows = rest.count() if known else 0
    while True:
        tasks = max(points.sparkSession.sparkContext.defaultParallelism, -(-(open_rows + known) // TASK_ROWS))  # what a task sorts stays in memory
        pairs = near_pairs(rest, points, keys, axes, reach, cell=NEAREST_CELL[len(axes)] * reach, nearest=True, tasks=tasks, sparse=open_rows * 4 < known)
        found = stored(pairs.select(*[F.col(f"l_{c}").alias(c) for c in place], "distance", *([F.col("r_point_id").alias("point_id")] if ids else []), *[F.col(f"r_{a}").alias(f"to_{a}") for a in axes], "other"))
        parts.append(found)
        settled = found.count()
        if settled == open_rows or radius is not None and reach >= radius:
            break
        rest, open_rows = stored(rest.join(found.select(*place).hint("merge"), place, "left_anti")), open_rows - settled
        reach = reach * factor if radius is None else min(reach * factor, radius)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
