"""Skeletons of sparse pixel masks: thinning, spur pruning and the walked centre line.

A mask is cut into tiles that also see a margin of their surroundings. What a pixel turns into after n parallel steps
depends on pixels within n of it, so a tile with a margin of n computes n steps exactly as the whole image would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from .spatial import TASK_ROWS, dealt

TILE, THIN_MARGIN = 256, 32
# Longest spur, tolerance of the simplified line, and the order in which a walk looks around (dx, dy).
SPUR_PX, WALK_TOLERANCE = 12, 0.8
WALK_ORDER = ((0, -1), (1, 0), (0, 1), (-1, 0), (1, -1), (1, 1), (-1, 1), (-1, -1))


def _with_margin(mask: DataFrame, keys: list[str], tile: int, margin: int) -> DataFrame:
    """Pixels under every tile (``_ty``, ``_tx``) that they lie in or within the margin of, the tiles of one task behind one another.

    Tiles beyond the outermost pixels get no copies; an image that fits a tile thus has one. The number of tasks follows from that of
    pixels, equal pixels may stay.
    """
    rows = mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    n, *ends = rows.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    for axis, (least, most) in zip("yx", (ends[:2], ends[2:])):
        first, last = (least or 0) // tile, (most or 0) // tile
        low, high = F.floor((F.col(axis) - margin) / tile).cast("long"), F.floor((F.col(axis) + margin) / tile).cast("long")
        copies = F.explode(F.sequence(F.greatest(low, F.lit(first)), F.least(high, F.lit(last)))) if first < last else F.lit(first).cast("long")
        rows = rows.withColumn(f"_t{axis}", copies)
    tiles = [*keys, "_ty", "_tx"]
    tasks = max(mask.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    return dealt(rows, tiles, tasks).sortWithinPartitions(*tiles)


def _whole_tiles(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The sorted rows in tables of whole tiles, with the first row of every tile; a table is a batch and at most a tile more."""
    def starts(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows - 1, dtype=bool)
        for name in (*keys, "_ty", "_tx"):
            here, ahead = rows[name].slice(0, rows.num_rows - 1), rows[name].slice(1)
            other = pc.or_(pc.fill_null(pc.not_equal(here, ahead), False), pc.xor(pc.is_null(here), pc.is_null(ahead)))
            change |= other.to_numpy()
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        begin = starts(rows)
        if len(begin) > 1:
            yield rows.slice(0, begin[-1]), begin[:-1]
            held = rows.slice(begin[-1])
        else:  # repeats of a pixel are not piled up
            held = rows.group_by(rows.column_names, use_threads=False).aggregate([]).select(rows.column_names)
    if held is not None:
        yield held, starts(held)


def _stacked(rows: pa.Table, begin: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct pixels of many tiles and one flat image of them all, each tile's box below the last with an empty border between.

    Gives the rows that stay, the number of each row's tile, its place in the image, the image and its width.
    """
    y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
    number = np.repeat(np.arange(len(begin)), np.diff([*begin, len(y)]))
    top, left = np.minimum.reduceat(y, begin), np.minimum.reduceat(x, begin)
    width = int((np.maximum.reduceat(x, begin) - left).max()) + 3
    line = np.cumsum([1, *(np.maximum.reduceat(y, begin) - top + 2)])
    place, rest = np.unique((line[number] + y - top[number]) * width + x - left[number] + 1, return_index=True)
    image = np.zeros(int(line[-1]) * width, dtype=np.uint8)
    image[place] = 1
    return rows.take(rest), number[rest], place, image, width


def _own(rows: pa.Table, tile: int) -> np.ndarray:
    """Whether pixels are the tile's own and not those of its margin."""
    y, x, ty, tx = (rows[c].to_numpy() for c in ("y", "x", "_ty", "_tx"))
    return (y // tile == ty) & (x // tile == tx)


def _thinning_tables() -> list[np.ndarray]:
    """For both half steps of Zhang and Suen, whether a pixel goes, by its eight neighbours as bits clockwise from north."""
    ring = (np.arange(256)[:, None] >> np.arange(8)) & 1
    around, rises = ring.sum(axis=1), ((ring == 0) & (np.roll(ring, -1, axis=1) == 1)).sum(axis=1)
    north, east, south, west = ring[:, [0, 2, 4, 6]].T
    free = ((north & east & south) | (east & south & west), (north & east & west) | (north & south & west))
    return [(around >= 2) & (around <= 6) & (rises == 1) & (held == 0) for held in free]


def thin_stack(image: np.ndarray, width: int, place: np.ndarray, alone: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Thin the pixels at ``place`` in place: ``steps`` parallel full steps, or to the end for those that are ``alone``.

    Gives which pixels stay and which went in the last of the ``steps``. Only pixels are looked at, whatever the image's size.
    """
    ring, tables = (-width, 1 - width, 1, width + 1, width, width - 1, -1, -width - 1), _thinning_tables()
    live, late, step = np.arange(len(place)), np.zeros(len(place), dtype=bool), 0
    while len(live):
        if step == steps:
            live = live[alone[live]]
        before = len(live)
        for table in tables:
            at, code = place[live], np.zeros(len(live), dtype=np.uint8)
            for i, offset in enumerate(ring):
                code |= image[at + offset] << np.uint8(i)
            gone = table[code]
            image[at[gone]] = 0
            if step == steps - 1:
                late[live[gone]] = True
            live = live[~gone]
        if len(live) == before:
            break
        step += 1
    return image[place] == 1, late & ~alone


def thin(mask: DataFrame, keys: Sequence[str], tile: int = TILE, margin: int = THIN_MARGIN) -> DataFrame:
    """Zhang-Suen skeleton of every mask (``keys`` name one; rows are its set pixels).

    A round does as many half steps as the margin is wide (an even number) in every tile at once; tiles without pixels in their
    margin are done to the end. Rounds go on until no tile's last step changed anything, so thick shapes over several tiles take
    several rounds, and masks within a tile take one. A task thins many tiles in one image.
    """
    keys, steps = list(keys), margin // 2
    state = mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    schema = T.StructType([*state.schema.fields, T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _whole_tiles(batches, keys):
            rows, number, place, image, width = _stacked(rows, begin)
            own = _own(rows, tile)
            alone = np.bincount(number[~own], minlength=len(begin))[number] == 0 if steps else np.zeros(len(own), dtype=bool)
            kept, late = thin_stack(image, width, place, alone, steps)
            told = own & (kept | late)  # what went in the last step asks for another round
            out = rows.select([*keys, "y", "x"]).append_column("kept", pa.array(kept)).filter(pa.array(told))
            yield from out.to_batches()

    while True:
        done = checkpoint(_with_margin(state, keys, tile, margin).mapInArrow(run, schema))
        state = done.where("kept").drop("kept")
        if done.where("not kept").isEmpty():
            return state


def _spurs(pixels: set[tuple[int, int]], longest: int) -> set[tuple[int, int]]:
    """Pixels of branches of at most ``longest`` pixels between an end point and a junction, judged on the whole skeleton.

    This is the definition, pixel by pixel; :func:`spurs_of_stack` finds the same.
    """
    def around(p: tuple[int, int]) -> list[tuple[int, int]]:
        return [q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (q := (p[0] + dy, p[1] + dx)) in pixels]

    gone: set[tuple[int, int]] = set()
    for end in pixels:
        if len(around(end)) != 1:
            continue
        branch = [end]
        while len(branch) <= longest:
            ahead = next((q for q in around(branch[-1]) if q not in branch), None)
            if ahead is None:
                break
            if len(around(ahead)) >= 3:
                gone.update(branch)
                break
            branch.append(ahead)
    return gone


def spurs_of_stack(image: np.ndarray, width: int, place: np.ndarray, longest: int) -> np.ndarray:
    """Places of the pixels of spurs (see ``_spurs``) among the set pixels at ``place``; all end points walk at once."""
    around = (-width - 1, -width, 1 - width, -1, 1, width - 1, width, width + 1)
    count = lambda at: np.sum([image[at + offset] for offset in around], axis=0, dtype=np.int8)
    branch, gone = place[count(place) == 1][None, :], []
    for _ in range(longest):
        ahead = np.full(branch.shape[1], -1, dtype=np.int64)
        for offset in reversed(around):  # the first neighbour in this order is the one that stays
            to = branch[-1] + offset
            ahead = np.where((image[to] == 1) & ~(branch == to).any(axis=0), to, ahead)
        branch, ahead = branch[:, ahead >= 0], ahead[ahead >= 0]
        junction = count(ahead) >= 3
        gone.append(branch[:, junction].ravel())
        branch = np.vstack([branch[:, ~junction], ahead[~junction]])
    return np.concatenate([place[:0], *gone])


def prune_spurs(skeleton: DataFrame, keys: Sequence[str], longest: int = SPUR_PX, tile: int = TILE) -> DataFrame:
    """Skeleton without short branches that hang on a junction; a margin of twice their length makes tiles exact."""
    keys, margin = list(keys), 2 * (longest + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _whole_tiles(batches, keys):
            rows, _, place, image, width = _stacked(rows, begin)
            image[spurs_of_stack(image, width, place, longest)] = 0
            yield from rows.select([*keys, "y", "x"]).filter(pa.array(_own(rows, tile) & (image[place] == 1))).to_batches()

    schema = T.StructType([*[skeleton.schema[k] for k in keys], T.StructField("y", T.LongType()), T.StructField("x", T.LongType())])
    return _with_margin(skeleton, keys, tile, margin).mapInArrow(run, schema)


def simplified(line: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker line: points farther than ``tolerance`` from the chord of their stretch stay, the farthest first."""
    if len(line) < 3:
        return line
    pts, stay, todo = np.asarray(line, dtype=float), {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        inner, chord = pts[a + 1 : b] - pts[a], pts[b] - pts[a]
        size = math.hypot(*chord)
        away = np.abs(chord[1] * inner[:, 0] - chord[0] * inner[:, 1]) / size if size >= 1e-9 else np.hypot(inner[:, 0], inner[:, 1])
        far = int(np.argmax(away))
        if away[far] > tolerance:
            stay.add(a + 1 + far)
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return [line[i] for i in sorted(stay)]


def walked(pixels: list[tuple[int, int]]) -> tuple[list[tuple[float, float]], float]:
    """Line through all (x, y) pixels of a skeleton, out and back along every branch, and half its simplified length.

    Each connected part is walked depth first from an end point, if it has one; longer parts come first.
    """
    left = dict.fromkeys(sorted(pixels, key=lambda p: (p[1], p[0])))
    near = lambda p: [q for dx, dy in WALK_ORDER if (q := (p[0] + dx, p[1] + dy)) in left]
    met: set[tuple[int, int]] = set()
    parts = []
    for seed in left:
        if seed in met:
            continue
        part = dict.fromkeys([seed])
        front = [seed]
        for p in front:  # grows while it is read
            fresh = [q for q in near(p) if q not in part]
            part.update(dict.fromkeys(fresh))
            front += fresh
        start = next((p for p in front if len(near(p)) == 1), seed)
        line, trail = [start], [(start, iter(near(start)))]
        met.add(start)
        while trail:
            ahead = next((q for q in trail[-1][1] if q not in met), None)
            if ahead is not None:
                met.add(ahead)
                trail.append((ahead, iter(near(ahead))))
                line.append(ahead)
            else:
                trail.pop()
                if trail:
                    line.append(trail[-1][0])
        parts.append(line)
    walk, length = [], 0.0
    for line in sorted(parts, key=len, reverse=True):
        bends = simplified([(float(x), float(y)) for x, y in line], WALK_TOLERANCE)
        length += sum(math.dist(p, q) for p, q in zip(bends, bends[1:])) / 2
        walk += bends
    return walk, length


def centre_lines(skeleton: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Walked length and points of each skeleton named by ``keys``. The walk is sequential, so one skeleton is walked by one task."""
    keys = list(keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        walk, length = walked(list(zip(part["x"].tolist(), part["y"].tolist())))
        return part[keys].head(1).assign(length=length, points=[[{"x": x, "y": y} for x, y in walk]])

    schema = T.StructType([*[skeleton.schema[k] for k in keys], T.StructField("length", T.DoubleType()), T.StructField("points", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))])
    return skeleton.select(*keys, "y", "x").groupBy(*keys).applyInPandas(run, schema)
