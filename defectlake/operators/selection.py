"""Exact greedy selection in parallel, by rounds of dependencies.

Greedy selection takes rows in order and keeps each that conflicts with no kept one. A row can be decided as soon as all
better rows that it conflicts with are decided, so that far apart rows need not wait for each other. Rows are dealt to
tiles or blocks; a task settles in one pass what depends on its own rows alone, and marks as open what waits for
another task. Rounds go on with the open rows. The best open row is always settled, so the rounds end; their number is
that of the borders a chain of conflicts crosses, one after another.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import box_iou
from ..session import checkpoint
from .spatial import BOX, cell_range, ordered_fold

TILE = 1024.0
PEAK_CELL = 64.0


class _Tile:
    """The boxes that may still reject others, in order: those kept for certain and those that are open."""

    def __init__(self):
        self.boxes, self.certain, self.n = np.empty((16, 4)), np.empty(16, dtype=bool), 0

    def add(self, box: np.ndarray, certain: bool) -> None:
        if self.n == len(self.boxes):
            self.boxes = np.concatenate([self.boxes, np.empty_like(self.boxes)])
            self.certain = np.concatenate([self.certain, np.empty_like(self.certain)])
        self.boxes[self.n], self.certain[self.n] = box, certain
        self.n += 1

    def conflicts(self, box: np.ndarray, iou: float) -> np.ndarray:
        """Whether each conflicting box is certain."""
        k = self.boxes[: self.n]
        inter = np.maximum(0, np.minimum(k[:, 2], box[2]) - np.maximum(k[:, 0], box[0])) * np.maximum(0, np.minimum(k[:, 3], box[3]) - np.maximum(k[:, 1], box[1]))
        area = np.maximum(0, k[:, 2] - k[:, 0]) * np.maximum(0, k[:, 3] - k[:, 1]) + max(0, box[2] - box[0]) * max(0, box[3] - box[1])
        return self.certain[: self.n][inter / np.maximum(area - inter, 1e-9) > iou]


def _cells(rows: DataFrame, size: float, x: str, y: str) -> DataFrame:
    return (rows.withColumn(x, F.explode(cell_range(F.col("x1"), F.greatest("x1", "x2"), size)))
            .withColumn(y, F.explode(cell_range(F.col("y1"), F.greatest("y1", "y2"), size))))


def _ranked(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_o{i}" for i in range(len(order))]
    return rows.select("*", *[c.alias(n) for n, c in zip(names, order)]), names


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _without_peaks(rows: DataFrame, keys: list[str], ranks: list[str], iou: float) -> tuple[DataFrame, DataFrame]:
    """Kept peaks and the rows that none of them rejects.

    A peak is the best row of every grid cell it touches; boxes that conflict share a cell, so nothing better can reject
    it. Cells are reduced where rows lie before they meet, so a heap of similar boxes is cleared without being gathered.
    """
    own = [*keys, *ranks]
    gridded = _cells(rows.select(*own, *BOX), PEAK_CELL, "cx", "cy")
    best = gridded.groupBy(*keys, "cx", "cy").agg(F.min(F.struct(*ranks, *BOX)).alias("b"))
    span = lambda a, b: F.floor(F.greatest(f"b.{a}", f"b.{b}") / PEAK_CELL) - F.floor(F.col(f"b.{a}") / PEAK_CELL) + 1
    won = best.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == span("x1", "x2") * span("y1", "y2"))
    peaks = checkpoint(won.select(*keys, "b.*"))
    top = _cells(peaks, PEAK_CELL, "cx", "cy").select(*keys, "cx", "cy", *[F.col(c).alias(f"p_{c}") for c in [*ranks, *BOX]])
    same = F.struct(*ranks) == F.struct(*[F.col(f"p_{c}").alias(c) for c in ranks])
    hit = same | (box_iou([F.col(c) for c in BOX], [F.col(f"p_{c}") for c in BOX]) > iou)
    gone = gridded.join(top, [*keys, "cx", "cy"]).where(hit).select(*own).distinct()
    return peaks.select(*own), rows.join(gone, own, "left_anti")


def select_boxes(boxes: DataFrame, keys: Sequence[str], order: Sequence[Column], iou: float, tile: float = TILE) -> DataFrame:
    """Rows of ``boxes`` that greedy suppression keeps within each key: in ``order``, all that overlap no kept one by more than ``iou``.

    ``order`` must tell rows of a key apart. Boxes that touch several tiles are looked at in each and kept once free in all.
    """
    keys = list(keys)
    numbered, ranks = _ranked(boxes, order)
    numbered = checkpoint(numbered)
    own = [*keys, *ranks]
    kept, open_ = _without_peaks(numbered, keys, ranks, iou)
    parts = [kept]
    open_ = checkpoint(open_.select(*own, *BOX, F.lit(False).alias("sure")))

    def step(state: _Tile, arrays: list) -> list:
        out = []
        for *box, sure, border in zip(*arrays):
            found = state.conflicts(np.array(box), iou)
            status = "K" if sure else "R" if found.any() else "U" if len(found) else "F"
            if status != "R":
                state.add(np.array(box), bool(sure or (status == "F" and not border)))
            out.append(status)
        return out

    while not open_.where("not sure").isEmpty():
        tiles = lambda a, b: F.floor(F.greatest(a, b) / tile) - F.floor(F.col(a) / tile) + 1
        dealt = _cells(open_.withColumn("tiles", tiles("x1", "x2") * tiles("y1", "y2")), tile, "tx", "ty").withColumn("border", F.col("tiles") > 1)
        seen = ordered_fold(dealt, [*keys, "tx", "ty"], [F.col(r) for r in ranks], _Tile, step, [*BOX, "sure", "border"], "status", T.StringType())
        told = seen.where("not sure").groupBy(*own, *BOX, "tiles").agg(F.max(F.col("status") == "R").alias("lost"), F.sum((F.col("status") == "F").cast("int")).alias("free"))
        told = checkpoint(told.where("not lost").withColumn("sure", F.col("free") == F.col("tiles")))
        parts.append(told.where("sure").select(*own))
        # A box kept across a border has still to reject others; inside a tile it has done so.
        open_ = checkpoint(told.where("not sure or tiles > 1").select(*own, *BOX, "sure"))
    return numbered.join(_union(parts), own, "left_semi").drop(*ranks)


def select_pairs(rows: DataFrame, keys: Sequence[str], left: str, right: str, order: Sequence[Column], block: Column) -> DataFrame:
    """Rows that a greedy one-to-one choice keeps within each key: in ``order``, all whose ``left`` and ``right`` value are unused.

    ``order`` must tell rows of a key apart; ``block`` should keep rows with equal values together where it can. A value
    that occurs in several blocks is given to its best open row alone, found by partial aggregation.
    """
    keys = list(keys)
    numbered, ranks = _ranked(rows.withColumn("_block", block), order)
    numbered = checkpoint(numbered)
    open_ = numbered.select(*keys, F.col(left).alias("one"), F.col(right).alias("two"), *ranks, "_block")
    names, parts = open_.columns, []

    def step(state: tuple, arrays: list) -> list:
        taken, waiting = state
        out = []
        for one, two, ready in zip(*arrays):
            own = ((0, one), (1, two))
            status = "R" if any(o in taken for o in own) else "K" if ready and not any(o in waiting for o in own) else "U"
            if status != "R":
                (taken if status == "K" else waiting).update(own)
            out.append(status)
        return out

    while not open_.isEmpty():
        rank, ready = F.struct(*ranks), open_
        for side in ("one", "two"):
            first = open_.groupBy(*keys, side).agg(F.min(rank).alias(f"first_{side}"), (F.min("_block") != F.max("_block")).alias(f"shared_{side}"))
            ready = ready.join(first, [*keys, side])
        free = lambda side: ~F.col(f"shared_{side}") | (F.col(f"first_{side}") == rank)
        ready = ready.select(*names, (free("one") & free("two")).alias("ready"))
        seen = ordered_fold(ready, [*keys, "_block"], [F.col(r) for r in ranks], lambda: (set(), set()), step, ["one", "two", "ready"], "status", T.StringType())
        seen = checkpoint(seen.where("status <> 'R'"))
        kept = seen.where("status = 'K'")
        parts.append(kept.select(*keys, *ranks))
        open_ = seen.where("status = 'U'").select(*names)
        for side in ("one", "two"):
            open_ = open_.join(kept.select(*keys, side), [*keys, side], "left_anti")
        open_ = checkpoint(open_.select(*names))
    if not parts:
        return numbered.drop(*ranks, "_block")
    return numbered.join(_union(parts), [*keys, *ranks], "left_semi").drop(*ranks, "_block")
