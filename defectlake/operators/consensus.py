"""Agreement of several detectors on labels and places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.taxonomy import canonicalize, display_name
from ..session import checkpoint
from .ordered import ordered_positions
from .spatial import BOX, box_islands, box_pair_totals, box_pairs, ordered_fold


def with_canonical(detections: DataFrame) -> DataFrame:
    """Add ``canonical_label``; a value already present wins over the derived one."""
    derived = canonicalize(F.col("label"))
    if "canonical_label" in detections.columns:
        derived = F.coalesce(F.nullif("canonical_label", F.lit("")), derived)
    return detections.withColumn("canonical_label", derived)


def successful(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "ok").select("image_id", "engine_id")


def ok_counts(runs: DataFrame) -> DataFrame:
    return successful(runs).groupBy("image_id").agg(F.countDistinct("engine_id").alias("successful_engine_count"))


def label_consensus(runs: DataFrame, detections: DataFrame) -> DataFrame:
    """Per image and canonical label: engines that reported it, their share of all successful engines, mean score."""
    found = with_canonical(detections.select("image_id", "engine_id", "label", "score")).join(
        successful(runs), ["image_id", "engine_id"], "left_semi")
    grouped = found.groupBy("image_id", "canonical_label").agg(
        F.array_sort(F.collect_set("engine_id")).alias("engines"),
        F.count(F.lit(1)).alias("detections"), F.avg("score").alias("mean_score"))
    return (grouped.join(ok_counts(runs), "image_id")
            .select("image_id", "canonical_label", display_name(F.col("canonical_label")).alias("label"), "engines",
                    F.size("engines").cast("long").alias("engine_count"), "successful_engine_count",
                    (F.size("engines") / F.col("successful_engine_count")).alias("agreement_ratio"),
                    "detections", "mean_score"))


def pairwise_iou(detections: DataFrame, min_iou: float = 0.25) -> DataFrame:
    """Same-image, same-label box pairs with at least ``min_iou``, one row per pair of distinct boxes with copy counts."""
    return box_pairs(with_canonical(detections), ["image_id", "canonical_label"], min_iou)


def iou_totals(detections: DataFrame, min_iou: float = 0.25) -> DataFrame:
    """Number, IoU sum and largest IoU of the pairs of ``pairwise_iou`` for each image and label, without a row for each pair."""
    return box_pair_totals(with_canonical(detections), ["image_id", "canonical_label"], min_iou)


def pairwise_iou_ids(detections: DataFrame, min_iou: float = 0.25) -> DataFrame:
    """``pairwise_iou`` expanded to detection ids (``det_a < det_b`` within copies)."""
    rows = with_canonical(detections)
    keys = ["image_id", "canonical_label"]
    a = rows.select(*keys, F.col("det_id").alias("det_a"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = rows.select(*keys, F.col("det_id").alias("det_b"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    same = F.struct(*[f"a_{c}" for c in BOX]) == F.struct(*[f"b_{c}" for c in BOX])
    return (pairwise_iou(detections, min_iou).join(a, [*keys, *[f"a_{c}" for c in BOX]])
            .join(b, [*keys, *[f"b_{c}" for c in BOX]]).where(~same | (F.col("det_a") < F.col("det_b")))
            .select(*keys, "det_a", "det_b", "iou"))


CLUSTER_CELLS = 1 << 15  # boxes times clusters that are compared at a time


class _Clusters:
    """Running mean boxes of one fold group."""

    def __init__(self):
        self.sums = np.zeros((16, 4))
        self.counts = np.zeros(16)
        self.means = np.zeros((16, 4))
        self.n = 0
        self.ahead = 16

    def place(self, box: np.ndarray, min_iou: float) -> int:
        m = self.means[:self.n]
        if self.n:
            w = np.minimum(m[:, 2], box[2]) - np.maximum(m[:, 0], box[0])
            h = np.minimum(m[:, 3], box[3]) - np.maximum(m[:, 1], box[1])
            inter = np.maximum(w, 0) * np.maximum(h, 0)
            area = np.maximum(m[:, 2] - m[:, 0], 0) * np.maximum(m[:, 3] - m[:, 1], 0)
            own = max(box[2] - box[0], 0) * max(box[3] - box[1], 0)
            union = area + own - inter
            iou = np.divide(inter, union, out=np.zeros(self.n), where=union > 0)
            best = int(np.argmax(iou))  # first of equal values
            if iou[best] > 0 and iou[best] >= min_iou:
                self._add(best, box)
                return best
        if self.n == len(self.counts):
            self.sums = np.vstack([self.sums, np.zeros_like(self.sums)])
            self.means = np.vstack([self.means, np.zeros_like(self.means)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.n += 1
        self._add(self.n - 1, box)
        return self.n - 1

    def _add(self, i: int, box: np.ndarray) -> None:
        self.sums[i] += box
        self.counts[i] += 1
        self.means[i] = np.round(self.sums[i] / self.counts[i], 2)


    def place_all(self, boxes: np.ndarray, min_iou: float) -> list:
        """Clusters of consecutive boxes, as :meth:`place` gives them one by one.

        A stretch of boxes is given the clusters that fit now; then every box is compared with the means that its forerunners
        would leave. Up to the first box that another cluster fits this is what happened, and that box is placed by itself.
        """
        out: list = []
        while len(out) < len(boxes):
            part = boxes[len(out):len(out) + min(self.ahead, CLUSTER_CELLS // max(1, self.n))]
            guess = self._best(part, self.means[None, :self.n], min_iou) if self.n and len(part) > 1 else np.full(1, -1)
            new = np.flatnonzero(guess < 0)
            part = part[:new[0]] if len(new) else part
            if not len(part):
                out.append(self.place(boxes[len(out)], min_iou))
                continue
            rows, guess = np.arange(len(part)), guess[:len(part)]
            sums, counts = np.zeros((len(part) + 1, self.n, 4)), np.zeros((len(part) + 1, self.n))
            sums[0], counts[0] = self.sums[:self.n], self.counts[:self.n]
            sums[rows + 1, guess], counts[rows + 1, guess] = part, 1
            sums, counts = np.cumsum(sums, axis=0), np.cumsum(counts, axis=0)
            means = np.round(sums / counts[:, :, None], 2)
            wrong = np.flatnonzero(self._best(part, means[:-1], min_iou) != guess)
            right = int(wrong[0]) if len(wrong) else len(part)
            self.sums[:self.n], self.counts[:self.n], self.means[:self.n] = sums[right], counts[right], means[right]
            out.extend(guess[:right].tolist())
            if len(wrong):
                out.append(self.place(boxes[len(out)], min_iou))
            self.ahead = max(16, self.ahead // 2) if len(wrong) else min(512, self.ahead * 2)
        return out

    @staticmethod
    def _best(boxes: np.ndarray, means: np.ndarray, min_iou: float) -> np.ndarray:
        """Best fitting cluster of each box, or -1; ``means`` are those of all boxes or of each (boxes, clusters, 4)."""
        b = boxes[:, None]
        inter = np.maximum(np.minimum(means[..., 2], b[..., 2]) - np.maximum(means[..., 0], b[..., 0]), 0) * np.maximum(np.minimum(means[..., 3], b[..., 3]) - np.maximum(means[..., 1], b[..., 1]), 0)
        area = np.maximum(means[..., 2] - means[..., 0], 0) * np.maximum(means[..., 3] - means[..., 1], 0)
        union = area + np.maximum(b[..., 2] - b[..., 0], 0) * np.maximum(b[..., 3] - b[..., 1], 0) - inter
        iou = np.divide(inter, union, out=np.zeros_like(union), where=union > 0)
        best = iou.argmax(axis=1)  # first of equal values
        fit = iou[np.arange(len(boxes)), best]
        return np.where((fit > 0) & (fit >= min_iou), best, -1)


def spatial_clusters(runs: DataFrame, detections: DataFrame, min_iou: float = 0.25, cell: float = 64.0) -> DataFrame:
    """Score-ordered greedy clustering of boxes against each cluster's running mean box.

    The mean box of a cluster stays inside the hull of its members, so a cluster never leaves an x- or y-island of
    overlapping boxes: (image, label, island) is an exact partition of the sequential algorithm.
    """
    rows = with_canonical(detections).join(successful(runs), ["image_id", "engine_id"], "left_semi")
    for c in BOX:
        rows = rows.where(F.col(c).isNotNull())
    rows = box_islands(rows.select("image_id", "canonical_label", "det_id", "engine_id", "score", *BOX), ["image_id", "canonical_label"], cell)
    keys = ["image_id", "canonical_label", "island_x", "island_y"]
    order = [F.coalesce("score", F.lit(-1.0)).desc(), F.col("det_id").asc()]
    rows = rows.select(*keys, "det_id", "engine_id", "score", *BOX)

    def step(state: _Clusters, arrays: list) -> list:
        return state.place_all(np.column_stack(arrays).astype(float), min_iou)

    return ordered_fold(rows, keys, order, _Clusters, step, BOX, "cluster", T.LongType())


def cluster_summary(members: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean box, engines, agreement, mean score and creation order of each cluster (``keys`` start with image_id)."""
    grouped = members.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in BOX], F.array_sort(F.collect_set("engine_id")).alias("engines"),
        F.count(F.lit(1)).alias("detections"), F.avg("score").alias("mean_score"),
        F.min(F.struct((-F.coalesce("score", F.lit(-1.0))).alias("s"), F.col("det_id").alias("d"))).alias("seed"))
    ranked = ordered_positions(grouped.withColumn("_s", F.col("seed.s")).withColumn("_d", F.col("seed.d")).drop("seed"),
                               ["image_id"], ["_s", "_d"], F.floor(F.col("_s") * 100), position="cluster_id")
    return (ranked.join(ok_counts(runs), "image_id")
            .withColumn("engine_count", F.size("engines").cast("long"))
            .withColumn("agreement_ratio", F.col("engine_count") / F.col("successful_engine_count")).drop("_s", "_d"))


def spatial_consensus(runs: DataFrame, detections: DataFrame, min_iou: float = 0.25) -> DataFrame:
    keys = ["image_id", "canonical_label", "island_x", "island_y", "cluster"]
    # The summary reads the members twice (values and ranks); the Python fold must not run twice.
    members = checkpoint(spatial_clusters(runs, detections, min_iou))
    return cluster_summary(members, runs, keys).drop("island_x", "island_y", "cluster")


def top_detections(detections: DataFrame, n: int) -> DataFrame:
    """The ``n`` best-scored detections per image, missing scores last as 0."""
    order = Window.partitionBy("image_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "det_id")
    return detections.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
