"""Run user engines over images: the plug-in surface for detectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_SCHEMA = ("image_id long, engine_id string, status string, latency_ms double, message string, "
              "detections array<struct<label:string,score:double,x1:double,y1:double,x2:double,y2:double,area_px:double>>")


class MissingDependency(Exception):
    """Raised by an engine whose library is not installed."""


class MissingWeights(Exception):
    """Raised by an engine whose model file is not available."""


def run_engines(images: DataFrame, engines: Mapping[str, Callable[[], Callable[[dict], list[dict]]]]) -> DataFrame:
    """Apply every engine to every image row; a failing engine becomes a status, never a failed batch.

    ``engines`` maps an id to a factory. The factory runs once per task and engine (model loading); the callable it
    returns gets one image row as a dict and returns detections with ``label, score, x1, y1, x2, y2, area_px``.
    """
    fields = ("label", "score", "x1", "y1", "x2", "y2", "area_px")

    def status_of(error: Exception) -> str:
        return "missing_dependency" if isinstance(error, (MissingDependency, ImportError)) else "missing_weights" if isinstance(error, MissingWeights) else "error"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict = {}
        for name, factory in engines.items():
            try:
                loaded[name] = factory()
            except Exception as error:  # noqa: BLE001 - the contract is to report, not to fail
                loaded[name] = error
        for batch in batches:
            out = []
            for image in batch.to_dict("records"):
                for name, engine in loaded.items():
                    begin = time.perf_counter()
                    status, message, found = "ok", "", []
                    try:
                        if isinstance(engine, Exception):
                            raise engine
                        found = [{f: d.get(f) for f in fields} for d in engine(image)]
                    except Exception as error:  # noqa: BLE001
                        status, message = status_of(error), f"{type(error).__name__}: {error}"
                    out.append((image["image_id"], name, status, (time.perf_counter() - begin) * 1000, message, found))
            yield pd.DataFrame(out, columns=["image_id", "engine_id", "status", "latency_ms", "message", "detections"])

    return images.mapInPandas(run, RUN_SCHEMA)


def detections_of(runs: DataFrame) -> DataFrame:
    return runs.select("image_id", "engine_id", F.inline("detections"))


def pack_images(pixels: DataFrame, value: str = "g") -> DataFrame:
    """One row per image with its pixels as arrays (an image has at most width x height of them)."""
    packed = pixels.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v")))).alias("p"))
    return packed.select("image_id", F.col("p.y").alias("y"), F.col("p.x").alias("x"), F.col("p.v").alias("v"))
