"""Regions of interest: relational thresholds and coverage, and the segmenter of the kernel tier."""

from __future__ import annotations

import tempfile
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import imaging

CLOSE_TO_FLAT = 1e-6


def normalise(values: DataFrame, key: str, value: str) -> DataFrame:
    """value scaled to 0..1 within its key; 0 where the key's values are flat."""
    w = Window.partitionBy(key)
    span = F.max(value).over(w) - F.min(value).over(w)
    return values.withColumn("scaled", F.when(span <= CLOSE_TO_FLAT, 0.0).otherwise((F.col(value) - F.min(value).over(w)) / span))


def percentile_mask(values: DataFrame, key: str, value: str, percentile: float = 90.0) -> DataFrame:
    """values with mask 0/1: at the key's exact percentile or above, or above the least value where that is the percentile."""
    t = values.groupBy(key).agg(F.percentile(value, F.lit(percentile / 100)).alias("t"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    low = F.col("lo") + CLOSE_TO_FLAT
    mask = F.when(F.col("hi") - F.col("lo") <= CLOSE_TO_FLAT, 0).when(F.col("t") <= low, (F.col(value) > low).cast("int")).otherwise((F.col(value) >= F.col("t")).cast("int"))
    return values.join(t.hint("shuffle_hash"), key).withColumn("mask", mask)  # else values may be broadcast, whose size Spark underrates if they come out of an explode


def coverage(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.avg("roi").alias("coverage"), F.sum("roi").alias("n_roi"))


def fill_holes(px: DataFrame) -> DataFrame:
    """(image_id, y, x, roi, filled): background that isn't 8-connected to the border becomes ROI.

    Rows of background are cut into runs, so an image has few nodes. Runs that touch one that the border reaches are reached
    in the next round, a row further, until there are none; what is reached is checkpointed, so lineage is cut.
    """
    row = Window.partitionBy("image_id", "y").orderBy("x")
    size = px.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    gap = F.when(F.lag("x").over(row) == F.col("x") - 1, 0).otherwise(1)
    free = px.filter("roi = 0").withColumn("gap", gap).withColumn("run", F.sum("gap").over(row))
    runs = free.groupBy("image_id", "y", "run").agg(F.min("x").alias("a"), F.max("x").alias("z")).join(size, "image_id")
    runs = _cut(runs.select("image_id", "y", "a", "z", ((F.col("y") == 0) | (F.col("y") == F.col("my")) | (F.col("a") == 0) | (F.col("z") == F.col("mx"))).alias("out")))
    near = runs.select("image_id", F.col("y").alias("y2"), F.col("a").alias("a2"), F.col("z").alias("z2"))
    touch = (F.col("a2") <= F.col("z") + 1) & (F.col("z2") >= F.col("a") - 1)
    down = runs.withColumn("y2", F.col("y") + 1).join(near, ["image_id", "y2"]).filter(touch).select("image_id", "y", "a", "y2", "a2")
    links = _cut(down.unionByName(down.select("image_id", F.col("y2").alias("y"), F.col("a2").alias("a"), F.col("y").alias("y2"), F.col("a").alias("a2"))))
    reached = frontier = _cut(runs.filter("out").select("image_id", "y", "a"))
    while True:
        step = frontier.join(links, ["image_id", "y", "a"]).select("image_id", F.col("y2").alias("y"), F.col("a2").alias("a")).distinct()
        frontier = _cut(step.join(reached, ["image_id", "y", "a"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = _cut(reached.unionByName(frontier))
    outside = reached.join(runs, ["image_id", "y", "a"]).select("image_id", "y", F.explode(F.sequence("a", "z")).alias("x"), F.lit(1).alias("out"))
    return px.select("image_id", "y", "x", "roi").join(outside, ["image_id", "y", "x"], "left").withColumn("filled", F.when(F.col("out") == 1, 0).otherwise(1)).drop("out")


def _cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that driver and executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return df.checkpoint()


@lru_cache(maxsize=2)
def _session(model_path: str):
    """One inference session for each worker process, or the failure to get one, which is kept, too."""
    try:
        import onnxruntime

        return onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
    except Exception as e:  # noqa: BLE001  whatever the runtime raises is told in the result
        return e


def segment(rgb: np.ndarray, method: str = "classical", percentile: float = 90.0, dilate_px: int = 5, model_path: str | None = None, user_mask: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """The mask of a raster and how it was made; a network that can't run falls back to the classical method and says so."""
    meta = {"method": method, "fallback": False, "fallback_reason": None}
    if method == "mask-dir":
        if user_mask is None:
            raise ValueError("no mask for this image")
        mask = (user_mask > 127).astype(np.uint8)
        return (imaging.resize(mask, *rgb.shape[:2], "nearest") if mask.shape != rgb.shape[:2] else mask), meta
    saliency = None
    if method == "u2net":
        try:
            session = _session(model_path or "")
            if isinstance(session, Exception):
                raise session
            out = session.run(None, {session.get_inputs()[0].name: imaging.network_input(rgb)})[0]
            saliency = imaging.network_output(out, *rgb.shape[:2])
        except Exception as e:  # noqa: BLE001  whatever the runtime raises is told in the result
            meta |= {"method": "classical", "fallback": True, "fallback_reason": f"{type(e).__name__}: {e}"[:200]}
    if saliency is None:
        saliency = imaging.spectral_saliency(rgb)
    return imaging.mask_stages(saliency, percentile, dilate_px)["dilate"], meta
