"""Merging background leaves into tiles: bands, islands, the row dynamic program and the greedy column merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as T
from .raster import CHANNELS

TILE = "image_id long, x int, y int, w int, h int, r double, g double, b double, is_roi boolean, merged_from int"


def row_bands(leaf: DataFrame) -> DataFrame:
    """Background leaves with their place in the band (y, h) and its island: a run without gaps."""
    band = Window.partitionBy("image_id", "y", "h").orderBy("x")
    gap = F.when(F.lag(F.col("x") + F.col("w")).over(band) == F.col("x"), 0).otherwise(1)
    return leaf.filter(~F.col("is_roi")).withColumn("gap", gap).withColumn("place", F.row_number().over(band)).withColumn("island", F.sum("gap").over(band.rowsBetween(Window.unboundedPreceding, 0)))


def _arrays(pdf: pd.DataFrame) -> dict:
    three = lambda f: np.stack([pdf[f(k)].to_numpy() for k in CHANNELS], axis=1)
    return {c: pdf[c].to_numpy() for c in ("x", "y", "w", "h", "is_roi")} | {"value": three(lambda k: k).astype(float), "low": three(lambda k: f"min_{k}"), "high": three(lambda k: f"max_{k}")}


def merge_rows(leaf: DataFrame, tolerance: float = 12.0, max_run: int = 64, compat: bool = False) -> DataFrame:
    """Row tiles of background leaves: (image_id, x, y, w, h, r, g, b, is_roi, merged_from).

    Leaves are dealt by image and sorted by band; a batch's bands, of however many images, are cut in one call of the kernel, and its last band waits for the next batch.
    """
    keys = ["image_id", "y", "h"]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _arrays(pdf)
        row = T.merge_rows(tuple(pdf[c].to_numpy() for c in keys), a["x"], a["w"], a["h"], a["value"], a["low"], a["high"], tolerance, max_run, compat)
        out = pdf.iloc[row["first"]][["image_id", "x", "y", "h"]].assign(w=row["w"], is_roi=False, merged_from=row["n"])
        return out.assign(**{k: row["value"][:, i] for i, k in enumerate(CHANNELS)})[["image_id", "x", "y", "w", "h", *CHANNELS, "is_roi", "merged_from"]]

    def merge(batches):
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = int(T.bands(*(held[c].to_numpy() for c in keys))[-2])
            if last:
                yield cut(held.iloc[:last])
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None:
            yield cut(held)

    stats = [f"{s}_{k}" for k in CHANNELS for s in ("min", "max")]
    rows = leaf.filter(~F.col("is_roi")).select(*keys, "x", "w", "is_roi", *CHANNELS, *stats)
    return rows.repartition("image_id").sortWithinPartitions(*keys, "x").mapInPandas(merge, TILE)


def tile(leaf: DataFrame, tolerance: float = 12.0, max_run: int = 64, compat: bool = False) -> DataFrame:
    """All tiles of each image: ROI leaves unchanged, background merged in rows and then in columns."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        t = T.merge(_arrays(pdf), None, tolerance, max_run, compat)
        out = pd.DataFrame({c: t[c] for c in ("x", "y", "w", "h")} | {k: t["value"][:, i] for i, k in enumerate(CHANNELS)} | {"is_roi": t["is_roi"], "merged_from": t["merged_from"]})
        out.insert(0, "image_id", pdf["image_id"].iloc[0])
        return out

    return leaf.groupBy("image_id").applyInPandas(merge, TILE)


merge_boundary_tiles = tile


def column_stacks(rows: DataFrame) -> DataFrame:
    """Row tiles with their stack: those with the same x and width that touch from top to bottom."""
    column = Window.partitionBy("image_id", "x", "w").orderBy("y")
    gap = F.when(F.lag(F.col("y") + F.col("h")).over(column) == F.col("y"), 0).otherwise(1)
    return rows.filter(~F.col("is_roi")).withColumn("gap", gap).withColumn("stack", F.sum("gap").over(column.rowsBetween(Window.unboundedPreceding, 0)))
