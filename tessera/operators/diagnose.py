"""Reports on how masks and tiles come about: saliency percentiles, coverage and exactness by stage, overlays. One image is one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions import codec, imaging, tiles
from .compress import decode_raster
from .roi import segment

PERCENTILES = (10, 50, 90)


def _by_image(images: DataFrame, make: Callable[[np.ndarray], list[dict]], schema: str) -> DataFrame:
    """The rows that make() returns for the raster of each image(path, height, width, data), with its path; an image that fails has a row with only error."""
    names = ["path", *[c.split()[0] for c in schema.split(", ")], "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                try:
                    found = make(np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3))
                except Exception as e:  # noqa: BLE001  one bad image must not end the report
                    found = [{"error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame({c: pd.Series([r.get(c) if c != "path" else row.path for r in found], dtype=object) for c in names})

    return images.select("path", "height", "width", "data").mapInPandas(run, f"path string, {schema}, error string")


def saliency_percentiles(images: DataFrame) -> DataFrame:
    """Least, largest, mean, deviation and percentiles of each image's saliency, and the share of it at the 90th percentile or above."""

    def make(rgb):
        s = imaging.spectral_saliency(rgb)
        p = {f"p{q}": float(np.percentile(s, q)) for q in PERCENTILES}
        return [{"low": float(s.min()), "high": float(s.max()), "mean": float(s.mean()), "deviation": float(s.std()), **p, "share": float((s >= p["p90"]).mean())}]

    return _by_image(images, make, "low double, high double, mean double, deviation double, " + ", ".join(f"p{q} double" for q in PERCENTILES) + ", share double")


def mask_stages(images: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """For each image and stage (threshold, close, fill, dilate): its place, the share of the image that the mask covers, and the mask (one byte a pixel)."""

    def make(rgb):
        found = imaging.mask_stages(imaging.spectral_saliency(rgb), config.percentile, config.dilate_px)
        return [{"place": i, "stage": name, "coverage": float(m.mean()), "mask": m.tobytes()} for i, (name, m) in enumerate(found.items(), 1)]

    return _by_image(images, make, "place int, stage string, coverage double, mask binary")


def stage_exactness(images: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """For each image and stage (quadtree, tiling, decode): the number of rectangles and whether all pixels of the region of interest come back."""

    def make(rgb):
        mask, _ = segment(rgb, config.roi_method, config.percentile, config.dilate_px, config.model_path)
        inside = mask.astype(bool)
        leaf = tiles.leaves(rgb, mask, config.threshold, config.criterion, config.min_block)
        tile = tiles.merge(leaf, rgb, config.tolerance, config.max_merge_run, config.compat)
        records = codec.serialize_tiles(np.stack([tile[c] for c in "xywh"], axis=1), tile["value"], tile["is_roi"])
        payload, _ = codec.encode_payload(records, rgb.size, config.target_cr)
        painted = {name: (len(a["x"]), tiles.paint(*(a[c] for c in "xywh"), a["value"], *mask.shape)) for name, a in (("quadtree", leaf), ("tiling", tile))}
        painted["decode"] = len(tile["x"]), decode_raster(payload, *mask.shape)
        return [{"place": i, "stage": s, "rectangles": n, "roi_exact": bool((back[inside] == rgb[inside]).all())} for i, (s, (n, back)) in enumerate(painted.items(), 1)]

    return _by_image(images, make, "place int, stage string, rectangles long, roi_exact boolean")


def overlays(images: DataFrame, config: PipelineConfig = PipelineConfig(), strength: float = 0.45) -> DataFrame:
    """Each image (RGB bytes) with the region of interest tinted red, and with the outlines of its tiles drawn in."""

    def make(rgb):
        mask, _ = segment(rgb, config.roi_method, config.percentile, config.dilate_px, config.model_path)
        tinted = np.where(mask[..., None] > 0, rgb * (1 - strength) + np.array([255, 0, 0]) * strength, rgb).astype(np.uint8)
        tile = tiles.merge(tiles.leaves(rgb, mask, config.threshold, config.criterion, config.min_block), rgb, config.tolerance, config.max_merge_run, config.compat)
        grid = rgb.copy()
        for x, y, w, h in zip(*(tile[c].tolist() for c in "xywh"), strict=True):
            grid[y, x : x + w] = grid[y : y + h, x] = (0, 255, 0)
        return [{"height": rgb.shape[0], "width": rgb.shape[1], "tinted": tinted.tobytes(), "grid": grid.tobytes()}]

    return _by_image(images, make, "height int, width int, tinted binary, grid binary")


def progress(rows: DataFrame, name: str = "name") -> DataFrame:
    """rows with index, their place from 1 in the order of name; rows of one range of names are counted apart and ranges' sizes are added up."""
    parts = max(8, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(parts, name).withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = ranged.withColumn("index", F.row_number().over(Window.partitionBy("part").orderBy(name)))
    return own.join(F.broadcast(sizes), "part").withColumn("index", (F.col("index") + F.coalesce("before", F.lit(0))).cast("long")).drop("part", "before")


def write_batch_csv(results: DataFrame, path: str) -> None:
    """The batch report of compressed images: name, roi_coverage, final_cr, total_time_s."""
    results.filter("error is null").select("name", "roi_coverage", "final_cr", "total_time_s").write.mode("overwrite").option("header", True).csv(path)
