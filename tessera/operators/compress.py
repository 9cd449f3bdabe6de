"""Compression and verification of whole images: one image is one row, and the unit of parallel work."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions import codec, tiles
from .roi import segment

RESULT = (
    "name string, width int, height int, mode string, roi_coverage double, roi_method_used string, quadtree_leaves long, dp_tiles long, dp_reduction double, "
    "huffman_used boolean, structural_cr double, final_cr double, archive_bytes long, max_background_error double, roi_exact boolean, "
    "roi_time_s double, quadtree_time_s double, dp_time_s double, serialize_time_s double, total_time_s double, payload binary, reason string, fallback_reason string, error string"
)
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def compress_raster(rgb: np.ndarray, config: PipelineConfig, user_mask: np.ndarray | None = None) -> dict:
    """All columns of RESULT that follow from a raster."""
    clock = [time.perf_counter()]
    mask, meta = segment(rgb, config.roi_method, config.percentile, config.dilate_px, config.model_path, user_mask)
    clock.append(time.perf_counter())
    leaf = tiles.leaves(rgb, mask, config.threshold, config.criterion, config.min_block)
    clock.append(time.perf_counter())
    tile = tiles.merge(leaf, rgb, config.tolerance, config.max_merge_run, config.compat)
    clock.append(time.perf_counter())
    geometry = np.stack([tile[c] for c in "xywh"], axis=1)
    payload, coded = codec.encode_payload(codec.serialize_tiles(geometry, tile["value"], tile["is_roi"]), rgb.size, config.target_cr)
    back = decode_raster(payload, *rgb.shape[:2])
    clock.append(time.perf_counter())
    inside = mask.astype(bool)
    # a leaf with background holds no ROI, so its least and largest values bound the error of its colour
    back_leaf = ~leaf["is_roi"]
    off = np.maximum(leaf["high"] - leaf["value"], leaf["value"] - leaf["low"])[back_leaf]
    spent = np.diff(clock)
    return {
        "width": rgb.shape[1], "height": rgb.shape[0], "mode": config.mode, "roi_coverage": float(mask.mean()), "roi_method_used": meta["method"], "quadtree_leaves": len(leaf["x"]),
        "dp_tiles": len(tile["x"]), "dp_reduction": 1 - len(tile["x"]) / len(leaf["x"]) if len(leaf["x"]) else 0.0, **{k: coded[k] for k in ("huffman_used", "structural_cr", "final_cr", "reason")},
        "archive_bytes": len(payload), "max_background_error": float(off.max()) if off.size else 0.0, "roi_exact": bool((back[inside] == rgb[inside]).all()),
        "roi_time_s": spent[0], "quadtree_time_s": spent[1], "dp_time_s": spent[2], "serialize_time_s": spent[3], "total_time_s": clock[-1] - clock[0], "payload": payload, "fallback_reason": meta["fallback_reason"], "error": None,
    }


def decode_raster(payload: bytes, height: int, width: int) -> np.ndarray:
    t = codec.decode_payload(payload)
    return tiles.paint(*(t[c].astype(np.int64) for c in "xywh"), np.stack([t[k] for k in "rgb"], axis=1), height, width)


def _nullable(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows whose missing values stay null instead of turning whole numbers into fractions."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})


def _raster(row, column: str) -> np.ndarray:
    return np.frombuffer(getattr(row, column), np.uint8).reshape(row.height, row.width, 3)


def compress_images(images: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """images(path, height, width, data: RGB bytes; optionally mask, mask_height, mask_width) to one row of RESULT each; an image that fails is a row with error."""
    masked = "mask" in images.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                name = row.path.rstrip("/").rpartition("/")[2]
                try:
                    user = np.frombuffer(row.mask, np.uint8).reshape(int(row.mask_height), int(row.mask_width)) if masked and row.mask is not None else None
                    out.append({"name": name} | compress_raster(_raster(row, "data"), config, user))
                except Exception as e:  # noqa: BLE001  one bad image must not end the batch
                    out.append({"name": name, "error": f"{type(e).__name__}: {e}"})
            yield _nullable(out, COLUMNS)

    columns = ["path", "height", "width", "data"] + ["mask", "mask_height", "mask_width"] * masked
    return images.select(*columns).mapInPandas(run, RESULT)


def batch_summary(results: DataFrame) -> DataFrame:
    """Images, errors, mean compression ratio and the share of images whose ROI is exact (0 for an empty batch)."""
    ok = F.col("error").isNull()
    return results.agg(F.count_if(ok).alias("images"), F.count_if(~ok).alias("errors"), F.coalesce(F.avg(F.when(ok, F.col("final_cr"))), F.lit(0.0)).alias("mean_cr"), F.coalesce(F.avg(F.when(ok, F.col("roi_exact").cast("int"))), F.lit(0.0)).alias("roi_exact_rate"))


VERIFY = (
    "image string, width int, height int, decode_ok boolean, dimensions_ok boolean, roi_pixels long, roi_exact_pixels long, roi_exact_percent double, roi_exact boolean, background_pixels long, "
    "max_background_error double, background_bound double, background_bound_ok boolean, full_image_exact boolean, roi_method_used string, status string, reason string"
)


def verify_images(entries: DataFrame, originals: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """One row for every archive entry (name, width, height, payload): decoded, segmented anew and compared with the original of its name (path, height, width, data)."""
    named = originals.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("height").alias("oh"), F.col("width").alias("ow"), "data")
    both = entries.select("name", "width", "height", "payload").join(named, "name", "left")
    names = [c.split()[0] for c in VERIFY.split(", ")]

    def one(row) -> dict:
        out = {"image": row.name, "width": row.width, "height": row.height, "decode_ok": False, "dimensions_ok": False, "roi_pixels": 0, "roi_exact_pixels": 0, "roi_exact_percent": 0.0, "roi_exact": False, "background_pixels": 0, "background_bound": float(config.threshold), "background_bound_ok": False, "full_image_exact": False, "status": "FAIL"}
        if row.data is None:
            return out | {"reason": "no original of this name"}
        try:
            back = decode_raster(row.payload, row.height, row.width)
        except codec.CodecError as e:
            return out | {"reason": str(e)}
        out["decode_ok"] = True
        if (row.oh, row.ow) != (row.height, row.width):
            return out | {"reason": "dimensions differ from the original"}
        rgb = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)
        mask, meta = segment(rgb, config.roi_method, config.percentile, config.dilate_px, config.model_path)
        inside, same = mask.astype(bool), (back == rgb).all(axis=2)
        off = np.abs(back.astype(int) - rgb.astype(int)).max(axis=2)[~inside]
        n, ok = int(inside.sum()), int((inside & same).sum())
        worst = float(off.max()) if off.size else None
        bound = config.mode != "strict" or worst is None or worst <= config.threshold + 1e-6
        fell = bool(meta["fallback"])
        reasons = [r for r, bad in (("ROI pixels differ", ok < n), ("background error above the bound", not bound), ("network fell back", fell)) if bad]
        return out | {"dimensions_ok": True, "roi_pixels": n, "roi_exact_pixels": ok, "roi_exact_percent": 100.0 * ok / n if n else 100.0, "roi_exact": ok == n, "background_pixels": int(off.size), "max_background_error": worst, "background_bound_ok": bound, "full_image_exact": bool(same.all()), "roi_method_used": meta["method"], "status": "FAIL" if reasons else "PASS", "reason": "; ".join(reasons)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _nullable([one(r) for r in pdf.itertuples(index=False)], names)

    return both.mapInPandas(run, VERIFY)
