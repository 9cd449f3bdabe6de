"""The query catalogue: each operator on the driver's tables, whole. Columns are named as in oracles.py."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig, resolve_mode
from ..functions import codec
from ..operators import compress, diagnose, quadtree, raster, roi, tiling, verify
from ..sources import archive, images
from .oracles import ORACLE_SQL

THRESHOLD = 12.0
#: The root's level of the fixture's rasters, which are 64 pixels wide and no higher.
ROOT = 6


def _long(e, name: str):
    return (F.col(e) if isinstance(e, str) else e).cast("long").alias(name)


def _px(spark, d) -> DataFrame:
    return raster.fixture(spark, d)


def _blocks(spark, d) -> DataFrame:
    return quadtree.block_pyramid(_px(spark, d), ROOT)


def _leaves(spark, d, criterion: str = "range") -> DataFrame:
    return quadtree.leaves(_px(spark, d), criterion, THRESHOLD, top=ROOT)


def _rows(spark, d) -> DataFrame:
    return tiling.merge_rows(_leaves(spark, d), THRESHOLD)


def _documents(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _entries(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), F.concat(F.lit("img_"), k, F.lit(".png")).alias("name"), F.lit(64).alias("width"), (48 + k % 17).cast("int").alias("height"), (100 + (k * 37) % 900).cast("long").alias("length"))


def _files(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    folder = F.when(k % 3 == 0, "/data/a/").when(k % 3 == 1, "/data/b.x/").otherwise("/data/")
    suffix = F.when(k % 7 == 0, ".GIF").when(k % 7 == 1, ".PNG").when(k % 7 == 2, ".jpeg").when(k % 7 == 3, "").when(k % 7 == 4, ".tar.webp").otherwise(".png")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), F.concat(folder, F.lit("pic_"), F.floor(k / 2).cast("string"), suffix).alias("path"), ((k * 13) % 11).alias("length"), (k % 17 != 5).alias("decodable"), F.when(k % 13 == 4, 16).otherwise(8).alias("bits"), F.when(k % 19 == 3, 1).when(k % 19 == 6, 4).otherwise(3).alias("channels"), F.when(k % 23 == 7, 4097).otherwise(64).alias("height"), F.lit(32).alias("width"))


def raster_summary(spark: SparkSession, d: str) -> DataFrame:
    return _px(spark, d).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_px"), _long(F.max("y") + 1, "height"), _long(F.count(F.lit(1)) * 3, "raw_bytes"), *[_long(F.sum(k), f"sum_{k}") for k in raster.CHANNELS], _long(F.sum("roi"), "n_roi"))


def raster_pad(spark, d):
    return raster.pad(_px(spark, d)).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_px"), _long(F.sum(F.col("r") * (F.col("y") + 1) + F.col("x")), "weighted"), _long(F.sum("roi"), "n_roi"))


def roi_coverage(spark, d):
    return roi.coverage(_px(spark, d)).select("image_id", F.round("coverage", 9).alias("coverage"), "n_roi")


def roi_percentile_threshold(spark, d):
    return roi.percentile_mask(_px(spark, d), "image_id", "r").groupBy("image_id").agg(F.round(F.max("t"), 6).alias("threshold"), _long(F.sum("mask"), "n_mask"))


def roi_minmax_normalize(spark, d):
    return roi.normalise(_px(spark, d), "image_id", "r").groupBy("image_id").agg(F.round(F.sum("scaled"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def roi_hole_fill(spark, d):
    px = _px(spark, d).select("image_id", "y", "x")
    d2, rad = F.expr("(x-32)*(x-32) + (y-24)*(y-24)"), F.expr("8 + image_id % 8")
    ring = px.withColumn("roi", ((d2 >= rad * rad) & (d2 <= (rad + 3) * (rad + 3))).cast("int"))
    return roi.fill_holes(ring).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_px"), _long(F.sum("roi"), "n_roi"), _long(F.sum("filled"), "n_filled"))


def block_stats_pyramid(spark, d):
    num = [F.col("n") * F.col(f"sq_{k}") - F.col(f"sum_{k}") * F.col(f"sum_{k}") for k in raster.CHANNELS]
    return _blocks(spark, d).groupBy("image_id", _long("level", "level")).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("n_px"), F.sum(F.col("sum_r") + 3 * F.col("sum_g") + 5 * F.col("sum_b")).alias("sums"), F.sum(F.col("sq_r") + F.col("sq_g") + F.col("sq_b")).alias("squares"), _long(F.sum("roi_any"), "roi_blocks"), F.max(F.greatest(*num)).alias("max_var_num"))


def block_range_pyramid(spark, d):
    return _blocks(spark, d).groupBy("image_id", _long("level", "level")).agg(_long(F.sum(quadtree.block_range()), "range_sum"), _long(F.max(quadtree.block_range()), "range_max"))


def _leaf_counts(leaf: DataFrame) -> DataFrame:
    return leaf.groupBy("image_id", _long("level", "level")).agg(F.count(F.lit(1)).alias("n_leaves"), _long(F.sum(F.col("w") * F.col("h")), "area"), _long(F.sum(F.col("is_roi").cast("int")), "n_roi"), F.sum("sum_r").alias("sum_r"))


def quadtree_leaves_range(spark, d):
    return _leaf_counts(_leaves(spark, d))


def quadtree_leaves_variance(spark, d):
    return _leaf_counts(_leaves(spark, d, "variance"))


def quadtree_morton_order(spark, d):
    from pyspark.sql import Window

    m = _leaves(spark, d).withColumn("code", quadtree.morton(bits=6))
    return m.select("image_id", _long("x", "x"), _long("y", "y"), _long("w", "w"), "code", _long(F.row_number().over(Window.partitionBy("image_id").orderBy("code")), "place"))


def quadtree_reconstruct_error(spark, d):
    return quadtree.reconstruction_error(_px(spark, d), _leaves(spark, d)).select("image_id", F.round("max_error", 6).alias("max_error"), "exact_roi", "n_px")


def background_variance(spark, d):
    return quadtree.background_variance(_px(spark, d)).select("image_id", F.round("variance", 5).alias("variance"))


def row_bands(spark, d):
    return tiling.row_bands(_leaves(spark, d)).groupBy("image_id", _long("y", "y"), _long("h", "h")).agg(F.count(F.lit(1)).alias("n_leaves"), _long(F.min("x"), "x_min"), _long(F.sum("w"), "w_sum"))


def band_islands(spark, d):
    return tiling.row_bands(_leaves(spark, d)).groupBy("image_id", _long("y", "y"), _long("h", "h"), _long("island", "island")).agg(_long(F.min("x"), "x_min"), _long(F.max(F.col("x") + F.col("w")), "x_max"), F.count(F.lit(1)).alias("n_leaves"))


def dp_row_merge(spark, d):
    return _rows(spark, d).groupBy("image_id", _long("y", "y"), _long("h", "h")).agg(_long(F.sum("merged_from"), "n_leaves"), F.count(F.lit(1)).alias("n_tiles"))


def dp_backtrack_tiles(spark, d):
    return _rows(spark, d).select("image_id", *[_long(c, c) for c in ("y", "h", "x", "w", "merged_from")], F.round("r", 6).alias("r"))


def tile_area_weighted_mean(spark, d):
    area = F.col("w") * F.col("h")
    return _rows(spark, d).groupBy("image_id").agg(*[F.round(F.sum(F.col(k) * area) / F.sum(area), 6).alias(k) for k in raster.CHANNELS])


def _row_tiles(spark, d) -> DataFrame:
    """Leaves and row tiles of each image, and its height."""
    leaf = _leaves(spark, d)
    n = leaf.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_leaves"), F.count_if("is_roi").alias("roi"), F.max(F.col("y") + F.col("h")).alias("height"))
    t = tiling.merge_rows(leaf, THRESHOLD).groupBy("image_id").agg(F.count(F.lit(1)).alias("t"))
    return n.join(t.hint("shuffle_hash"), "image_id", "left").withColumn("n_tiles", F.coalesce("t", F.lit(0)) + F.col("roi"))


def tile_reduction_ratio(spark, d):
    return _row_tiles(spark, d).select("image_id", "n_leaves", "n_tiles", F.round(1 - F.col("n_tiles") / F.col("n_leaves"), 9).alias("reduction"))


def tiles_paint_range_join(spark, d):
    return quadtree.paint(_rows(spark, d)).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_px"), _long(F.sum(F.col("pr") + 3 * F.col("pg") + 5 * F.col("pb")), "painted"))


def vertical_stacks(spark, d):
    return tiling.column_stacks(_rows(spark, d)).groupBy("image_id", _long("x", "x"), _long("w", "w"), _long("stack", "stack")).agg(_long(F.min("y"), "y_min"), _long(F.max(F.col("y") + F.col("h")), "y_max"), F.count(F.lit(1)).alias("n_tiles"))


def vertical_merge(spark, d):
    return tiling.tile(_leaves(spark, d), THRESHOLD).select("image_id", "x", "y", "w", "h", "is_roi", "merged_from", *[F.round(k, 6).alias(k) for k in raster.CHANNELS])


def tile_wire_size(spark, d):
    size = F.col("n_tiles") * codec.RECORD.itemsize
    cr = F.col("height") * raster.WIDTH * 3 / F.greatest(size, F.lit(1))
    return _row_tiles(spark, d).select("image_id", _long(size, "record_bytes"), F.round(cr, 9).alias("structural_cr"), (cr >= 4).alias("target_met"))


def byte_histogram(spark, d):
    """Counts of the texts' UTF-8 bytes, all 256 values."""

    def count(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw or b"", np.uint8), minlength=256)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["byte", "n"])

    raw = _documents(spark, d).select(F.encode("text", "UTF-8").alias("raw"))
    return raw.mapInArrow(count, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def _per_text(spark, d, fn, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, *fn((t or "").encode())) for k, t in zip(pdf["doc_id"], pdf["text"], strict=True)], columns=[c.split()[0] for c in schema.split(", ")])

    return _documents(spark, d).select("doc_id", "text").mapInPandas(run, schema)


def huffman_size(spark, d):
    return _per_text(spark, d, lambda raw: (len(raw), len(codec.huffman_encode(raw))), "doc_id long, n_bytes long, encoded_bytes long")


def huffman_roundtrip(spark, d):
    return _per_text(spark, d, lambda raw: (len(raw), codec.huffman_decode(codec.huffman_encode(raw)) == raw), "doc_id long, n_bytes long, same boolean")


def _image_rows(spark, d) -> DataFrame:
    """The fixture's rasters as one row an image: path, height, width, data."""
    px = _px(spark, d)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        return pd.DataFrame({"path": [f"/fixture/img_{pdf['image_id'].iloc[0]}.png"], "height": [h], "width": [w], "data": [pdf[["r", "g", "b"]].to_numpy("uint8").tobytes()]})

    return px.groupBy("image_id").applyInPandas(gather, "path string, height int, width int, data binary")


def conditional_codec_choice(spark, d):
    r = compress.compress_images(_image_rows(spark, d), PipelineConfig(target_cr=8.0))
    return r.select("name", "huffman_used", F.round("structural_cr", 6).alias("structural_cr"), F.round("final_cr", 6).alias("final_cr"), "reason", "roi_exact")


def archive_roundtrip(spark, d):
    """Compresses all rasters, packs each payload with its entry of the index, reads it back and verifies it. Files are written by sources.archive; here every image is an archive of
    its own, so that executors need no file of the driver's."""
    originals = _image_rows(spark, d)

    def one(batches):
        for pdf in batches:
            found = [archive.unpack(archive.pack([(r.name, r.width, r.height, r.payload)]))[0] for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(found, columns=["name", "width", "height", "payload"])

    entries = compress.compress_images(originals).filter("error is null").select("name", "width", "height", "payload").mapInPandas(one, "name string, width int, height int, payload binary")
    return compress.verify_images(entries, originals).select("image", "status", "roi_pixels", "roi_exact_pixels", "background_bound_ok", "reason")


def archive_offsets(spark, d):
    return verify.offsets(_entries(spark, d), "id").select("name", "length", _long("offset", "offset"))


def archive_index_overlap(spark, d):
    k = F.col("id")
    moved = F.col("offset") - F.when(k % 10 == 4, 5).otherwise(0) + F.when(k % 50 == 9, 1_000_000_000).otherwise(0)
    rows = verify.offsets(_entries(spark, d), "id").withColumn("offset", moved).withColumn("width", F.when(k % 20 == 3, 0).otherwise(F.col("width")))
    return verify.structure_errors(rows)


def verify_missing_extra(spark, d):
    e = _entries(spark, d).select("id", "name")
    indexed = e.filter("id % 9 <> 2").select("name").unionByName(e.filter("id % 11 = 3").select(F.concat(F.lit("extra_"), F.col("name")).alias("name")))
    return verify.missing(e, indexed).withColumn("problem", F.lit("missing")).unionByName(verify.extra(e, indexed).withColumn("problem", F.lit("extra")))


def verify_duplicates(spark, d):
    return verify.duplicates(_files(spark, d).select(images.basename(F.col("path")).alias("name")))


def _verified(spark, d) -> DataFrame:
    """Originals against rasters painted from the leaves' stored colours, rounded half to even."""
    both = _px(spark, d).join(quadtree.paint(_leaves(spark, d)).hint("merge"), ["image_id", "y", "x"])
    err = F.greatest(*[F.abs(F.col(k) - F.bround(F.col(f"v{k}"), 0)) for k in raster.CHANNELS])
    in_roi = F.col("roi") == 1
    return both.withColumn("err", err).groupBy("image_id").agg(F.count_if(in_roi).alias("roi_pixels"), F.count_if(in_roi & (F.col("err") == 0)).alias("roi_exact_pixels"), F.count_if(~in_roi).alias("background_pixels"), F.max(F.when(~in_roi, F.col("err"))).alias("max_background_error"), F.bool_and(F.col("err") == 0).alias("full_exact"))


def verify_pixel_compare(spark, d):
    return _verified(spark, d).withColumn("max_background_error", F.round("max_background_error", 6))


def verify_summary(spark, d):
    """From leaves alone: rounding keeps the order of values, so a leaf's least and largest bound the error of its stored colour, and no pixel is joined."""
    worst = F.greatest(*[F.greatest(F.abs(F.col(f"max_{k}") - F.bround(F.col(k), 0)), F.abs(F.col(f"min_{k}") - F.bround(F.col(k), 0))) for k in raster.CHANNELS])
    area, inside = (F.col("w") * F.col("h")).cast("long"), F.col("is_roi")
    leaf = _leaves(spark, d).withColumn("err", worst)
    of = lambda c: F.coalesce(F.sum(F.when(c, area)), F.lit(0))
    rows = leaf.groupBy("image_id").agg(of(inside).alias("roi_pixels"), of(inside & (F.col("err") == 0)).alias("roi_exact_pixels"), F.max(F.when(~inside, F.col("err"))).alias("max_background_error"))
    ok = (F.col("roi_exact_pixels") == F.col("roi_pixels")) & (F.col("max_background_error") <= THRESHOLD + 1e-6)
    s = verify.summary(rows.withColumn("status", F.when(ok, "PASS").otherwise("FAIL")))
    return s.withColumns({c: F.round(c, 6) for c in ("roi_exact_percent", "max_background_error")})


def saliency_report(spark, d):
    return _named(diagnose.saliency_percentiles(_image_rows(spark, d)))


def mask_stage_coverage(spark, d):
    return _named(diagnose.mask_stages(_image_rows(spark, d)).drop("mask"))


def stage_exactness(spark, d):
    return _named(diagnose.stage_exactness(_image_rows(spark, d)))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", images.basename(F.col("path"))).withColumnRenamed("path", "name")


def progress_index(spark, d):
    return diagnose.progress(_entries(spark, d).select("name"))


def tall_quadtree_leaves(spark, d):
    """Leaves of plain rasters with the fixture's regions of interest, four of them one above the other, so that blocks of more than 64 pixels stop, too."""
    k = F.col("image_id")
    some = (k % 4 == 3) & (k % 8 < 4)
    tall = _px(spark, d).filter("y < 48").select(F.floor(k / 4).alias("image_id"), (F.col("y") + 48 * (k % 4)).cast("int").alias("y"), "x", *[F.lit(100).alias(c) for c in raster.CHANNELS], F.when(some, F.col("roi")).otherwise(0).alias("roi"))
    return quadtree.leaves(tall, "range", THRESHOLD).groupBy("image_id", _long("level", "level")).agg(F.count(F.lit(1)).alias("n_leaves"), _long(F.sum(F.col("w") * F.col("h")), "area"))


def stem_match_mask(spark, d):
    f = _files(spark, d).withColumn("stem", images.stem(F.col("path")))
    masks = f.filter("id % 2 = 1").groupBy("stem").agg(F.min("path").alias("mask"))
    return f.filter("id % 2 = 0").join(masks, "stem", "left").select("id", "stem", "mask")


def reject_cascade(spark, d):
    c = F.col
    reason = images.reject_reason(images.extension(c("path")), c("length"), c("decodable"), c("bits"), c("channels"), c("height"), c("width"))
    return _files(spark, d).groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def mode_switch_compare(spark, d):
    px = _px(spark, d)
    count = lambda mode, name: quadtree.leaves(px, resolve_mode(mode), THRESHOLD, top=ROOT).groupBy("image_id").agg(F.count(F.lit(1)).alias(name))
    return count("strict", "n_range").join(count("fast", "n_variance").hint("shuffle_hash"), "image_id")


def problem_subset(spark, d):
    found, lost = images.subset(_entries(spark, d).select(F.concat(F.lit("/x/"), F.col("name")).alias("path")), ["img_1.png", "img_5.png", "img_9.png", "nowhere.png"])
    return found.select(images.basename(F.col("path")).alias("name"), F.lit(True).alias("found")).unionByName(lost.select("name", F.lit(False).alias("found")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every raster of the fixture compressed and checked: leaves, tiles, compression ratio, exactness of the ROI."""
    return compress.compress_images(_image_rows(spark, d)).select("name", "width", "height", "quadtree_leaves", "dp_tiles", F.round("structural_cr", 6).alias("structural_cr"), F.round("final_cr", 6).alias("final_cr"), "roi_exact")


QUERIES = {f.__name__: f for f in (
    raster_summary, raster_pad, roi_coverage, roi_percentile_threshold, roi_minmax_normalize, roi_hole_fill, block_stats_pyramid, block_range_pyramid, quadtree_leaves_range, quadtree_leaves_variance,
    quadtree_morton_order, quadtree_reconstruct_error, background_variance, row_bands, band_islands, dp_row_merge, dp_backtrack_tiles, tile_area_weighted_mean, tile_reduction_ratio, tiles_paint_range_join,
    vertical_stacks, vertical_merge, tile_wire_size, byte_histogram, huffman_size, huffman_roundtrip, conditional_codec_choice, archive_offsets, archive_index_overlap, archive_roundtrip, verify_missing_extra,
    verify_duplicates, verify_pixel_compare, verify_summary, stem_match_mask, reject_cascade, mode_switch_compare, problem_subset, flagship, saliency_report, mask_stage_coverage, stage_exactness, progress_index, tall_quadtree_leaves,
)}

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
