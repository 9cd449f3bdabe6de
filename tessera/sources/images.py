"""Image folders as DataFrames: accepted images and rejects are rows of one plan, parted by reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXTENSIONS, MAX_SIDE


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def reject_reason(ext: Column, length: Column, decodable: Column, bits: Column, channels: Column, height: Column, width: Column) -> Column:
    """The first check that fails; null for a valid image."""
    return (
        F.when(~ext.isin(*EXTENSIONS), "unsupported extension")
        .when(length <= 0, "unreadable or empty file")
        .when(~decodable, "not a decodable image")
        .when(bits != 8, "not 8-bit")
        .when(channels == 1, "grayscale")
        .when(channels != 3, "not 3 channels")
        .when(F.greatest(height, width) > MAX_SIDE, f"larger than {MAX_SIDE}")
        .when(F.least(height, width) < 1, "no pixels")
    )


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length) of the files below a folder, or of one file whatever its extension, in order of path components."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    single = path.rstrip("/").rpartition("/")[2]
    keep = extension(F.col("path")).isin(*EXTENSIONS) | (basename(F.col("path")) == single)
    return files.filter(keep).orderBy(F.split("path", "/"))


def png_bits(content: Column) -> Column:
    """The bit depth in a PNG header; 8 for other files."""
    png = F.substring(content, 1, 4) == F.unhex(F.lit("89504E47"))
    return F.when(png, F.conv(F.hex(F.substring(content, 25, 1)), 16, 10).cast("int")).otherwise(8)


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """image(path, height, width, original_bytes, data RGB, reason): decoded by Spark's image source, whose BGR pixels are turned; reason is null for valid images."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.col("length").alias("original_bytes"), png_bits(F.col("content")).alias("bits"))
    decoded = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", str(recursive).lower()).load(path).select(F.col("image.origin").alias("origin"), "image.height", "image.width", "image.nChannels", F.col("image.data").alias("bgr"))
    clean = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = raw.join(decoded, clean(raw["path"]) == clean(decoded["origin"]), "left").filter(extension(F.col("path")).isin(*EXTENSIONS))
    reason = reject_reason(extension(F.col("path")), F.col("original_bytes"), F.coalesce(F.col("height") >= 0, F.lit(False)), F.col("bits"), F.col("nChannels"), F.col("height"), F.col("width"))
    rows = both.select("path", "height", "width", "original_bytes", reason.alias("reason"), "bgr")

    def turn(batches):
        import numpy as np

        for pdf in batches:
            pdf["data"] = [None if r is not None or b is None else np.frombuffer(b, np.uint8).reshape(-1, 3)[:, ::-1].tobytes() for b, r in zip(pdf.pop("bgr"), pdf["reason"], strict=True)]
            yield pdf

    return rows.mapInPandas(turn, "path string, height int, width int, original_bytes long, reason string, data binary")


def with_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images with the mask (path, height, width, data: one gray channel) of the same stem; of several the first by path, none is null."""
    one = masks.groupBy(stem(F.col("path")).alias("stem")).agg(F.min_by(F.struct("data", "height", "width"), "path").alias("m"))
    return images.withColumn("stem", stem(F.col("path"))).join(one, "stem", "left").select(*images.columns, F.col("m.data").alias("mask"), F.col("m.height").alias("mask_height"), F.col("m.width").alias("mask_width"))


def inspect(scanned: DataFrame) -> DataFrame:
    ok = F.col("reason").isNull()
    raw = F.col("height").cast("long") * F.col("width") * 3
    return scanned.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"), F.coalesce(F.sum(F.when(ok, raw)), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum(F.when(ok, F.col("original_bytes"))), F.lit(0)).alias("disk_bytes"))


def subset(images: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The images of the given names, and the names that none has."""
    spark = images.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    have = images.withColumn("name", basename(F.col("path")))
    return have.filter(F.col("name").isin(*names)).drop("name"), wanted.join(have.select("name"), "name", "left_anti")
