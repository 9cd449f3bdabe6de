"""Rasters as rows of pixels: px(image_id, y, x, r, g, b, roi)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")
WIDTH = 64


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic raster per supplier, in whole numbers: an object on a background, every tenth image flat and every tenth noise.

    Images are dealt before their pixels are made, so an image's pixels are in one task and no pixel is dealt again to be grouped by image.
    """
    key, parts = F.col("s_suppkey"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dim = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.alias("image_id"), (key % 10).cast("int").alias("kind"), (48 + key % 17).cast("int").alias("height"), (8 + key % 8).cast("int").alias("rad"))
    rows = dim.repartition(parts, "image_id").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    d2 = (F.col("x") - 32) * (F.col("x") - 32) + (F.col("y") - 24) * (F.col("y") - 24)
    rows = rows.withColumn("d2", d2).withColumn("nz", ((F.col("x") * 31 + F.col("y") * 17 + F.col("image_id") * 7) % 5 - 2).cast("int")).withColumn("rnd", (F.expr("(x*x*7 + y*y*13 + x*y*(image_id%31+1)) % 256")).cast("int"))
    inside = (F.col("kind") > 1) & (F.col("d2") <= F.col("rad") * F.col("rad"))

    def channel(factor: int, on: int, off: int) -> Column:
        return F.when(F.col("kind") == 0, 100).when(F.col("kind") == 1, (F.col("rnd") * factor) % 256).otherwise(F.col("nz") + F.when(inside, on).otherwise(off)).cast("int")

    roi = (F.col("kind") > 1) & (F.col("d2") <= (F.col("rad") + 3) * (F.col("rad") + 3))
    return rows.select("image_id", "y", "x", channel(1, 240, 40).alias("r"), channel(3, 220, 90).alias("g"), channel(5, 20, 160).alias("b"), roi.cast("int").alias("roi"))


def sizes(px: DataFrame) -> DataFrame:
    """(image_id, height, width, side): side is the power of two that holds the image."""
    s = px.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    longest = F.greatest("height", "width")
    power = F.call_function("shiftleft", F.lit(1), F.ceil(F.log2(longest)).cast("int"))
    return s.withColumn("side", F.when(power < longest, power * 2).when(F.floor(power / 2) >= longest, F.floor(power / 2).cast("int")).otherwise(power).cast("int"))


def pad(px: DataFrame, size: DataFrame | None = None, cell: int | None = None) -> DataFrame:
    """px grown to a square of its side: the last row and then the last column are repeated, outside pixels aren't ROI.

    Edge pixels are exploded into their copies, so no pixel is looked up. Spark takes exploded rows for as few as those they come from and would broadcast the pixels, so sizes are looked up in a
    shuffled join, of which they are the small side; its result is dealt by image. With `cell` it is dealt by blocks of that level, (cy, cx), which are added, before copies within a block are made.
    """
    s = sizes(px) if size is None else size
    p = px.join(F.broadcast(s) if size is not None else s.hint("shuffle_hash"), "image_id")
    copies = lambda n: F.explode(F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0))))
    at_edge = lambda at, n, end: F.when(F.col(at) == F.col(n) - 1, end).otherwise(1)
    y, x, y_end, x_end = F.col("y"), F.col("x"), F.col("side"), F.col("side")
    if cell is not None:
        of, last = lambda at: F.shiftright(at, cell), F.shiftright(F.col("side") - 1, cell)
        more = at_edge("x", "width", last - of("x") + 1)
        p = p.withColumn("copy", copies(at_edge("y", "height", last - of("y") + 1) * more))
        p = p.withColumn("cy", of("y") + F.floor(F.col("copy") / more).cast("int")).withColumn("cx", of("x") + F.col("copy") % more).drop("copy").repartition("image_id", "cy", "cx")
        (y, y_end), (x, x_end) = ((F.greatest(F.col(at), F.shiftleft(c, cell)), F.least(F.col("side"), F.shiftleft(F.col(c) + 1, cell))) for at, c in (("y", "cy"), ("x", "cx")))
    more = at_edge("x", "width", x_end - x)
    p = p.withColumn("copy", copies(at_edge("y", "height", y_end - y) * more))
    p = p.withColumn("y2", y + F.floor(F.col("copy") / more).cast("int")).withColumn("x2", x + F.col("copy") % more)
    own = (F.col("y2") < F.col("height")) & (F.col("x2") < F.col("width"))
    return p.select("image_id", F.col("y2").alias("y"), F.col("x2").alias("x"), *CHANNELS, F.when(own, F.col("roi")).otherwise(0).alias("roi"), "height", "width", "side", *(["cy", "cx"] if cell is not None else []))
