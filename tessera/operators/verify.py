"""Relational checks of an archive's index against the originals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing(originals: DataFrame, entries: DataFrame) -> DataFrame:
    """Names of originals that the archive lacks."""
    return originals.select("name").distinct().join(entries, "name", "left_anti")


def extra(originals: DataFrame, entries: DataFrame) -> DataFrame:
    """Names in the archive without an original."""
    return missing(entries, originals)


def duplicates(names: DataFrame) -> DataFrame:
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _ranged(entries: DataFrame, order: str) -> DataFrame:
    """entries with their part of the order; parts are ranges, and a null is in the first one.

    The ranges' least values are drawn once and stand in the plan. A range exchange draws its bounds from a sample that differs from one use of it to the next, so an entry could be in one part for its
    offset and in another for the part's total.
    """
    parts = max(8, entries.sparkSession.sparkContext.defaultParallelism)
    drawn = entries.select(F.col(order).alias("v")).filter("v is not null").repartitionByRange(parts, "v").groupBy(F.spark_partition_id().alias("p")).agg(F.min("v").alias("v"))
    bounds = sorted(r.v for r in drawn.select("v").collect())[1:]
    part = F.lit(0)
    for v in bounds:
        part = part + F.coalesce((F.col(order) >= F.lit(v)).cast("int"), F.lit(0))
    return entries.withColumn("part", part)


def _before(parts: DataFrame, value: str, fold) -> DataFrame:
    """(part, before): `fold` of the value over all parts before each. Only one row a part goes through one task."""
    return parts.select("part", fold(value).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))


def offsets(entries: DataFrame, order: str) -> DataFrame:
    """entries(order, length, ...) with offset: the sum of the lengths before each; entries whose order is null come first.

    Lengths are added up in ranges of the order first; a part's total is looked up by its number.
    """
    ranged = _ranged(entries, order)
    base = _before(ranged.groupBy("part").agg(F.sum("length").alias("total")), "total", F.sum)
    inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return own.join(F.broadcast(base), "part").withColumn("offset", F.col("offset") + F.coalesce("before", F.lit(0))).drop("part", "before")


def structure_errors(entries: DataFrame) -> DataFrame:
    """(name, problem) of entries(name, width, height, offset, length): the first problem each has.

    Metadata are checked for nulls, negative values and dimensions, names for repeats. An entry overlaps if it begins before the largest end of those before it, leaves a gap if
    after it, and exceeds the payload area if it ends behind the sum of all lengths.
    """
    ranged = _ranged(entries.withColumn("end", F.col("offset") + F.col("length")), "offset")
    reached = _before(ranged.groupBy("part").agg(F.max("end").alias("end")), "end", F.max)
    inside = Window.partitionBy("part").orderBy("offset", "end").rowsBetween(Window.unboundedPreceding, -1)
    whole = entries.agg(F.sum("length").alias("whole"))
    rows = ranged.withColumn("own", F.max("end").over(inside)).join(F.broadcast(reached), "part").withColumn("reached", F.greatest("own", "before", F.lit(0))).join(F.broadcast(whole))
    rows = rows.join(entries.groupBy("name").agg(F.count(F.lit(1)).alias("same")).withColumnRenamed("name", "of"), F.col("name").eqNullSafe(F.col("of")))
    bad = F.coalesce((F.col("offset") < 0) | (F.col("length") < 0) | F.col("name").isNull(), F.lit(True))
    problem = (
        F.when(bad, "bad metadata").when(F.coalesce((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(True)), "no dimensions").when(F.col("same") > 1, "name occurs again")
        .when(F.col("reached") > F.col("offset"), "overlaps an entry before").when(F.col("end") > F.col("whole"), "exceeds the payload area").when(F.col("reached") < F.col("offset"), "gap before the entry")
    )
    return rows.select("name", problem.alias("problem")).filter("problem is not null")


def summary(rows: DataFrame) -> DataFrame:
    """Totals of verification rows; the ROI share is 100 where there are no ROI pixels."""
    percent = F.when(F.sum("roi_pixels") == 0, 100.0).otherwise(100.0 * F.sum("roi_exact_pixels") / F.sum("roi_pixels"))
    return rows.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("status") == "PASS").alias("passed"), F.sum("roi_pixels").alias("roi_pixels"), F.sum("roi_exact_pixels").alias("roi_exact_pixels"), F.coalesce(percent, F.lit(100.0)).alias("roi_exact_percent"), F.max("max_background_error").alias("max_background_error"), F.coalesce(F.bool_and(F.col("status") == "PASS"), F.lit(True)).alias("verdict"))


def write_reports(rows: DataFrame, path: str) -> None:
    """The per-image CSV report, and the JSON reports: one line an image, and the summary. Nothing is gathered in one task but the summary's row."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/verify_csv")
    rows.write.mode("overwrite").json(f"{path}/verify_json/images")
    summary(rows).write.mode("overwrite").json(f"{path}/verify_json/summary")
