"""Sharding by rendezvous hashing: every shard scores a record's key, the highest weighted score takes the record.

A shard's score for a key doesn't depend on the other shards, so one more shard takes rows only into itself, and its share
only. Slots are dealt in two levels: a shard's rows fall into hash buckets that are numbered independently; counts of the
buckets (shards x buckets numbers, a bound that doesn't grow with the rows) give each bucket its first slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a slot bucket should hold, and the most buckets a shard has: 40 shards then broadcast at most 164,000 small rows.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 4096


def _score(key: Column, shard: Column, weight: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 .. len(weights) - 1) of a key: the smallest -ln(u)/weight; ties go to the smaller shard.

    A null key is a key like any other. Shards with weight 0 take nothing.
    """
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in live])
    return F.array_min(F.transform(shards, lambda s: F.struct(_score(key, s["shard"], s["weight"]).alias("score"), s["shard"].alias("shard"))))["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, grown: float | None = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row into a weighted shard by its key.

    Returns the key, size (UTF-8 bytes of text plus 16), text_crc32, law ("key"), shard, slot (gapless from 0 in each shard)
    and grown_shard (with one more shard of weight `grown`; null if that is None). Null text counts as empty; rows with equal
    keys share a shard; a null key is a key; repeated rows each get a slot; an empty table gives no rows.
    """
    wide = list(weights) + ([grown] if grown is not None else [])
    rows = docs.select(
        F.col(key).alias("k"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
    ).select(
        "*",
        rendezvous(F.col("k"), weights).alias("shard"),
        (rendezvous(F.col("k"), wide) if grown is not None else F.lit(None).cast("int")).alias("grown_shard"),
    )
    n = docs.count()
    buckets = max(16, min(MOST_BUCKETS, -(-n // (BUCKET_ROWS * len(weights)))))
    rows = rows.withColumn("b", F.pmod(F.xxhash64(F.col("k"), F.col("crc"), F.lit("slot")), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("n")).select("shard", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "b").orderBy("k", "crc", "size")
    return (
        rows.withColumn("r", F.row_number().over(inside))
        .join(F.broadcast(first), ["shard", "b"])
        .select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("first") + F.col("r") - 1).alias("slot"), F.col("grown_shard").cast("int"))
    )
