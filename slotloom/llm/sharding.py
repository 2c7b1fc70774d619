"""Sharding by rendezvous hashing of stable record keys over weighted shards; DataFrame functions only.

Every shard draws a score for every key; the key goes to the best score.  A further shard can only win
keys for itself, so growing from n to n + 1 shards moves about 1 / (n + 1) of the records and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.llm.shared import stored

#: Rows that one bucket of the numbering holds, about.
BUCKET_ROWS = 20_000


def _hash52(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of a key: the greatest of -weight / ln(u), u hashed from key and shard.

    Null keys share one key.  Of equal scores the smallest shard wins.  Equal weights compare the hashes
    themselves, which orders the shards alike.
    """
    named = F.coalesce(key.cast("string"), F.lit("null"))
    drawn = [_hash52(F.concat(named, F.lit(f"/{shard}"))) for shard in range(len(weights))]
    if len(set(weights)) > 1:
        drawn = [-F.lit(float(w)) / F.ln((h.cast("double") + 0.5) / F.lit(float(1 << 52))) for h, w in zip(drawn, weights, strict=True)]
    scores = F.array(*drawn)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def shard_records(docs: DataFrame, weights: Sequence[float] = (1.0,) * 24, new_weight: float = 1.0) -> DataFrame:
    """Per record: doc_id, size, text_crc32, shard, slot within the shard, and the shard once one is added.

    ``size`` is the UTF-8 length of the text (null: none) plus 8.  Slots are gapless from 0, in the order of
    a hash of id and text, so they do not depend on partitioning.  They are numbered in buckets of the hash
    whose starts come from counts per shard and bucket: no task holds a whole shard.  Repeated rows each
    get a slot; an empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = stored(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .withColumn("shard", rendezvous(F.col("doc_id"), weights))
        .withColumn("grown_shard", _grown(F.col("doc_id"), F.col("shard"), weights, new_weight))
        .withColumn("place", _hash52(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_crc32").cast("string")))),
        "shards",
    )
    buckets = max(1, -(-rows.count() // (BUCKET_ROWS * len(weights))))
    placed = rows.withColumn("bucket", F.floor(F.col("place").cast("double") / F.lit(float(1 << 52)) * buckets).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("shard").alias("of_shard"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(within))
    joined = numbered.join(starts, (F.col("shard") == F.col("of_shard")) & (F.col("bucket") == F.col("of_bucket")))
    return joined.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "grown_shard"
    )


def _grown(key: Column, shard: Column, weights: Sequence[float], new_weight: float) -> Column:
    return rendezvous(key, (*weights, new_weight))
