"""Inverted index of grams: which blocks of entries hold which three letters, and how many do.

A gram is three letters of a text in lower case.  The index names blocks of neighbouring ids, not single entries, which
keeps it smaller than the texts.  It is a filter: a block that it names may lack the gram by now, so edits only
add to it, deletions need not touch it, and what it leaves over is searched as it is.  Its rows lie in
buckets by a hash of the gram, ordered by gram, so a search reads the few files that its rarest grams are in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 3
#: Ids of a block, buckets, and grams by which a needle is looked up: its rarest ones.
BLOCK = 64
BUCKETS = 64
RAREST = 3
#: Blocks up to which the scan of entries is told their ids.
FEW_BLOCKS = 200


def grams(text: Column) -> Column:
    """Distinct grams of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{SIZE}}}))"), F.lit(1)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _block(row_id: Column) -> Column:
    return F.floor(row_id / BLOCK).cast("long")


def postings(entries: DataFrame, row_id: str = "id", text: str = "content") -> DataFrame:
    """bucket, gram, block of every block that holds a gram."""
    pairs = entries.select(_block(F.col(row_id)).alias("block"), F.explode(grams(F.col(text))).alias("gram")).distinct()
    return pairs.select(_bucket(F.col("gram")).alias("bucket"), "gram", "block")


def counts(found: DataFrame) -> DataFrame:
    """bucket, gram, n of postings: how many blocks they name for each gram."""
    return found.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))


def rarest(asked: DataFrame, numbers: DataFrame, key: str, needle: str, most: int = RAREST) -> DataFrame:
    """key, bucket, gram of the grams of each needle that the fewest blocks hold."""
    own = asked.select(key, F.explode(grams(F.col(needle))).alias("gram"))
    known = numbers.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "gram")
    placed = own.join(known, "gram", "left").withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    return placed.select(key, _bucket(F.col("gram")).alias("bucket"), "gram")


def blocks(chosen: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, block of the blocks that hold all chosen grams of a needle."""
    wanted = chosen.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("wanted"))
    met = chosen.join(found.select("gram", "block"), "gram").select(key, "gram", "block").distinct()  # an index that grew names blocks again
    named = met.groupBy(key, "block").agg(F.count(F.lit(1)).alias("n"))
    return named.join(wanted, (F.col(key) == F.col("of")) & (F.col("n") == F.col("wanted"))).select(key, "block")


def narrowed(entries: DataFrame, found: DataFrame, numbers: DataFrame, needles: Sequence[str]) -> DataFrame:
    """Entries of the blocks that can hold one of some needles; all, if a needle is shorter than a gram.

    The needles' rarest grams become predicates on the index, and few blocks become predicates on the entries.
    """
    spark = entries.sparkSession
    if not needles or any(len(n) < SIZE for n in needles):
        return entries
    asked = spark.createDataFrame(list(enumerate(needles)), "needle_id int, needle string")
    own = [r.gram for r in asked.select(F.explode(grams(F.col("needle"))).alias("gram")).distinct().collect()]
    buckets = [r.bucket for r in spark.createDataFrame([(g,) for g in own], "gram string").select(_bucket(F.col("gram")).alias("bucket")).distinct().collect()]
    near = numbers.where(F.col("bucket").isin(buckets) & F.col("gram").isin(own))
    chosen = rarest(asked, near, "needle_id", "needle").collect()  # some grams for each needle
    picked = found.where(F.col("bucket").isin(sorted({r.bucket for r in chosen})) & F.col("gram").isin(sorted({r.gram for r in chosen})))
    frame = spark.createDataFrame([(r.needle_id, r.gram) for r in chosen], "needle_id int, gram string")
    held = blocks(frame, picked, "needle_id").select("block").distinct()
    first = [r.block for r in held.limit(FEW_BLOCKS + 1).collect()]
    if len(first) > FEW_BLOCKS:
        return entries.join(held, _block(F.col("id")) == F.col("block"), "left_semi")
    near_ids = F.lit(False)
    for block in first:
        near_ids = near_ids | F.col("id").between(block * BLOCK, block * BLOCK + BLOCK - 1)
    return entries.where(near_ids)


def search_many(rows: DataFrame, found: DataFrame, numbers: DataFrame, wanted: DataFrame, row_id: str, text: str, needle_id: str, needle: str) -> DataFrame:
    """row_id, needle_id of every text that holds a needle, case aside, by way of the index of the texts.

    Needles shorter than a gram have none to be looked up by and are left to ``search.search_many``.
    """
    asked = wanted.select(F.col(needle_id).alias("__n"), F.lower(F.col(needle)).alias("__needle")).where(F.length("__needle") >= SIZE)
    chosen = rarest(asked, numbers, "__n", "__needle")
    near = blocks(chosen, found, "__n").join(asked, "__n").withColumnRenamed("block", "__block")
    texts = rows.select(F.col(row_id).alias("__r"), F.lower(F.col(text)).alias("__text"))
    held = texts.join(near, _block(F.col("__r")) == F.col("__block")).where(F.contains("__text", "__needle"))
    return held.select(F.col("__r").alias(row_id), F.col("__n").alias(needle_id)).distinct()
