"""Digests of slots' entries: equal for equal entries in equal order, without composing a text.

A digest is merged from the hashes of single entries with their places, in any order and partition by partition.
Places come from counts of runs, as in renumbering, so a slot of any size spreads out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions.text import split_entries
from slotloom.operators.chunks import enclosed
from slotloom.operators.entries import RUN


def _half(hashed: Column, begin: int) -> Column:
    return F.conv(F.substring(hashed, begin, 15), 16, 10).cast("long")


def parts(rows: DataFrame) -> DataFrame:
    """file_key, place (from 0), part: what splitting the composed text of each slot gives, without composing it."""
    split = enclosed(rows).select("file_key", "entry_index", "id", split_entries(F.col("text")).alias("parts"))
    # the parts of an entry follow one another: a part's place is that of its entry among all, and its own
    run = F.floor(F.col("entry_index") / RUN)
    own = split.withColumn("n_parts", F.size("parts").cast("long")).withColumn("run", run)
    sums = own.groupBy(F.col("file_key").alias("of"), F.col("run").alias("of_run")).agg(F.sum("n_parts").alias("n"))
    before = sums.select("of", "of_run", (F.sum("n").over(Window.partitionBy("of").orderBy("of_run")) - F.col("n")).alias("before"))
    within = F.sum("n_parts").over(Window.partitionBy("file_key", "run").orderBy("entry_index", "id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_parts")
    joined = own.withColumn("inside", within).join(before, F.col("file_key").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run")))
    start = F.col("before") + F.col("inside")
    return joined.select("file_key", start.alias("start"), F.posexplode("parts").alias("within", "part")).select("file_key", (F.col("start") + F.col("within")).alias("place"), "part")


def digest(rows: DataFrame) -> DataFrame:
    """file_key, n, low, high: number and 120-bit digest of the entries of each slot that has any but blank ones.

    An entry counts as what splitting its text gives, so a text saved whole and its entries agree.
    """
    return merged(parts(rows))


def of_texts(texts: DataFrame) -> DataFrame:
    """As ``digest`` for texts (file_key, content) that are given whole."""
    return merged(texts.select("file_key", F.posexplode(split_entries(F.col("content"))).alias("place", "part")))


def merged(parts: DataFrame) -> DataFrame:
    """file_key, n, low, high of parts (file_key, place, part)."""
    hashed = parts.select("file_key", F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("part"))).alias("h"))
    return hashed.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(_half(F.col("h"), 1)).alias("low"), F.bit_xor(_half(F.col("h"), 16)).alias("high"))


def equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """file_key, equivalent of every slot that either side has: whether their digests (``digest``, ``of_texts``) agree."""
    other = right.select(F.col("file_key").alias("of"), F.struct("n", "low", "high").alias("b"))
    both = left.select("file_key", F.struct("n", "low", "high").alias("a")).join(other, F.col("file_key") == F.col("of"), "full")
    return both.select(F.coalesce("file_key", "of").alias("file_key"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equivalent"))
