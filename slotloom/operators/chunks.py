"""Slots as ordered chunks of bytes, for texts that no single string should hold.

An entry's place in the composed text follows from the byte lengths before it.  Lengths are summed by runs of places, so
a slot of any size spreads out; entries are cut where a chunk ends, and a chunk joins its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions.text import trim
from slotloom.operators.entries import ORDER, RUN

#: Bytes of a chunk.
CHUNK_BYTES = 4 << 20


def _located(rows: DataFrame, key: str) -> DataFrame:
    """key, entry_index, id, b, at, total: trimmed texts of non-blank entries as bytes, where they begin if two bytes stand before each, and the bytes of all."""
    run = F.floor(F.col("entry_index") / RUN)
    kept = rows.select(F.col(key).alias("key"), *ORDER, run.alias("run"), F.encode(trim(F.col("content")), "utf-8").alias("b")).where(F.octet_length("b") > 0)
    size = F.octet_length("b").cast("long") + 2
    sums = kept.groupBy(F.col("key").alias("of"), F.col("run").alias("of_run")).agg(F.sum(size).alias("n"))
    starts = sums.select("of", "of_run", (F.sum("n").over(Window.partitionBy("of").orderBy("of_run")) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy("of")).alias("total"))
    within = F.sum(size).over(Window.partitionBy("key", "run").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)) - size
    joined = kept.withColumn("within", within).join(starts, F.col("key").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run")))
    return joined.select("key", *ORDER, "b", (F.col("start") + F.col("within")).alias("at"), "total")


def placed(rows: DataFrame, key: str = "file_key") -> DataFrame:
    """key, offset, bytes of each non-blank entry: its trimmed text, after the blank line that parts it from the one before."""
    at = F.col("at")  # the first entry has no bytes before it
    line = F.when(at == 0, F.col("b")).otherwise(F.concat(F.lit(b"\n\n"), F.col("b")))
    return _located(rows, key).select(F.col("key").alias(key), F.greatest(at - 2, F.lit(0)).alias("offset"), line.alias("bytes"))


def enclosed(rows: DataFrame) -> DataFrame:
    """file_key, entry_index, id, text of each non-blank entry: its trimmed text with the blank lines that part it from its neighbours."""
    line, size = F.lit("\n\n"), F.octet_length("b") + 2
    before = F.when(F.col("at") > 0, line).otherwise("")
    after = F.when(F.col("at") + size < F.col("total"), line).otherwise("")
    return _located(rows, "file_key").select(F.col("key").alias("file_key"), *ORDER, F.concat(before, F.col("b").cast("string"), after).alias("text"))


def pieces(rows: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """file_key, piece, content: the composed text of each slot in pieces of about ``limit`` bytes that are cut between entries.

    The pieces one after another are the text; only an entry of more bytes makes a longer piece.
    """
    cut = placed(rows).select("file_key", F.floor(F.col("offset") / limit).alias("piece"), "offset", "bytes")
    joined = cut.groupBy("file_key", "piece").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY offset)").alias("b"))
    return joined.select("file_key", "piece", F.col("b").cast("string").alias("content"))


def chunks(rows: DataFrame, key: str = "file_key", limit: int = CHUNK_BYTES) -> DataFrame:
    """key, chunk, offset, bytes: the composed text of each slot in chunks of ``limit`` bytes, the last one shorter.

    A chunk may end within a letter; the bytes of all chunks one after another are the text.
    """
    pieces = placed(rows, key)
    first, last = F.floor(F.col("offset") / limit), F.floor((F.col("offset") + F.octet_length("bytes") - 1) / limit)
    cut = pieces.select("*", F.explode(F.sequence(first, last)).alias("chunk"))
    begin = F.greatest(F.col("chunk") * limit - F.col("offset"), F.lit(0)).cast("int")
    size = F.least(F.lit(limit), (F.col("chunk") + 1) * limit - F.col("offset") - begin, F.octet_length("bytes") - begin).cast("int")
    cut = cut.select(key, "chunk", F.greatest("offset", F.col("chunk") * limit).alias("offset"), F.substring("bytes", begin + 1, size).alias("bytes"))
    joined = cut.groupBy(key, "chunk").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY offset)").alias("bytes"))
    return joined.select(key, "chunk", (F.col("chunk") * limit).alias("offset"), "bytes")
