"""Text files: upload source, and the names and contents of downloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotloom.functions.text import clean_file_name, download_name, trim
from slotloom.operators.entries import compose
from slotloom.plans.schema import DEFAULT, Registry

EXTENSIONS = ("txt", "md")


def has_valid_extension(name: Column) -> Column:
    """Whether a file name, cleaned, ends in .txt or .md, case aside."""
    last = F.element_at(F.split(name, "/"), -1)
    return F.lower(F.regexp_extract(clean_file_name(last), r"\.([^.]*)$", 1)).isin(*EXTENSIONS)


def read_uploads(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """name, content of each .txt or .md file, read whole: line ends and byte-order marks stay."""
    whole = spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("content"))
    return whole.where(has_valid_extension(F.col("name")))


def download_names(spark: SparkSession, registry: Registry = DEFAULT) -> DataFrame:
    """file_key, file_name of every registered slot; a name that an earlier slot has gets that slot's number after it."""
    named = registry.frame(spark).withColumn("name", download_name(F.coalesce("label", "file_key")))
    at = F.row_number().over(Window.partitionBy("name").orderBy("ordinal"))
    again = F.concat(F.regexp_replace("name", r"\.txt$", ""), F.lit("-"), at.cast("string"), F.lit(".txt"))
    return named.select("file_key", F.when(at == 1, F.col("name")).otherwise(again).alias("file_name"))


def downloads(entries: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """file_key, file_name, byte_length, content of every slot's download."""
    names = download_names(entries.sparkSession, registry)
    joined = compose(entries, registry).join(F.broadcast(names), "file_key", "left")
    return joined.select("file_key", "file_name", F.octet_length("content").cast("long").alias("byte_length"), "content")


def manifest(entries: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """As ``downloads`` without the contents: lengths are summed, and no text is composed."""
    size = F.octet_length(trim(F.col("content"))).cast("long")
    sums = entries.select("file_key", size.alias("n")).where("n > 0").groupBy("file_key").agg((F.sum(F.col("n") + 2) - 2).alias("n"))
    joined = download_names(entries.sparkSession, registry).join(sums, "file_key", "left")
    return joined.select("file_key", "file_name", F.coalesce("n", F.lit(0)).cast("long").alias("byte_length"))
