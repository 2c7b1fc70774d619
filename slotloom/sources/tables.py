"""The engine's tables, derived from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.plans.schema import DEFAULT


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slot_of(number: Column) -> Column:
    keys = F.array(*map(F.lit, DEFAULT.keys))
    return F.element_at(keys, (number % len(DEFAULT.keys)).cast("int") + 1)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as entries: id, file_key, entry_index, content; document n is entry n / 5 + 1 of slot n mod 5."""
    n = F.col("doc_id")
    return table(spark, folder, "documents").select(
        (n + 1).alias("id"), slot_of(n).alias("file_key"), (F.floor(n / 5) + 1).alias("entry_index"), F.coalesce("text", F.lit("")).alias("content")
    )


def widened(text: Column) -> Column:
    """A text whose lines stand apart as entries."""
    return F.replace(text, F.lit("\n"), F.lit("\n \t\n"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as slots: file_key, entry_index, id, content."""
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file_key"), F.col("turn").alias("entry_index"), F.col("turn").alias("id"), F.col("text").alias("content")
    )


def part_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as one term list per brand: list_index (the brand), text."""
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    term = F.when(F.col("p_partkey") % 3 == 0, F.upper(name)).otherwise(name)
    parts = table(spark, folder, "part").select("p_brand", "p_partkey", term.alias("term"))
    joined = F.expr("listagg(term, ', ') WITHIN GROUP (ORDER BY p_partkey)")
    return parts.groupBy(F.col("p_brand").alias("list_index")).agg(joined.alias("text"))


def edits(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as edits: good documents get a new text, others a blank one."""
    good = F.concat(F.lit(" edited "), F.col("doc_id").cast("string"), F.lit("\n\nsecond "))
    return table(spark, folder, "labels").select((F.col("doc_id") + 1).alias("id"), F.when(F.col("quality") == 1, good).otherwise(F.lit(" \t ")).alias("content"))


def doomed(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as ids to delete: toxic documents, with repeats and ids that do not exist."""
    ids = table(spark, folder, "labels").where("toxic = 1").select((F.col("doc_id") + 1).alias("id"))
    return ids.unionByName(ids).unionByName(ids.select((-F.col("id")).alias("id")))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as candidates for revisions: file_key (the user), seq, content, saved_at."""
    return as_log(table(spark, folder, "events"))


def as_log(events: DataFrame) -> DataFrame:
    ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("file_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"), ts.alias("saved_at"))
