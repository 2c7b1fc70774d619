"""Term lists: parsing, normal form, equivalence and saving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions.text import is_blank, normal_terms, parse_terms
from slotloom.plans.schema import DEFAULT, Registry


def all_lists(term_lists: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """list_index, label, text of every list; missing ones are empty."""
    known = term_lists.sparkSession.createDataFrame(list(enumerate(registry.term_lists, 1)), "list_index int, label string")
    joined = known.join(term_lists.select("list_index", "text"), "list_index", "left")
    return joined.select("list_index", "label", F.coalesce("text", F.lit("")).alias("text"))


def parsed(term_lists: DataFrame, key: str = "list_index", text: str = "text") -> DataFrame:
    """key, position (from 1), term."""
    exploded = term_lists.select(key, F.posexplode(parse_terms(F.col(text))).alias("at", "term"))
    return exploded.select(key, (F.col("at") + 1).cast("long").alias("position"), "term")


def saved(term_lists: DataFrame) -> DataFrame:
    """The lists in the form in which they are stored."""
    return term_lists.withColumn("text", normal_terms(F.col("text")))


def equivalent(pairs: DataFrame, left: str, right: str, *group: str) -> DataFrame:
    """equivalent: whether all lists of a group have equal normal forms."""
    same = F.bool_and(normal_terms(F.coalesce(left, F.lit(""))) == normal_terms(F.coalesce(right, F.lit(""))))
    return pairs.groupBy(*group).agg(same.alias("equivalent"))


def empty(term_lists: DataFrame, *group: str, text: str = "text") -> DataFrame:
    """is_empty: whether all lists of a group are blank."""
    return term_lists.groupBy(*group).agg(F.bool_and(is_blank(F.coalesce(text, F.lit("")))).alias("is_empty"))
