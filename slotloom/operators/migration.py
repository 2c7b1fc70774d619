"""Migration of whole-document rows into entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions.text import is_blank
from slotloom.operators.entries import with_entries
from slotloom.plans.schema import DEFAULT, Registry


def migrate(legacy: DataFrame, entries: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """file_key, entry_index, content of the entries to insert.

    Slots that have entries, unknown keys and blank texts do not migrate.  Of several rows of a key the
    smallest text counts.
    """
    one = legacy.groupBy("file_key").agg(F.min("content").alias("content")).where(~is_blank(F.col("content")))
    known = one.where(F.col("file_key").isin(registry.keys))
    return with_entries(known.join(entries.select("file_key").distinct(), "file_key", "left_anti"))
