"""Schemas, the slot registry and the engine's limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, False) for name, kind in fields])


ENTRIES = _struct(
    ("id", T.LongType()), ("file_key", T.StringType()), ("entry_index", T.LongType()), ("content", T.StringType()), ("updated_at", T.TimestampNTZType())
)
LEGACY = _struct(("file_key", T.StringType()), ("content", T.StringType()))
TERM_LISTS = _struct(("list_index", T.IntegerType()), ("text", T.StringType()))
# what is known of a revision's text: its bytes, and number and digest of its entries; the text itself is in pieces
REVISIONS = _struct(
    ("file_key", T.StringType()), ("seq", T.LongType()), ("saved_at", T.LongType()), ("byte_length", T.LongType()), ("n", T.LongType()), ("low", T.LongType()), ("high", T.LongType())
)
REVISION_PIECES = _struct(("file_key", T.StringType()), ("seq", T.LongType()), ("piece", T.LongType()), ("content", T.StringType()))
LIST_REVISIONS = _struct(("seq", T.LongType()), ("lists", T.MapType(T.IntegerType(), T.StringType())), ("saved_at", T.LongType()))
UPLOADS = _struct(("file_key", T.StringType()), ("name", T.StringType()), ("place", T.TimestampType()), ("byte_length", T.LongType()), ("state", T.LongType()))
GRAMS = _struct(("bucket", T.IntegerType()), ("gram", T.StringType()), ("block", T.LongType()))
GRAM_COUNTS = _struct(("bucket", T.IntegerType()), ("gram", T.StringType()), ("n", T.LongType()))


@dataclass(frozen=True)
class Registry:
    """Slots in display order, labels of the term lists, and the limits of paging and history."""

    # fixed values: keys and labels that stored data and clients rely on
    slots: tuple[tuple[str, str], ...] = (
        ("lore", "Lore"),
        ("writing_style", "Writing Style"),
        ("reminders", "Reminders"),
        ("user_profile", "User Profile"),
        ("notes", "Notes"),
    )
    term_lists: tuple[str, ...] = ("Characters", "Organizations", "Locations")
    page_size: int = 25
    revision_limit: int = 3

    @property
    def keys(self) -> list[str]:
        return [key for key, _ in self.slots]

    @property
    def default_key(self) -> str:
        return self.slots[0][0]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The registry as a table (file_key, label, ordinal); a handful of rows."""
        return spark.createDataFrame([(k, label, i) for i, (k, label) in enumerate(self.slots)], "file_key string, label string, ordinal int")


DEFAULT = Registry()
