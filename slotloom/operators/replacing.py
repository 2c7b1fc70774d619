"""Search and replace: previews with counts, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions.text import occurrences
from slotloom.operators.entries import apply_edits, of_slot
from slotloom.plans.schema import DEFAULT, Registry


def preview(entries: DataFrame, slot: str | None, find: str, replacement: str, registry: Registry = DEFAULT) -> DataFrame:
    """id, entry_index, original_content, preview_content, replacement_count of the rows that would change.

    ``find`` is literal and minds case; rows without it are left out.  An empty ``find`` has no rows.
    Without a slot, all slots are previewed.  The predicate on the raw column reaches the scan.
    """
    rows = of_slot(entries, slot, registry) if slot is not None else entries
    kept = rows.where((F.col("content") != "") & F.col("content").contains(find)) if find else rows.where(F.lit(False))
    return kept.select(
        "id", "entry_index", F.col("content").alias("original_content"),
        F.replace("content", F.lit(find), F.lit(replacement)).alias("preview_content"),
        (occurrences(F.col("content"), find) if find else F.lit(0).cast("long")).alias("replacement_count"),
    )


def apply(entries: DataFrame, slot: str | None, find: str, replacement: str, overrides: DataFrame | None = None, registry: Registry = DEFAULT) -> DataFrame:
    """Entries after a replacement; ``overrides`` (id, content) stand for what a user edited in the preview.

    Replacements that leave a blank text are not saved.
    """
    edits = preview(entries, slot, find, replacement, registry).select("id", F.col("preview_content").alias("content"))
    if overrides is not None:
        edits = edits.join(overrides.select("id"), "id", "left_anti").unionByName(overrides.select("id", "content"))
    return apply_edits(entries, edits)
