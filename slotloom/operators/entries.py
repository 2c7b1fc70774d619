"""Entries: scans, composition, and the transforms that yield a new state of the table.

Every function takes and returns DataFrames and works on all slots at once.  New entries get no id here;
the store assigns ids from its high-water mark.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotloom.functions.text import lenient_int, slot_key, split_entries, trim
from slotloom.plans.schema import DEFAULT, Registry

ROW = ("id", "file_key", "entry_index", "content")
ORDER = ("entry_index", "id")


def scan(entries: DataFrame) -> DataFrame:
    """All entries in their total order."""
    return entries.select(*ROW).orderBy("file_key", *ORDER)


def of_slot(entries: DataFrame, key: str, registry: Registry = DEFAULT) -> DataFrame:
    """Entries of one slot in order; the key is normalised, and its predicate reaches the scan."""
    return entries.where(F.col("file_key") == _normal(key, registry)).select(*ROW).orderBy(*ORDER)


def _normal(key: str, registry: Registry) -> str:
    clean = "".join(c for c in key.lower() if c.isascii() and (c.isalnum() or c in "_-"))
    return clean if clean in registry.keys else registry.default_key


def counts(entries: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """file_key, entry_count of every registered slot; rows with blank content count."""
    per_slot = entries.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))
    slots = registry.frame(entries.sparkSession)
    return slots.join(per_slot, "file_key", "left").select("file_key", F.coalesce("n", F.lit(0)).cast("long").alias("entry_count"))


def compose_groups(rows: DataFrame, key: str) -> DataFrame:
    """key, content: trimmed non-blank contents in order, a blank line between each two.

    ``rows`` has entry_index, id and content.  Rows are reduced to what is joined before they are dealt.
    """
    kept = rows.select(key, *ORDER, trim(F.col("content")).alias("c")).where("c <> ''")
    joined = F.expr("listagg(c, '\n\n') WITHIN GROUP (ORDER BY entry_index, id)")
    return kept.groupBy(key).agg(joined.alias("content"))


def compose(entries: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """The text of every registered slot; a slot without entries has the empty text."""
    texts = compose_groups(entries, "file_key")
    slots = registry.frame(entries.sparkSession).select("file_key")
    return slots.join(texts, "file_key", "left").select("file_key", F.coalesce("content", F.lit("")).alias("content"))


def id_frame(spark: SparkSession, ids: Iterable) -> DataFrame:
    """Ids as given by a client: cast leniently, positive ones once each."""
    given = spark.createDataFrame([(str(i),) for i in ids], "given string")
    return given.select(lenient_int(F.col("given")).alias("id")).where("id > 0").distinct()


def slots_of(entries: DataFrame, ids: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """Distinct slots that own any of ``ids`` (id: any type of number or text)."""
    wanted = ids.select(lenient_int(F.col("id").cast("string")).alias("id")).where("id > 0").distinct()
    owned = entries.select("id", "file_key").join(wanted, "id", "left_semi")
    return owned.select(slot_key(F.col("file_key"), registry).alias("file_key")).distinct()


def with_entries(texts: DataFrame, key: str = "file_key", content: str = "content") -> DataFrame:
    """key, entry_index (from 1), content: the entries of whole texts."""
    split = texts.select(key, F.posexplode(split_entries(F.col(content))).alias("at", "content"))
    return split.select(key, (F.col("at") + 1).cast("long").alias("entry_index"), "content")


def replace_slots(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """file_key, entry_index, content after the slots in ``texts`` (file_key, content) are saved whole.

    Blank texts empty their slot.  A slot that is saved loses all rows it had; others keep theirs.
    """
    others = entries.join(texts.select("file_key").distinct(), "file_key", "left_anti").select("file_key", "entry_index", "content")
    return others.unionByName(with_entries(texts))


def accepted_edits(edits: DataFrame) -> DataFrame:
    """Edits (id, content) that a save accepts: trimmed, not blank, id of 1 or more."""
    clean = edits.select(lenient_int(F.col("id").cast("string")).alias("id"), trim(F.col("content")).alias("content"))
    return clean.where("id >= 1 AND content <> ''")


def apply_edits(entries: DataFrame, edits: DataFrame, now: Column | None = None) -> DataFrame:
    """Entries with accepted edits in place; one row stays one row, even with blank lines in its text.

    Of several edits of one id the greatest text counts (the client sends one).  With ``now``, edited
    rows get that time.
    """
    new = accepted_edits(edits).groupBy("id").agg(F.max("content").alias("new_content"))
    joined = entries.join(new, "id", "left")
    columns = {"content": F.coalesce("new_content", "content")}
    if now is not None:
        columns["updated_at"] = F.when(F.col("new_content").isNotNull(), now).otherwise(F.col("updated_at"))
    return joined.withColumns(columns).select(*entries.columns)


def saved_count(edits: DataFrame) -> DataFrame:
    """saved_count: accepted edits, whether or not their id exists."""
    return accepted_edits(edits).agg(F.count(F.lit(1)).alias("saved_count"))


def deleted_count(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """deleted_count: entries that exist among ``ids``; repeated and unknown ids do not count."""
    return entries.join(ids.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted_count"))


#: Places of a slot that are numbered in one task.
RUN = 1_024


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with entry_index from 1 without gaps per slot.

    Runs of places are numbered apart and start where the counts of the runs before them end, so a slot
    of any size spreads over the cluster.
    """
    run = F.floor(F.col("entry_index") / RUN)
    placed = rows.withColumn("__run", run)
    counted = placed.groupBy(F.col("file_key").alias("__key"), F.col("__run").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__of")) - F.col("__n")
    starts = counted.select("__key", "__of", before.alias("__start"))
    within = F.row_number().over(Window.partitionBy("file_key", "__run").orderBy(*ORDER))
    joined = placed.withColumn("__at", within).join(starts, (F.col("file_key") == F.col("__key")) & (F.col("__run") == F.col("__of")))
    return joined.withColumn("entry_index", (F.col("__start") + F.col("__at")).cast("long")).select(*rows.columns)


def resequence(entries: DataFrame, slots: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Entries numbered from 1 without gaps in every slot, or in ``slots`` (file_key) only.

    With ``now``, every row of a touched slot gets that time, moved or not.
    """
    stamped = (lambda df: df.withColumn("updated_at", now).select(*entries.columns)) if now is not None else (lambda df: df)
    if slots is None:
        return stamped(_numbered(entries))
    keys = F.broadcast(slots.select("file_key").distinct())  # dealing entries by slot would put each slot in one task
    touched = stamped(_numbered(entries.join(keys, "file_key", "left_semi").select(*entries.columns)))
    return touched.unionByName(entries.join(keys, "file_key", "left_anti").select(*entries.columns))


def delete(entries: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """Entries without ``ids``; the slots that lost any are numbered anew."""
    gone = ids.select("id").distinct()
    touched = entries.join(gone, "id", "left_semi").select("file_key").distinct()
    return resequence(entries.join(gone, "id", "left_anti"), touched, now)


def duplicates(entries: DataFrame) -> DataFrame:
    """Places that more than one entry claims; empty in a sound table."""
    return entries.groupBy("file_key", "entry_index").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
