"""Revision history: a bounded ring per slot that skips blank texts and repeats of its newest.

A text is refused only if it is equivalent to the newest one, so the newest accepted text and the last
non-blank candidate always have the same entries.  The ring of a whole log of candidates is then two
windows: compare with the one before, and number from the end.  Order is an explicit sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions.text import is_blank, normal_terms, split_entries
from slotloom.operators.entries import compose_groups, slots_of
from slotloom.plans.schema import DEFAULT, Registry


#: Sequence numbers of a log without keys that are compared in one task.
RUN = 65_536


def _ring(log: DataFrame, key: list[str], seq: str, identity: Column, limit: int) -> DataFrame:
    if not key:
        return _one_ring(log, seq, identity, limit)
    ahead = Window.partitionBy(*key).orderBy(seq)
    back = Window.partitionBy(*key).orderBy(F.desc(seq))
    marked = log.withColumn("__identity", identity).withColumn("__before", F.lag("__identity").over(ahead))
    new = marked.where(F.col("__before").isNull() | (F.col("__identity") != F.col("__before")))
    kept = new.withColumn("position", F.row_number().over(back).cast("long")).where(F.col("position") <= limit)
    return kept.drop("__identity", "__before")


def _one_ring(log: DataFrame, seq: str, identity: Column, limit: int) -> DataFrame:
    """The ring of a log that is all one: runs of it are compared apart, and each run's first text with the last before it."""
    marked = log.withColumn("__identity", identity).withColumn("__run", F.floor(F.col(seq) / RUN))
    lasts = marked.groupBy(F.col("__run").alias("__of")).agg(F.max_by("__identity", seq).alias("__last"))
    earlier = lasts.select("__of", F.lag("__last").over(Window.orderBy("__of")).alias("__earlier"))
    within = F.lag("__identity").over(Window.partitionBy("__run").orderBy(seq))
    joined = marked.withColumn("__before", within).join(earlier, F.col("__run") == F.col("__of"))
    before = F.coalesce("__before", "__earlier")
    newest = joined.where(before.isNull() | (F.col("__identity") != before)).orderBy(F.desc(seq)).limit(limit)
    return newest.select(*log.columns, F.row_number().over(Window.orderBy(F.desc(seq))).cast("long").alias("position"))


def ring(log: DataFrame, key: str = "file_key", seq: str = "seq", content: str = "content", registry: Registry = DEFAULT) -> DataFrame:
    """The revisions that a log of candidates leaves, with position 1 for the newest.

    Numbering from the end needs the last few rows of a key only, which Spark keeps per partition before
    it shuffles by key a second time; rows of one key meet, as their order decides.
    """
    return _ring(log.where(~is_blank(F.col(content))), [key], seq, split_entries(F.col(content)), registry.revision_limit)


def list_ring(log: DataFrame, lists: str = "lists", seq: str = "seq", group: str | None = None, registry: Registry = DEFAULT) -> DataFrame:
    """As ``ring`` for logs of all term lists (a map from index to text), which are stored in normal form."""
    texts = [normal_terms(F.coalesce(F.element_at(lists, i), F.lit(""))) for i in range(1, len(registry.term_lists) + 1)]
    entries = [x for i, t in enumerate(texts, 1) for x in (F.lit(i), t)]
    normal = log.withColumn(lists, F.create_map(*entries))
    some = F.exists(F.map_values(lists), lambda t: t != "")
    return _ring(normal.where(some), [group] if group else [], seq, F.array_join(F.map_values(lists), "\x00"), registry.revision_limit)


def stored_revisions(revisions: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """file_key, position, content, saved_at as read back: malformed rows are skipped, then the newest are taken."""
    sound = revisions.where(F.col("content").isNotNull() & F.col("saved_at").isNotNull())
    newest = Window.partitionBy("file_key").orderBy(F.desc("seq"))
    numbered = sound.withColumn("position", F.row_number().over(newest).cast("long"))
    return numbered.where(F.col("position") <= registry.revision_limit).select("file_key", "position", "content", "saved_at")


def stored_list_revisions(revisions: DataFrame, group: str | None = None, registry: Registry = DEFAULT) -> DataFrame:
    """position, text_1.., saved_at of the newest term-list revisions; missing lists are empty."""
    sound = revisions.where(F.col("lists").isNotNull() & F.col("saved_at").isNotNull())
    newest = Window.partitionBy(F.col(group) if group else F.lit(0)).orderBy(F.desc("seq"))
    if not group:  # a top-k of each partition before the rest meets in one window
        sound = sound.orderBy(F.desc("seq")).limit(registry.revision_limit)
    numbered = sound.withColumn("position", F.row_number().over(newest).cast("long")).where(F.col("position") <= registry.revision_limit)
    texts = [F.coalesce(F.element_at("lists", i), F.lit("")).alias(f"text_{i}") for i in range(1, len(registry.term_lists) + 1)]
    return numbered.select(*([group] if group else []), "position", *texts, "saved_at")


def restore(revisions: DataFrame, index: int, registry: Registry = DEFAULT) -> DataFrame:
    """file_key, content to be saved for each slot that has a revision ``index`` (from 0, the newest)."""
    found = stored_revisions(revisions, registry)
    return found.where(F.col("position") == index + 1).select("file_key", "content")


def candidates_for_ids(entries: DataFrame, ids: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """file_key, content that a change of ``ids`` puts up as candidates: the owning slots' texts, blank ones left out."""
    return compose_groups(rows_for_ids(entries, ids, registry), "file_key").where(~is_blank(F.col("content")))


def rows_for_ids(entries: DataFrame, ids: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """The entries behind ``candidates_for_ids``, for texts that no string should hold.

    Slots are registered ones at most; dealing the entries by them would put each slot in one task.
    """
    return entries.join(F.broadcast(slots_of(entries, ids, registry)), "file_key", "left_semi")


def display_time(saved_at: Column) -> Column:
    """Epoch seconds as text in the session's time zone."""
    return F.date_format(F.timestamp_seconds(saved_at), "yyyy-MM-dd HH:mm:ss")
