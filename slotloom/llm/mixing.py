"""Mixing sources to target weights.

Sizes are summed per source, a water-filling step turns weights into targets, and each document is
emitted ``floor(rate)`` times plus one Bernoulli copy whose coin is a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes of names, up to which the table of sources is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 2_000
BROADCAST_BYTES = 2 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of a seeded md5 of the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order, null last, get the weights of ``cycle`` in turn and share all sizes.  No
    target exceeds ``most`` times its source's size: sources are capped in the order of cap / weight until
    the next one fits below its cap.  The level (words per unit of weight) rises up to there and falls
    after it, so the level that all others share is the greatest that fits.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), turn + 1).cast("long")
    weighed = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ratio = F.col("cap").cast("double") / F.col("weight")
    rows = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    levels = (
        weighed.withColumn("ratio", ratio)
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("all_size") - F.col("capped")).cast("double") / (F.col("all_weight") - F.col("capped_weight")))
        .withColumn("common", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("ratio") <= F.col("common"), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def _with_copies(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, ...) with __size and __target of the source and __copies of the document."""
    own = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target"))
    measured = targets.agg(F.count(F.lit(1)), F.sum(F.octet_length("source"))).first()
    few = measured[0] <= BROADCAST_SOURCES and (measured[1] or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("__source")))
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(F.lit(0.0))
    extra = (coin(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("__copies", F.floor(rate) + extra)


def mixed_sizes(docs: DataFrame, seed: str = "mix", cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target of its source, copies and taken words.

    Null and empty texts have size 0.  A source of size 0 has rate 0.  Rows of one doc_id share one coin.
    An empty table gives no rows.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = stored(source_targets(sizes, cycle, most), "targets")
    return _with_copies(sizes, targets, seed).select(
        "doc_id", "source", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, seed: str = "mix", cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    ``docs`` needs doc_id, text and source; other columns pass through.  Texts of size 0 count no words but
    are taken at their source's rate.
    """
    sizes = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    targets = stored(source_targets(sizes, cycle, most), "targets")
    taken = _with_copies(docs, targets, seed).where("__copies > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return taken.withColumn("__copy", copy).select(*[F.col(f"`{c}`") for c in docs.columns])
