"""Search: needles in all entries, pages of hits, and many needles at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions.text import parse_terms, trim
from slotloom.plans.schema import DEFAULT, Registry

ORDER = ("file_key", "entry_index", "id")


def needles(keyword: str, terms: Sequence[str]) -> list[str]:
    """What is looked for, in the order in which it is reported: distinct terms, then the keyword."""
    keyword = keyword.strip(" \n\r\t\x0b\x00")
    return list(dict.fromkeys([*(t for t in terms if t), *([keyword] if keyword else [])]))


def search(entries: DataFrame, keyword: str = "", terms: Sequence[str] = ()) -> DataFrame:
    """id, file_key, entry_index, content, matched_terms of entries that hold any needle, case aside.

    Needles are literal.  Contents are trimmed, blank ones never match, and without needles nothing does.
    """
    rows = entries.select("id", "file_key", "entry_index", trim(F.col("content")).alias("content")).where("content <> ''")
    wanted = needles(keyword, terms)
    if not wanted:
        return rows.withColumn("matched_terms", F.array().cast("array<string>")).where(F.lit(False))
    lowered = F.lower("content")
    hits = F.array(*[F.when(lowered.contains(F.lower(F.lit(n))), F.lit(n)) for n in wanted])
    return rows.withColumn("matched_terms", F.array_compact(hits)).where(F.size("matched_terms") > 0)


def selected_terms(term_lists: DataFrame, chosen: DataFrame) -> DataFrame:
    """list_index, term of those choices (list_index, choice) that are exact members of their list."""
    terms = term_lists.select("list_index", F.explode(parse_terms(F.col("text"))).alias("term"))
    asked = chosen.select("list_index", trim(F.col("choice")).alias("term")).where("term <> ''").distinct()
    return asked.join(terms, ["list_index", "term"], "left_semi")


def page_count(hits: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """total, pages: at least one page."""
    pages = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(registry.page_size))).cast("long")
    return hits.agg(F.count(F.lit(1)).alias("total"), pages.alias("pages"))


def page(hits: DataFrame, number: int, registry: Registry = DEFAULT) -> DataFrame:
    """One page of hits in order, the number clamped to the pages there are.

    One top-k pass: if the number is beyond the last page, the rows up to it are all hits, and their count tells
    which page is the last.
    """
    size, number = registry.page_size, max(1, number)
    top = hits.orderBy(*ORDER).limit(number * size)
    if number == 1:
        return top
    placed = top.withColumn("__at", F.row_number().over(Window.orderBy(*ORDER))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    real = F.least(F.lit(number), F.ceil(F.col("__n") / F.lit(size)))
    return placed.where(F.ceil(F.col("__at") / F.lit(size)) == real).select(*hits.columns)


#: Places of a slot whose hits are counted together when a page is sought by rank.
RANK_RUN = 65_536


def page_by_rank(hits: DataFrame, number: int, registry: Registry = DEFAULT) -> DataFrame:
    """One page of hits in order, as ``page``, at a cost that does not grow with its number.

    Hits are counted by runs of places; the counts' running sum tells which runs the page lies in, and only hits of those
    (two, where runs hold a page's hits or more) are put in order.  The runs become predicates on the scan.
    """
    size, number = registry.page_size, max(1, number)
    run = F.floor(F.col("entry_index") / RANK_RUN)
    counted = hits.groupBy("file_key", run.alias("run")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("file_key", "run")
    placed = counted.select("*", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    start = (F.least(F.lit(number), F.ceil(F.col("total") / size)) - 1) * size
    held = placed.where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start)).select("file_key", "run", "before", start.alias("start"))
    own = held.orderBy("before").collect()  # no more runs than a page has rows
    if not own:
        return hits.limit(0)
    near = F.lit(False)
    for r in own:
        near = near | ((F.col("file_key") == r.file_key) & (F.col("entry_index") >= r.run * RANK_RUN) & (F.col("entry_index") < (r.run + 1) * RANK_RUN))
    skip = own[0].start - own[0].before
    return hits.where(near).orderBy(*ORDER).limit(skip + size).offset(skip)


#: Needles up to which each text is searched for all of them, and their bytes; needles of one expression.
FEW_NEEDLES = 512
FEW_BYTES = 4 << 20
_AT_ONCE = 64
#: Characters of the piece by which many needles are looked up; shorter needles are their own piece.
GRAM = 6


def search_many(rows: DataFrame, wanted: DataFrame, row_id: str, text: str, needle_id: str, needle: str) -> DataFrame:
    """row_id, needle_id of every text that holds a needle, case aside.

    A word that has blanks on both sides in a needle is a word of every text that holds the needle, so needles with such
    words meet texts by one of them: the one that the fewest needles share, and of those the longest.  ``contains``
    decides.  Few needles filter the texts' words where they are; of many, hashes of words meet in a join,
    and candidates get their texts back by row_id (which must tell rows apart).  Of needles without such a word,
    few are predicates on each text, and many are looked up by pieces of ``GRAM`` characters (or fewer, where they are
    shorter).  Null and empty needles match nothing.
    """
    asked = wanted.select(F.col(needle_id).alias("__n"), F.lower(F.col(needle)).alias("__needle")).where("__needle <> ''")
    kept = rows.select(F.col(row_id).alias("__r"), F.lower(F.col(text)).alias("__text"))
    words = F.split("__needle", " ")
    inner = F.when(F.size(words) > 2, F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")).otherwise(F.array())
    asked = asked.withColumn("__inner", F.array_distinct(inner))
    own = asked.limit(FEW_NEEDLES + 1).collect()
    if len(own) <= FEW_NEEDLES and sum(len(r["__needle"].encode()) for r in own) <= FEW_BYTES:
        found = _few(kept, asked, own)
    else:
        whole = F.size("__inner") > 0
        found = _by_words(kept, asked.where(whole)).unionByName(_looked_up(kept, asked.where(~whole).drop("__inner")))
    return found.distinct().select(F.col("__r").alias(row_id), F.col("__n").alias(needle_id))


def _few(kept: DataFrame, asked: DataFrame, own: list) -> DataFrame:
    shared = Counter(w for r in own for w in r["__inner"])
    chosen = [(r["__n"], r["__needle"], min(r["__inner"], key=lambda w: (shared[w], -len(w), w))) for r in own if r["__inner"]]
    listed = sorted({word for _, _, word in chosen})
    met = F.array_intersect(F.split("__text", " "), F.array(*map(F.lit, listed))) if listed else F.array().cast("array<string>")
    kind = asked.schema["__n"].dataType
    needles_ = kept.sparkSession.createDataFrame(chosen, f"__n {kind.simpleString()}, __needle string, __word string")
    hits = kept.select("__r", "__text", F.explode(met).alias("__word")).join(F.broadcast(needles_), "__word")
    found = hits.where(F.contains("__text", "__needle")).select("__r", "__n")
    others = [F.when(F.contains("__text", F.lit(r["__needle"])), F.lit(r["__n"]).cast(kind)) for r in own if not r["__inner"]]
    if others:
        groups = [F.array_compact(F.array(*others[k : k + _AT_ONCE])) for k in range(0, len(others), _AT_ONCE)]
        found = found.unionByName(kept.select("__r", F.explode(F.concat(*groups)).alias("__n")))
    return found


def _by_words(kept: DataFrame, asked: DataFrame) -> DataFrame:
    own = asked.select("__n", "__needle", F.explode("__inner").alias("__word"))
    shared = own.groupBy("__word").agg(F.count(F.lit(1)).alias("__shared"))
    first = Window.partitionBy("__n", "__needle").orderBy("__shared", F.desc(F.length("__word")), "__word")
    chosen = own.join(shared, "__word").withColumn("__at", F.row_number().over(first)).where("__at = 1")
    chosen = chosen.select("__n", "__needle", F.xxhash64("__word").alias("__hash"))
    hashed = F.array_distinct(F.transform(F.split("__text", " "), lambda w: F.xxhash64(w)))
    near = kept.select("__r", F.explode(hashed).alias("__hash")).join(chosen, "__hash").select("__r", "__n", "__needle").distinct()
    return kept.join(near, "__r").where(F.contains("__text", "__needle")).select("__r", "__n")


def _pieces(text: Column, size: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _looked_up(kept: DataFrame, asked: DataFrame) -> DataFrame:
    sizes = sorted(r[0] for r in asked.select(F.least(F.length("__needle"), F.lit(GRAM))).distinct().collect())  # GRAM at most
    found = None
    for size in sizes:
        own = asked.where(F.least(F.length("__needle"), F.lit(GRAM)) == size).select("*", F.explode(_pieces(F.col("__needle"), size)).alias("__gram"))
        shared = own.groupBy("__gram").agg(F.count(F.lit(1)).alias("__shared"))
        first = Window.partitionBy("__n", "__needle").orderBy("__shared", "__gram")
        chosen = own.join(shared, "__gram").withColumn("__at", F.row_number().over(first)).where("__at = 1")
        chosen = chosen.select("__n", "__needle", F.xxhash64("__gram").alias("__hash"))
        grams = F.transform(_pieces(F.col("__text"), size), lambda g: F.xxhash64(g))
        pieces = kept.where(F.length("__text") >= size).select("__r", F.explode(F.array_distinct(grams)).alias("__hash"))
        met = pieces.join(chosen, "__hash").select("__r", "__n", "__needle").distinct()
        hits = kept.join(met, "__r").where(F.contains("__text", "__needle")).select("__r", "__n")
        found = hits if found is None else found.unionByName(hits)
    return kept.select("__r").join(asked.select("__n"), F.lit(False)) if found is None else found
