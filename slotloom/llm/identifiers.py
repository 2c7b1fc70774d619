"""Personal identifiers: exact patterns first, then bootstrapped extraction by context; DataFrame functions only.

The base spans are those of four fixed patterns.  They are the seeds of a graph: a mention has an instance (what is
written, in a normal form) and lexical patterns (the two words before it; the word before and the word after).
Further mentions have the loose shape of a kind but are no base spans: numbers that fail a checksum or run together,
addresses without a domain, local telephone numbers.  Each round scores a pattern by the share of its
distinct instances that are believed, then believes the instances of patterns with a high score.  Mentions
of believed instances become spans beside the base ones.  Scores are whole millionths, so they depend on no order.

Mentions leave the texts as soon as they are found; all that is shuffled later are their places and some words.
Regular expressions start at run starts only and do not backtrack over groups, so that long runs of one kind of
letter take time in proportion and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.llm.shared import stored

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
_MAIL = r"A-Za-z0-9._%+-"
#: The contract's patterns, in forms that Java's engine matches to the same spans in time in proportion.
BASE = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
_LETTERS = r"\p{L}\p{N}._%+-"
#: Loose shapes of each kind.
LOOSE = {
    "email": rf"(?:\G|(?<![{_LETTERS}]))[{_LETTERS}]++(?:@|\x20?[\[(]at[\])]\x20?)[\p{{L}}\p{{N}}.-]*[\p{{L}}\p{{N}}]",
    "ip": r"[0-9]{1,3}(?:[.,:-][0-9]{1,3}){3}",
    "card": r"[0-9]{12,}+",
    "phone": r"\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){1,4}",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: Letters of context that are looked at on either side.
CONTEXT = 64
#: Rounds; least score of a pattern, in millionths, and what is added to the number of its instances.
ROUNDS = 3
LEAST = 800_000
PRIOR = 1
_ONE = 1_000_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _sound(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern is one of the kind."""
    digits = _digits(value)
    card = F.length(digits).between(13, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z"))
        .when(kind == "card", card)
        .otherwise(F.length(digits).between(9, 15))
    )


def _plausible(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """Whether a loose match can be one of the kind: it has the right size and is no part of a longer word or number."""
    alone = ~before.rlike(r"[A-Za-z0-9]\z") & ~after.rlike(r"\A[A-Za-z0-9]")
    ended = ~before.rlike(r"[0-9][\x20.,:-]\z") & ~after.rlike(r"\A[\x20.,:-][0-9]")
    digits = F.length(_digits(value))
    return alone & (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"\A{_PART}(?:[.,:-]{_PART}){{3}}\z") & ended)
        .when(kind == "card", digits <= 19)
        .otherwise(digits.between(7, 15) & ended)
    )


def _instance(kind: Column, value: Column) -> Column:
    """What a mention names: addresses in lower case, numbers by digits, telephone numbers by their last nine."""
    digits = _digits(value)
    small = F.translate(F.regexp_replace(value, r"\x20?[\[(]at[\])]\x20?", "@"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = F.when(kind == "email", small).when(kind == "ip", F.regexp_replace(value, "[.,:-]", ".")).when(kind == "card", digits).otherwise(F.right(digits, F.lit(9)))
    return F.concat(kind, F.lit(":"), key)


def _plain(words: Column) -> Column:
    """Words with A-Z in lower case and every digit as 0."""
    return F.translate(words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def _patterns(kind: Column, before: Column, after: Column) -> Column:
    """The lexical patterns of a mention: two words before it, and the words beside it; none where words are missing."""
    last = F.regexp_extract(before, rf"({_WORD}+){_GAP}*\z", 1)
    second = F.regexp_extract(before, rf"({_WORD}+){_GAP}+{_WORD}+{_GAP}*\z", 1)
    following = F.regexp_extract(after, rf"\A{_GAP}*({_WORD}+)", 1)
    two = F.when((second != "") & (last != ""), F.concat(kind, F.lit(" "), _plain(second), F.lit(" "), _plain(last), F.lit(" _")))
    beside = F.when((last != "") & (following != ""), F.concat(kind, F.lit(" "), _plain(last), F.lit(" _ "), _plain(following)))
    return F.array_compact(F.array(two, beside))


def _found(docs: DataFrame) -> DataFrame:
    """uid, doc_id and a struct m for each match of any pattern, base and loose; and for every document a null m.

    A match's place follows from the lengths of matches and of the pieces between them, in the order ``at``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    digit = F.col("t").rlike("[0-9]")
    mail = F.contains("t", F.lit("@"))
    seen = {"email": mail, "ip": digit, "card": digit, "phone": F.contains("t", F.lit("+"))}
    loosely = seen | {"email": mail | F.col("t").rlike(r"[\[(]at[\])]"), "phone": digit}
    wanted = [(kind, base, (BASE if base else LOOSE)[kind], (seen if base else loosely)[kind]) for base in (True, False) for kind in KINDS]
    none = F.array().cast("array<string>")
    rows = rows.select("*", *[F.when(some, F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none).alias(f"hits{k}") for k, (_, _, p, some) in enumerate(wanted)])
    rows = rows.select("*", *[F.when(F.size(f"hits{k}") > 0, F.split("t", p, -1)).otherwise(none).alias(f"pieces{k}") for k, (_, _, p, _) in enumerate(wanted)])

    def matches(k: int, kind: str, base: bool) -> Column:
        after = F.slice(f"pieces{k}", F.lit(2), F.size(f"pieces{k}"))
        zipped = F.arrays_zip(F.col(f"hits{k}").alias("value"), F.col(f"pieces{k}").alias("before"), after.alias("after"))
        found = F.transform(
            zipped,
            lambda z, i: F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("at"), z["value"].alias("value"), F.length(z["before"]).alias("skip"),
                F.right(z["before"], F.lit(CONTEXT)).alias("before"), F.left(z["after"], F.lit(CONTEXT)).alias("after"),
            ),
        )
        return F.filter(found, lambda m: m["value"].isNotNull())

    every = F.concat(*[matches(k, kind, base) for k, (kind, base, _, _) in enumerate(wanted)], F.array(F.lit(None)))
    return rows.select("uid", "doc_id", F.explode(every).alias("m"))


def mentions(docs: DataFrame) -> DataFrame:
    """uid, doc_id, kind, base, start, end, instance, patterns of all base spans and loose mentions of every document.

    Places count code points; ends are exclusive.  Loose mentions that meet a base span of any kind are left out.
    Every document has one row without a kind besides.
    """
    rows = _found(docs).select("uid", "doc_id", "m.*").repartition("uid")
    order = Window.partitionBy("uid", "kind", "base").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("skip") + F.length("value")).over(order))
    rows = rows.withColumn("start", F.col("end") - F.length("value"))
    kind, value = F.col("kind"), F.col("value")
    good = F.when(F.col("base"), _sound(kind, value)).otherwise(_plausible(kind, value, F.col("before"), F.col("after")))
    rows = rows.where(kind.isNull() | good)
    earlier = Window.partitionBy("uid").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("uid").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, -1)  # frames that only grow
    rows = rows.withColumn("base_before", F.max(F.when(F.col("base"), F.col("end"))).over(earlier))
    rows = rows.withColumn("base_after", F.min(F.when(F.col("base"), F.col("start"))).over(later))
    clear = (F.coalesce("base_before", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("base_after"), F.col("end")) >= F.col("end"))
    rows = rows.where(kind.isNull() | F.col("base") | clear)
    return rows.select(
        "uid", "doc_id", "kind", "base", "start", "end", _instance(kind, value).alias("instance"), _patterns(kind, F.col("before"), F.col("after")).alias("patterns")
    )


def believed(found: DataFrame, rounds: int = ROUNDS, least: int = LEAST, prior: int = PRIOR) -> DataFrame:
    """instance and score (millionths) of the instances that are believed: seeds, and what reliable patterns hold.

    Each round, a pattern's score is the sum of its distinct instances' scores over their number plus ``prior``,
    rounded down; an instance that is no seed takes the best score of its patterns that reach ``least``.
    """
    edges = stored(
        found.where("kind IS NOT NULL").select("instance", "base", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("base").alias("base")),
        "pattern-edges",
    )
    seeds = stored(found.where("base").select("instance").distinct().withColumn("score", F.lit(_ONE).cast("long")), "seeds")
    known = seeds
    for _ in range(rounds):
        scored = edges.join(known, "instance", "left")
        score = F.floor(F.sum(F.coalesce("score", F.lit(0))) / (F.count(F.lit(1)) + prior)).cast("long")
        reliable = stored(scored.groupBy("pattern").agg(score.alias("score")).where(F.col("score") >= least), "reliable-patterns")
        held = edges.join(reliable, "pattern").groupBy("instance").agg(F.max("score").alias("score"))
        known = stored(held.join(seeds.select("instance"), "instance", "left_anti").unionByName(seeds), "believed")
    return known


def find_identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, number of base spans of each kind, digest of the base spans, all spans, and how many were added.

    A span is written kind:start:end; spans are listed by kind, then start, with commas between.  Added spans meet no
    base span and no span added before them.  Null and empty texts have no spans; their digest is that of the
    empty text.  Every row gives one row, repeated rows and rows without an id too.  No rows give no rows.
    """
    found = stored(mentions(docs), "mentions")
    loose = found.where("kind IS NOT NULL AND NOT base").drop("patterns").join(believed(found).select("instance"), "instance", "left_semi")
    ordinal = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    columns = ("uid", "doc_id", "kind", "base", "start", "end")
    rows = found.where("kind IS NULL OR base").select(*columns).unionByName(loose.select(*columns)).withColumn("ordinal", ordinal)
    earlier = Window.partitionBy("uid").orderBy(F.col("base").asc_nulls_last(), "start", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.when(~F.col("base"), F.col("end"))).over(earlier)
    rows = rows.withColumn("ended", ended).where(F.col("base").isNull() | F.col("base") | (F.coalesce("ended", F.lit(0)) <= F.col("start")))
    span = F.when(F.col("kind").isNotNull(), F.struct("ordinal", "start", "end", "kind", "base"))  # nulls are not collected
    rows = rows.groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    n = {kind: F.filter("spans", lambda s: s["base"] & (s["ordinal"] == k)) for k, kind in enumerate(KINDS, 1)}  # built at once, with this k
    counts = [F.size(own).cast("long").alias(f"n_{kind}") for kind, own in n.items()]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added)
