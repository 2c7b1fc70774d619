"""Text expressions: trimming, splitting into entries, equivalence, natural order, lenient integers.

All are built-in expressions; none leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotloom.plans.schema import DEFAULT, Registry

#: The six characters that count as blank at the edges of a text; form feeds and no-break spaces stay.
BLANKS = " \n\r\t\x0b\x00"
_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = r" \t\n\x0b\f\r"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def trim_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def _trimmed_parts(c: Column, pattern: str) -> Column:
    parts = F.transform(F.split(unix_newlines(c), pattern), trim)
    return F.filter(parts, lambda x: x != "")


def split_entries(c: Column) -> Column:
    """The entries of a text: what stands between blank lines, trimmed, without empty ones."""
    return _trimmed_parts(c, r"\n\s*\n+")


def equivalent(a: Column, b: Column) -> Column:
    """Whether two texts have the same entries."""
    return split_entries(a) == split_entries(b)


def natural_key(c: Column) -> Column:
    """A sort key for natural order, in which A-Z count as a-z and white space does not count.

    Runs of digits compare as numbers of any size, but runs that begin with 0 compare digit by digit like
    fractions, before all others; zeros before a digit at the very start do not count.
    """
    folded = F.regexp_replace(F.translate(c, _SMALL, _LARGE), "^0+([0-9])", "$1")
    runs = F.regexp_extract_all(folded, F.lit(f"([0-9]+|[{_SPACE}]+|[^0-9{_SPACE}]+)"), 1)

    def key(run: Column) -> Column:
        size = F.length(run).cast("string")
        number = F.concat(F.length(size).cast("string"), size, run)  # of two numbers the longer is greater
        return F.when(run.rlike("^[1-9]"), number).when(run.startswith("0"), F.concat(run, F.lit("\x01"))).when(run.rlike(f"^[{_SPACE}]"), "").otherwise(run)

    return F.array_join(F.transform(runs, key), "")


def parse_terms(c: Column) -> Column:
    """Terms of a list: cut at commas and line ends, first spelling of each in natural order.

    Case does not tell terms apart.  Equal keys keep the order in which they came.  Sorting brings the
    spellings of a term together, so the cost is that of sorting.
    """
    placed = F.array_sort(F.transform(_trimmed_parts(c, "[\n,]+"), lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("term"))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(placed, lambda s: s["low"]))

    def first(s: Column, low: Column) -> Column:
        return F.when(s.isNotNull() & (low.isNull() | (low != s["low"])), F.struct(natural_key(s["term"]).alias("key"), s["at"].alias("at"), s["term"].alias("term")))

    return F.transform(F.array_sort(F.array_compact(F.zip_with(placed, before, first))), lambda s: s["term"])


def normal_terms(c: Column) -> Column:
    """The text that a term list is stored as; applying it again changes nothing."""
    return F.array_join(parse_terms(c), "\n")


def slot_key(c: Column, registry: Registry = DEFAULT) -> Column:
    """A registry key from any text: lower case, other characters dropped, the default for what is unknown or null."""
    clean = F.regexp_replace(F.lower(c), r"[^a-z0-9_\-]", "")
    return F.when(clean.isin(registry.keys), clean).otherwise(F.lit(registry.default_key))


def appended(existing: Column, uploaded: Column) -> Column:
    """The text after an upload: trimmed, after a blank line; blank uploads change nothing."""
    new = trim(uploaded)
    joined = F.concat(trim_right(existing), F.lit("\n\n"), new)
    return F.when(new == "", existing).when(is_blank(existing), new).otherwise(joined)


def lenient_int(c: Column) -> Column:
    """The integer at the start of a text, 0 if there is none; beyond 64 bits the nearest that fits."""
    found = F.regexp_extract(c, r"^[ \t\n\r\x0b\f]*([+-]?\d+)", 1)
    beyond = F.when(found.startswith("-"), F.lit(-(1 << 63))).when(found != "", F.lit((1 << 63) - 1))
    return F.coalesce(found.try_cast("long"), beyond, F.lit(0)).cast("long")


def occurrences(c: Column, find: str) -> Column:
    """How often a non-empty literal occurs, left to right without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(find), F.lit("")))) / F.lit(len(find))).cast("long")


# fixed values: letters that file names lose
_NOT_IN_NAMES = "?[]/\\=<>:;,'\"&$#*()|~`!{}%+’«»”“\x00"


def clean_file_name(name: Column) -> Column:
    """A file name without letters that shells and browsers read otherwise; blanks and hyphens in a row become one hyphen.

    Dots, hyphens and underscores at either end go too.
    """
    spaced = F.replace(F.replace(F.replace(name, F.lit("\u00a0"), F.lit(" ")), F.lit("%20"), F.lit("-")), F.lit("+"), F.lit("-"))
    kept = F.translate(spaced, _NOT_IN_NAMES, "")
    return F.btrim(F.regexp_replace(kept, r"[\r\n\t -]+", "-"), F.lit(".-_"))


def download_name(label: Column) -> Column:
    return clean_file_name(F.concat(F.lower(F.replace(label, F.lit(" "), F.lit("-"))), F.lit(".txt")))
