"""Text rules, one small case each."""

import functools
import re
import time

import pytest
from pyspark.sql import functions as F

from slotloom.functions import text as X


def evaluate(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "entries"),
    [
        ("", []), ("  \n\t\n ", []), ("a\n\nb", ["a", "b"]), ("a\r\n\r\nb", ["a", "b"]), ("a\r\rb", ["a", "b"]), ("\n\na\n \t\n\n b \n\n", ["a", "b"]),
        ("a\nb\n\nc", ["a\nb", "c"]), ("a\n\f\nb", ["a", "b"]), ("\fa\f", ["\fa\f"]), ("a\n \nb", ["a\n \nb"]), ("a\n\x0b\nb", ["a", "b"]),
    ],
)
def test_split(spark, text, entries):
    assert evaluate(spark, text, X.split_entries) == entries


@pytest.mark.parametrize(("raw", "key"), [("LORE", "lore"), ("Writing_Style", "writing_style"), ("no tes!", "notes"), ("other", "lore"), ("", "lore"), (None, "lore")])
def test_slot_key(spark, raw, key):
    assert evaluate(spark, raw, X.slot_key) == key


@pytest.mark.parametrize(
    ("text", "terms"),
    [("b,a\n\n,A, c", ["a", "b", "c"]), ("item10,Item2,item1", ["item1", "Item2", "item10"]), ("É,é", ["É"]), (" , \n", []), ("x\r\ny\rz", ["x", "y", "z"])],
)
def test_terms(spark, text, terms):
    assert evaluate(spark, text, X.parse_terms) == terms
    normal = evaluate(spark, text, X.normal_terms)
    assert normal == "\n".join(terms) and evaluate(spark, normal, X.normal_terms) == normal


@pytest.mark.parametrize(
    "terms",
    [
        ["a1", "a01", "a2"], ["x 9", "x10", "X 11"], ["a" + "9" * 30, "a1" + "0" * 30], ["007", "8", "0010"], ["v1.01", "v1.1", "v1.2", "v1.010"],
        ["img12.png", "img10.png", "IMG2.png", "img1.png"], ["Z_", "Za", "z1", "z"], ["1 2", "12", "1 10"], ["0", "00", "a0", "a00"],
    ],
)
def test_natural_order_against_a_comparison(spark, terms):
    assert evaluate(spark, ",".join(terms), X.parse_terms) == sorted(terms, key=functools.cmp_to_key(natural_compare))


def natural_compare(a, b):
    """Natural order by walking two texts at once: blanks skipped, digits as numbers, or as fractions where a run begins with 0."""
    a, b = ("".join(c.upper() if c.isascii() else c for c in re.sub(r"^0+(?=\d)", "", x)) for x in (a, b))
    i = j = 0
    while True:
        while i < len(a) and a[i] in " \t\n\x0b\f\r":
            i += 1
        while j < len(b) and b[j] in " \t\n\x0b\f\r":
            j += 1
        if i == len(a) or j == len(b):
            return (i < len(a)) - (j < len(b))
        if a[i].isdigit() and b[j].isdigit():
            x, y = re.match(r"\d+", a[i:]).group(), re.match(r"\d+", b[j:]).group()
            if x != y:
                fraction = x[0] == "0" or y[0] == "0"
                first, second = (x, y) if fraction or len(x) == len(y) else (len(x), len(y))
                return -1 if first < second else 1
            i, j = i + len(x), j + len(y)
        elif a[i] != b[j]:
            return -1 if a[i] < b[j] else 1
        else:
            i, j = i + 1, j + 1


def test_long_term_lists_take_time_in_proportion(spark):
    took = []
    for n in (4_000, 40_000):
        text = ",".join(f"term {(k * 7919) % n} of {k % 9}" for k in range(n))
        began = time.perf_counter()
        assert len(evaluate(spark, text, X.parse_terms)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 2


@pytest.mark.parametrize(("text", "number"), [("12", 12), (" 7x", 7), ("-3", -3), ("abc", 0), ("", 0), ("99999999999999999999", (1 << 63) - 1)])
def test_lenient_int(spark, text, number):
    assert evaluate(spark, text, X.lenient_int) == number


def test_trim_set(spark):
    assert evaluate(spark, " \n\r\t\x0b\x00a\x0c  \x00", X.trim) == "a\x0c "


def test_occurrences(spark):
    assert evaluate(spark, "aaaaa.b", lambda c: X.occurrences(c, "aa")) == 2


def test_equivalence(spark):
    rows = spark.createDataFrame([("a\n\nb", " a \n \n\nb\n"), ("a", "A"), ("a\nb", "a\n\nb"), ("", "\f")], "a string, b string")
    assert [r.e for r in rows.select(X.equivalent(F.col("a"), F.col("b")).alias("e")).collect()] == [True, False, False, False]


def test_integers_beyond_64_bits(spark):
    given = {"99999999999999999999": (1 << 63) - 1, " -99999999999999999999x": -(1 << 63), "9223372036854775807": (1 << 63) - 1, "x1": 0, "": 0, "-": 0, "+7.9": 7}
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", X.lenient_int(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == given
