"""Operators on small tables, against hand-derived results and plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from slotloom import queries
from slotloom.functions.text import appended
from slotloom.operators import entries as E
from slotloom.operators import migration, replacing, revisions, search

KIND = "id long, file_key string, entry_index long, content string"


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize(
    ("rows", "text"),
    [([], ""), ([(1, "lore", 2, "x"), (9, "lore", 1, "y"), (3, "lore", 1, " z ")], "z\n\ny\n\nx"), ([(1, "lore", 1, "  "), (2, "lore", 2, "a")], "a")],
)
def test_compose(spark, rows, text):
    found = {r.file_key: r.content for r in E.compose(table(spark, rows)).collect()}
    assert found["lore"] == text and len(found) == 5 and found["notes"] == ""
    assert {r.file_key: r.entry_count for r in E.counts(table(spark, rows)).collect()}["lore"] == len(rows)


@pytest.mark.parametrize(
    ("keyword", "terms", "matched"),
    [
        ("", ["bob"], ["bob"]), ("alice", ["BOB"], ["BOB", "alice"]), ("Bob", ["Bob"], ["Bob"]), ("bob", ["Bob"], ["Bob", "bob"]), (" 50% ", [], ["50%"]),
        ("zed", ["Bob"], ["Bob"]), ("zed", [], None), ("", [], None),
    ],
)
def test_search(spark, keyword, terms, matched):
    rows = table(spark, [(1, "lore", 1, " Alice met BOB at 50% off "), (2, "lore", 2, " ")])
    found = search.search(rows, keyword, terms).collect()
    assert [r.matched_terms for r in found] == ([matched] if matched else [])
    assert all(r.content == "Alice met BOB at 50% off" for r in found)


@pytest.mark.parametrize(("total", "page", "pages", "rows"), [(51, 1, 3, 25), (51, 3, 3, 1), (51, 99, 3, 1), (25, 0, 1, 25), (0, 2, 1, 0)])
def test_paging(spark, total, page, pages, rows):
    hits = search.search(table(spark, [(i, "lore", i, "x") for i in range(1, total + 1)]), "x")
    assert tuple(search.page_count(hits).first()) == (total, pages)
    found = search.page(hits, page).collect()
    assert len(found) == rows
    if found:
        assert found[0].id == (min(max(page, 1), pages) - 1) * 25 + 1


def test_many_needles(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abÉ c") for _ in range(rng.randrange(60)))) for i in range(80)] + [(900, None), (901, "")]
    wanted = [(i, "".join(rng.choice("abé c") for _ in range(rng.choice([1, 2, 5, 6, 7, 9])))) for i in range(40)] + [(900, ""), (901, None)]
    for limit in (10_000, 0):
        search.FEW_NEEDLES, before = limit, search.FEW_NEEDLES
        found = search.search_many(spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(wanted, "n long, needle string"), "t", "text", "n", "needle")
        got = sorted(map(tuple, found.collect()))
        search.FEW_NEEDLES = before
        assert got == sorted((t, n) for t, x in texts for n, w in wanted if x and w and w.lower() in x.lower())
    assert search.search_many(spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame([], "n long, needle string"), "t", "text", "n", "needle").count() == 0


@pytest.mark.parametrize(
    ("content", "find", "new", "expected"), [("aaaaa.b", "aa", "x", ("xxa.b", 2)), ("abc", "B", "x", None), ("abc", "", "x", None), ("ab", "ab", "", ("", 1))]
)
def test_replace(spark, content, find, new, expected):
    rows = table(spark, [(1, "lore", 1, content), (2, "notes", 1, content)])
    found = replacing.preview(rows, "lore", find, new).collect()
    assert [(r.preview_content, r.replacement_count) for r in found] == ([expected] if expected else [])
    after = {r.id: r.content for r in replacing.apply(rows, "lore", find, new).collect()}
    assert after == {1: expected[0] if expected and expected[0] else content, 2: content}


def test_ring_of_one_log(spark, monkeypatch):
    monkeypatch.setattr(revisions, "RUN", 4)
    rng = random.Random(8)
    log = [(k, {1: rng.choice(["", "a", "b", "b,B"]), 2: rng.choice(["", "x"])}, k) for k in range(1, 60) if rng.random() < 0.7]
    found = revisions.list_ring(spark.createDataFrame(log, "seq long, lists map<int,string>, saved_at long")).orderBy("position").collect()
    kept = []
    for k, lists, _ in log:
        plain = ({"b,B": "b"}.get(lists[1], lists[1]), lists[2])
        if any(plain) and (not kept or kept[-1][1] != plain):
            kept.append((k, plain))
    assert [(r.position, r.seq, (r.lists[1], r.lists[2])) for r in found] == [(i, *x) for i, x in enumerate(kept[:-4:-1], 1)]


@pytest.mark.parametrize(("old", "new", "text"), [("a\n", " b ", "a\n\nb"), (" ", "b", "b"), ("a", " ", "a")])
def test_append(spark, old, new, text):
    assert spark.createDataFrame([(old, new)], "a string, b string").select(appended(F.col("a"), F.col("b")).alias("t")).first().t == text


def test_delete_and_count(spark):
    rows = table(spark, [(10 + i, "lore", i, "x") for i in range(1, 5)] + [(20, "notes", 7, "y")])
    ids = E.id_frame(spark, ["12", 12, 99, 0])
    assert sorted((r.id, r.entry_index) for r in E.delete(rows, ids).collect()) == [(11, 1), (13, 2), (14, 3), (20, 7)]
    assert E.deleted_count(rows, ids).first().deleted_count == 1


def test_edits(spark):
    rows = table(spark, [(11, "lore", 1, "a"), (12, "lore", 2, "b")])
    edits = spark.createDataFrame([(11, " new\n\nrow "), (12, "  "), (0, "x"), (99, "y")], "id long, content string")
    assert {r.id: r.content for r in E.apply_edits(rows, edits).collect()} == {11: "new\n\nrow", 12: "b"}
    assert E.saved_count(edits).first().saved_count == 2


def test_replace_slot_and_round_trip(spark):
    rows = table(spark, [(1, "lore", 1, "a"), (2, "notes", 1, "b")])
    texts = spark.createDataFrame([("lore", "x\n\n y \n\n"), ("reminders", "")], "file_key string, content string")
    assert sorted(map(tuple, E.replace_slots(rows, texts).collect())) == [("lore", 1, "x"), ("lore", 2, "y"), ("notes", 1, "b")]
    again = E.with_entries(E.compose(rows).where("file_key = 'notes'"))
    assert [tuple(r) for r in again.collect()] == [("notes", 1, "b")]


def test_resequence_over_runs(spark, monkeypatch):
    monkeypatch.setattr(E, "RUN", 7)
    rng = random.Random(2)
    rows = [(i, rng.choice(["lore", "notes"]), rng.randrange(100), "x") for i in range(1, 120)]
    found = {r.id: r.entry_index for r in E.resequence(table(spark, rows)).collect()}
    for key in ("lore", "notes"):
        ordered = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        assert [found[r[0]] for r in ordered] == list(range(1, len(ordered) + 1))


def simulate(log, split):
    ring = []
    for content in log:
        if content.strip(" \n\r\t\x0b\x00") and not (ring and split(ring[0]) == split(content)):
            ring = [content, *ring][:3]
    return ring


def test_revision_ring(spark):
    rng = random.Random(1)
    logs = [["a", "a ", "b", "", "b", "c", "d"], ["a", "b", "a"], ["a\n\nb", "a\n \n\nb"]]
    logs += [[rng.choice(["a", "a ", "b", " ", "a\n\nb", "a\n\n\nb", "c"]) for _ in range(rng.randrange(12))] for _ in range(30)]
    rows = [(str(k), s, c, s) for k, log in enumerate(logs) for s, c in enumerate(log)]
    found = {}
    for r in revisions.ring(spark.createDataFrame(rows, "file_key string, seq long, content string, saved_at long")).orderBy("position").collect():
        found.setdefault(int(r.file_key), []).append(r.content)
    split = lambda t: [p.strip() for p in t.split("\n\n") if p.strip()]
    assert found == {k: want for k, log in enumerate(logs) if (want := simulate(log, split))}


def test_migration(spark):
    legacy = spark.createDataFrame([("lore", "a\n\nb"), ("notes", " "), ("other", "z"), ("reminders", "r")], "file_key string, content string")
    rows = table(spark, [(1, "reminders", 1, "x")])
    assert sorted(map(tuple, migration.migrate(legacy, rows).collect())) == [("lore", 1, "a"), ("lore", 2, "b")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries that write files or stores before they give a plan; the ring's stream runs Python, to keep its state.
WRITING = ("upload_read", "search_many_indexed", "upload_stream", "revision_ring_stream", "download_files", *(n for n in queries.QUERIES if n.startswith("service_")))


def test_plans(spark):
    folder = "/root/testdata/sf0.001"
    assert "TakeOrderedAndProject" in plan(queries.search_page(spark, folder))
    for name, query in queries.QUERIES.items():
        if name not in WRITING:
            text = plan(query(spark, folder))
            assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text, name
    assert "StringContains" in plan(replacing.preview(spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id AS id", "doc_id AS entry_index", "text AS content"), None, "the", "x"))
