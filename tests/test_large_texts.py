"""Texts beyond one string, files from executors, digests, deep pages and many needles."""

import os
import random

import pytest
from pyspark.sql import functions as F

from slotloom.functions.text import clean_file_name
from slotloom.operators import chunks, digests, gramindex, search
from slotloom.operators import entries as E
from slotloom.plans.schema import Registry
from slotloom.sources import downloads, files

KIND = "id long, file_key string, entry_index long, content string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_rows(seed, n=200, keys=("lore", "notes", "reminders")):
    rng = random.Random(seed)
    bits = ["a", "é", "日本", "🙂", " ", "\n", "word ", "\n\n", "\t"]
    return [(k, rng.choice(keys), rng.randrange(1, n // 2), "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(1, n)]


@pytest.mark.parametrize(("limit", "run"), [(64, 7), (1, 1_000), (chunks.CHUNK_BYTES, 3)])
def test_chunks_are_the_composed_text(spark, monkeypatch, limit, run):
    monkeypatch.setattr(chunks, "RUN", run)
    df = spark.createDataFrame(random_rows(limit), KIND).repartition(3)
    found = {}
    for r in chunks.chunks(df, limit=limit).orderBy("file_key", "chunk").collect():
        own = found.setdefault(r.file_key, [])
        assert r.chunk == len(own) and r.offset == limit * r.chunk and 0 < len(r.bytes) <= limit
        own.append(bytes(r.bytes))
    assert all(len(c) == limit for own in found.values() for c in own[:-1])
    want = {r.file_key: r.content.encode() for r in E.compose(df).collect() if r.content}
    assert {k: b"".join(own) for k, own in found.items()} == want


def test_chunks_of_nothing(spark):
    df = spark.createDataFrame([(1, "lore", 1, " \n"), (2, "lore", 2, "")], KIND)
    assert chunks.chunks(df).count() == 0 and chunks.chunks(df.limit(0)).count() == 0


def test_executors_write_named_files(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(random_rows(3), KIND).repartition(3)
    folder = tmp_path / "out"
    downloads.write(df, str(folder))
    want = {r.file_name: r.content.encode() for r in files.downloads(df).collect()}
    assert {n: (folder / n).read_bytes() for n in os.listdir(folder)} == want and len(want) == 5
    downloads.write(df.where("file_key = 'lore'"), str(folder))  # files are replaced
    assert (folder / "notes.txt").read_bytes() == b"" and (folder / "lore.txt").read_bytes() == want["lore.txt"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    folder = tmp_path / "out"
    good = [(f"f{k}.txt", 0, b"x" * 100) for k in range(20)]
    bad = spark.createDataFrame(good, "file_name string, offset long, bytes binary").unionByName(
        spark.range(1).select(F.lit("f7.txt").alias("file_name"), F.lit(5).cast("long").alias("offset"), F.raise_error(F.lit("stop")).cast("binary").alias("bytes"))
    )
    with pytest.raises(Exception, match="stop"):
        downloads.write_named(bad, str(folder))
    with pytest.raises(Exception, match="NoneType|null"):
        downloads.write_named(spark.createDataFrame([*good, ("f9.txt", 200, None)], "file_name string, offset long, bytes binary"), str(folder))
    assert not folder.exists() or os.listdir(folder) == []


def test_file_names(spark):
    names = {"My File (1).txt": "My-File-1.txt", "a/b:c?.md": "abc.md", "..x--- y_.": "x-y", "a%20b+c.txt": "a-b-c.txt", "ok.txt": "ok.txt", "“q”.txt": "q.txt"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", clean_file_name(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in rows} == names
    assert spark.createDataFrame([("dir/a b?.TXT",)], "n string").where(files.has_valid_extension(F.col("n"))).count() == 1
    twins = Registry(slots=(("a", "Same"), ("b", "same"), ("c", "Other?"), ("d", "SAME")))
    assert {r.file_key: r.file_name for r in files.download_names(spark, twins).collect()} == {"a": "same.txt", "b": "same-2.txt", "c": "other.txt", "d": "same-3.txt"}


def test_digests_decide_as_composed_texts_do(spark, monkeypatch):
    monkeypatch.setattr(digests, "RUN", 5)
    rng = random.Random(4)
    rows, texts = [], []
    for k in range(80):
        own = [rng.choice(["a", "b", "a\nb", " ", "c\n\nd", " a "]) for _ in range(rng.randint(0, 7))]
        rows += [(1_000 * k + i, f"s{k}", i * 3, c) for i, c in enumerate(own)]
        other = list(own)
        change = rng.randrange(4)
        if change == 1 and len(other) > 1:
            other.reverse()
        elif change == 2:
            other.append("x")
        texts.append((f"s{k}", rng.choice(["\n\n", "\n \n\n", "\r\n\r\n"]).join(other)))
    rng.shuffle(rows)
    left, right = spark.createDataFrame(rows, KIND).repartition(4), spark.createDataFrame(texts, "file_key string, content string")
    decided = digests.equal(digests.digest(left), digests.of_texts(right))
    got = {r.file_key: r.equivalent for r in decided.collect()}
    from slotloom.functions.text import equivalent

    composed = E.compose_groups(left, "file_key").withColumnRenamed("content", "old")
    pairs = right.join(composed, "file_key", "left").select("file_key", equivalent(F.coalesce("old", F.lit("")), F.col("content")).alias("same"))
    want = {r.file_key: r.same for r in pairs.collect()}
    assert {k: got.get(k, True) for k in want} == want and len(set(want.values())) == 2
    assert "listagg" not in plan(decided).lower() and "collect_list" not in plan(decided)


def test_any_page_by_rank(spark, monkeypatch):
    monkeypatch.setattr(search, "RANK_RUN", 40)
    rng = random.Random(6)
    rows = [(k, rng.choice(["lore", "notes"]), rng.randrange(1, 700), rng.choice(["yes", "no"])) for k in range(900)]
    hits = search.search(spark.createDataFrame(rows, KIND).repartition(3), "yes")
    for number in (-1, 1, 2, 9, 18, 19, 10_000):
        got, want = search.page_by_rank(hits, number), search.page(hits, number)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), number
    assert "Window" not in plan(search.page_by_rank(hits, 9))
    assert search.page_by_rank(hits.limit(0), 3).count() == 0


def test_a_deep_page_reads_one_range(spark, tmp_path):
    path = str(tmp_path / "entries")
    spark.range(1, 1_000_001).selectExpr("id", "'lore' AS file_key", "id AS entry_index", "'x' AS content").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    page = search.page_by_rank(search.search(spark.read.parquet(path), "x"), 10_000)
    assert [r.id for r in page.orderBy("id").collect()] == list(range(249_976, 250_001))
    assert "GreaterThanOrEqual(entry_index,196608), LessThan(entry_index,262144)" in plan(page) and "Window" not in plan(page)


@pytest.mark.parametrize("few", [search.FEW_NEEDLES, 0])
def test_many_needles(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW_NEEDLES", few)
    rng = random.Random(9)
    letters = ["a", "b", "É", "é", "日", " ", "\n", "İ", "The"]
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(k, text(60)) for k in range(60)] + [(100, None), (101, "")]
    needles = [(k, text(rng.randint(1, 9))) for k in range(70)] + [(200, None), (201, ""), (3, "a"), (202, "a")]
    rows, wanted = spark.createDataFrame(texts, "doc long, body string"), spark.createDataFrame(needles, "item long, needle string")
    low = {k: r for k, r in ((r.doc, r.low) for r in rows.select("doc", F.lower("body").alias("low")).collect())}
    asked = [(r.item, r.low) for r in wanted.select("item", F.lower("needle").alias("low")).collect()]
    want = sorted({(d, n) for d, t in low.items() for n, x in asked if t and x and x in t})
    assert sorted(map(tuple, search.search_many(rows, wanted, "doc", "body", "item", "needle").collect())) == want
    postings = gramindex.postings(rows, "doc", "body")
    by_index = gramindex.search_many(rows, postings, gramindex.counts(postings), wanted, "doc", "body", "item", "needle")
    long = {n for n, x in asked if x and len(x) >= gramindex.SIZE}
    assert sorted(map(tuple, by_index.collect())) == sorted({(d, n) for d, t in low.items() for n, x in asked if t and x and len(x) >= gramindex.SIZE and x in t}) and long
    none = search.search_many(rows, wanted.limit(0), "doc", "body", "item", "needle")
    assert none.count() == 0 and none.columns == ["doc", "item"]
