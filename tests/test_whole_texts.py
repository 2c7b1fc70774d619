"""Whole texts by streams of parts, lengths by sums, and the store's revisions in pieces."""

import hashlib
import os
import random
from datetime import datetime

from pyspark.sql import functions as F

from slotloom.functions.text import split_entries
from slotloom.operators import chunks, digests, revisions
from slotloom.operators import entries as E
from slotloom.service import Engine, Outcome
from slotloom.sources import downloads, files

KIND = "id long, file_key string, entry_index long, content string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_rows(seed, n=200, keys=("lore", "notes", "reminders")):
    rng = random.Random(seed)
    bits = ["a", "é", "日本", "🙂", " ", "\n", "word ", "\n\n", "\t", "\f", "\n\f"]
    return [(k, rng.choice(keys), rng.randrange(1, n // 2), "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(1, n)]


def test_digests_of_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(downloads, "SPAN", 100)
    df = spark.createDataFrame(random_rows(1), KIND).repartition(3)
    want = {(r.file_key, len(r.content.encode()), hashlib.md5(r.content.encode()).hexdigest()) for r in E.compose(df).collect() if r.content}
    assert {tuple(r) for r in downloads.text_digests(chunks.chunks(df, limit=33), "file_key").collect()} == want
    assert downloads.text_digests(chunks.chunks(df.limit(0)), "file_key").count() == 0


def test_slots_of_ids_are_not_dealt_by_slot(spark):
    df = spark.createDataFrame(random_rows(2), KIND)
    text = plan(revisions.rows_for_ids(df, df.where("id < 5").select("id")))
    assert "BroadcastHashJoin" in text and "hashpartitioning(file_key" not in text.split("BroadcastExchange")[0]


def test_files_are_joined_from_parts_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(downloads, "SPAN", 50)
    df = spark.createDataFrame(random_rows(3), KIND).repartition(3)
    folder, want = tmp_path / "out", {r.file_name: r.content.encode() for r in files.downloads(df).collect()}
    pieces = files.download_names(spark).join(chunks.chunks(df, limit=20), "file_key", "left")
    downloads.write_named(pieces.select("file_name", F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("bytes", F.lit(b"")).alias("bytes")), str(folder))
    assert {n: (folder / n).read_bytes() for n in os.listdir(folder)} == want
    assert {tuple(r) for r in downloads.written(spark, str(folder)).collect()} == {(n, len(b), hashlib.md5(b).hexdigest()) for n, b in want.items()}


def test_a_manifest_composes_nothing(spark):
    df = spark.createDataFrame(random_rows(4), KIND).repartition(3)
    found = files.manifest(df)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, files.downloads(df).drop("content").collect()))
    assert "listagg" not in plan(found).lower()
    assert {r.byte_length for r in files.manifest(df.limit(0)).collect()} == {0}


def test_runs_of_places_are_small(spark):
    assert chunks.RUN <= 4_096  # a run's texts are put in order in one task


def test_pieces_and_parts_of_slots(spark, monkeypatch):
    monkeypatch.setattr(chunks, "RUN", 7)
    monkeypatch.setattr(digests, "RUN", 5)
    df = spark.createDataFrame(random_rows(5), KIND).repartition(3)
    texts = {r.file_key: r for r in E.compose_groups(df, "file_key").select("file_key", "content", split_entries(F.col("content")).alias("parts")).collect()}
    found, places = {}, {}
    for r in chunks.pieces(df, limit=40).orderBy("file_key", "piece").collect():
        found.setdefault(r.file_key, []).append(r.content)
    assert {k: "".join(own) for k, own in found.items()} == {k: r.content for k, r in texts.items()} and all(len(own) > 9 for own in found.values())
    for r in digests.parts(df).orderBy("file_key", "place").collect():
        places.setdefault(r.file_key, []).append((r.place, r.part))
    assert places == {k: list(enumerate(r.parts)) for k, r in texts.items()}


def test_a_write_composes_no_slot(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.save("lore", "one\n\ntwo\n\nthree", datetime(2024, 1, 2))

    def no_text(*_):
        raise AssertionError("a slot was composed")

    monkeypatch.setattr(E, "compose", no_text)
    monkeypatch.setattr(revisions, "compose_groups", no_text)
    engine.delete([2], datetime(2024, 1, 3))
    engine.clear("lore", datetime(2024, 1, 4))
    assert [r.content for r in engine.history("lore").collect()] == ["one\n\nthree", "one\n\ntwo\n\nthree"]
    assert engine.restore("lore", 1, datetime(2024, 1, 5)) is Outcome.RESTORED
    assert [r.content for r in engine.slot("lore").collect()] == ["one", "two", "three"]


def test_a_part_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from slotloom.sources import store

    monkeypatch.setitem(store.SHARES, "entries", ("entry_index", 8))
    rows = spark.range(1, 65).selectExpr("id", "'lore' AS file_key", "id AS entry_index", "'x' AS content", "timestamp_ntz'2024-01-01' AS updated_at")
    own = store.Store(spark, str(tmp_path / "store"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own.commit(own.state(), {"entries": store.Change(rows)})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(own.files()["entries/file_key=lore/run=0"]) > 1 and own.read("entries").count() == 64


def test_an_index_computes_its_postings_once(spark, tmp_path, monkeypatch):
    from slotloom.operators import gramindex

    engine = Engine(spark, str(tmp_path / "store"))
    engine.save("lore", "one two\n\nthree", datetime(2024, 1, 2))
    counted, counts = [], gramindex.counts
    monkeypatch.setattr(gramindex, "counts", lambda found: counted.append(found) or counts(found))
    engine.build_index()
    assert "/grams/version=" in counted[0].inputFiles()[0]
    assert [r.content for r in engine.search("HREE").collect()] == ["three"]
