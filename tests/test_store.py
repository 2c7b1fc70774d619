"""The store and the engine over it: what a write touches, two writers, removal, the index, restarts."""

import random
import threading
from datetime import datetime

import pytest

from slotloom.operators import gramindex, search
from slotloom.service import Engine, Outcome
from slotloom.sources import store as store_module
from slotloom.sources.legacy import probe
from slotloom.sources.store import Change, Conflict

NOW = datetime(2024, 1, 2, 3, 4, 5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "store"))
    made.save("lore", "one\n\ntwo\n\nthree", NOW)
    made.save("notes", "a\n\nb", NOW)
    return made


def ids(engine):
    return {r.content: r.id for r in engine.entries().collect()}


def test_an_edit_rewrites_one_slot_only(engine):
    before = engine.store.files()
    engine.apply_edits({ids(engine)["two"]: "TWO"}, NOW)
    after = engine.store.files()
    assert before["entries/file_key=notes/run=0"] == after["entries/file_key=notes/run=0"]
    assert not before["entries/file_key=lore/run=0"] & after["entries/file_key=lore/run=0"]
    assert engine.text("lore") == "one\n\nTWO\n\nthree" and engine.text("notes") == "a\n\nb"


def test_an_edit_rewrites_one_run_of_a_long_slot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "PLACES", 10)
    engine = Engine(spark, str(tmp_path / "store"))
    engine.save("lore", "\n\n".join(f"e{k}" for k in range(1, 36)), NOW)
    before = engine.store.files()
    assert [p for p in sorted(before) if p.startswith("entries")] == [f"entries/file_key=lore/run={k}" for k in range(4)]
    engine.apply_edits({ids(engine)["e17"]: "edited"}, NOW)
    after = engine.store.files()
    changed = [p for p in sorted(after) if p.startswith("entries") and before[p] != after[p]]
    assert changed == ["entries/file_key=lore/run=1"]
    assert engine.text("lore") == "\n\n".join("edited" if k == 17 else f"e{k}" for k in range(1, 36))
    engine.delete([ids(engine)["e1"]], NOW)
    assert [r.entry_index for r in engine.slot("lore").collect()] == list(range(1, 35))


def test_reads_of_a_slot_choose_its_files(engine):
    text = plan(engine.slot("notes"))
    assert "PartitionFilters: [isnotnull(file_key" in text and "file_key" in text.split("PartitionFilters: ")[1].split("]")[0]
    few = engine.entries().where("id IN (1, 2)")
    assert "PushedFilters: [In(id" in plan(few)


def test_old_parts_are_removed(engine, tmp_path):
    from pathlib import Path

    for k in range(6):
        engine.apply_edits({ids(engine)["a"] if k == 0 else number: f"text {k}"}, NOW) if k else None
        number = min(r.id for r in engine.slot("notes").collect())
    root = Path(engine.store.path)
    assert len(list((root / "states").glob("*.json"))) == store_module.KEEP
    versions = list((root / "entries").glob("version=*/file_key=notes"))
    assert len(versions) <= store_module.KEEP
    assert engine.text("notes").startswith("text 5") and engine.text("lore") == "one\n\ntwo\n\nthree"


def test_what_dead_writers_left_is_removed(spark, engine):
    spark.range(3).write.parquet(f"{engine.store.path}/entries/version=vdead")
    assert engine.store.vacuum() == []  # it may belong to a writer at work
    assert engine.store.vacuum(older_than=-60) == ["entries/version=vdead"] and engine.store.vacuum(older_than=-60) == []
    assert engine.text("lore") == "one\n\ntwo\n\nthree" and engine.history("lore").count() == 0


def test_of_two_writers_one_is_refused(engine):
    base = engine.store.state()
    rows = engine.store.read("entries", base)
    changed = rows.withColumn("content", rows.content)
    first = engine.store.commit(base, {"entries": Change(changed.where("file_key = 'lore'"), engine.store.parts("entries", base, ["lore"]))})
    with pytest.raises(Conflict):
        engine.store.commit(base, {"entries": Change(changed.where("false"), None)})
    assert engine.store.state() == first and engine.text("lore") == "one\n\ntwo\n\nthree" and engine.text("notes") == "a\n\nb"
    listed = {f.getPath().getName() for f in engine.store._fs.listStatus(engine.store._path(f"{engine.store.path}/entries"))}
    used = {f"version={v}" for n in engine.store._numbers() for own in engine.store._state(n)["tables"]["entries"].values() for v in own}
    assert listed == used  # nothing of the refused write remains


def test_racing_writers_lose_nothing(spark, engine):
    """Each of two clients saves its own slot until it gets through; both texts are there in the end."""
    outcomes = {}

    def client(slot):
        own, tries = Engine(spark, engine.store.path), []
        while not tries or tries[-1] is Outcome.CONFLICT:
            tries.append(own.save(slot, f"{slot} of a client", NOW))
        outcomes[slot] = tries

    threads = [threading.Thread(target=client, args=(s,)) for s in ("lore", "notes")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(tries[-1] is Outcome.SAVED for tries in outcomes.values())
    assert [engine.text(s) for s in ("lore", "notes")] == [f"{s} of a client" for s in ("lore", "notes")]
    assert engine.history("lore").count() == 1
    every = [r.id for r in engine.entries().collect()]
    assert len(every) == len(set(every))


def test_legacy_is_probed_and_migrated_once(spark, tmp_path):
    folder = str(tmp_path / "legacy")
    assert probe(spark, folder) is None and probe(spark, "no_such_table") is None
    path = str(tmp_path / "store")
    assert Engine(spark, path, legacy=folder, now=NOW).entries().count() == 0  # nothing to migrate yet, and no mark
    spark.createDataFrame([("lore", "a\n\nb"), ("notes", " ")], "file_key string, content string").write.parquet(folder)
    engine = Engine(spark, path, legacy=folder, now=NOW)
    assert engine.text("lore") == "a\n\nb" and engine.store.state()["marks"]["migrated"]
    engine.clear("lore", NOW)
    state = engine.store.state()
    assert Engine(spark, path, legacy=folder, now=NOW).text("lore") == "" and engine.store.state() == state
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "odd"))
    assert probe(spark, str(tmp_path / "odd")) is None


def test_legacy_table_of_the_catalogue(spark, tmp_path):
    spark.createDataFrame([("notes", "x")], "file_key string, content string").createOrReplaceTempView("old_documents")
    assert Engine(spark, str(tmp_path / "store"), legacy="old_documents", now=NOW).text("notes") == "x"


LETTERS = ["a", "b", "ab", "The ", "é", "É", "日本", " ", "\n", "word", "İ", "ß"]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    engine = Engine(spark, str(tmp_path / "store"))
    engine.save("lore", "\n\n".join(f"x{k} " + text(30) for k in range(300)), NOW)
    plain_engine = Engine(spark, str(tmp_path / "store"))
    needles = [text(3), "x29", "É", "not there at all"]
    scan = {n: sorted(r.id for r in search.search(plain_engine.entries(), n).collect()) for n in needles}
    engine.build_index()
    assert {n: sorted(r.id for r in engine.hits(n).collect()) for n in needles} == scan
    own = {r.entry_index: r.id for r in engine.slot("lore").collect()}
    engine.apply_edits({own[3]: "a quite different sentence"}, NOW)  # the index is kept up
    engine.save("notes", "another quite different one", NOW)
    engine.delete([own[7]], NOW)
    engine.append_uploads(spark.createDataFrame([("reminders", "u.txt", "something quite different", NOW)], "file_key string, name string, content string, place timestamp"), NOW)
    for n in ("quite different", "x29"):
        assert sorted(r.id for r in engine.hits(n).collect()) == sorted(r.id for r in search.search(engine.entries(), n).collect()), n
    assert engine.hits("quite different").count() == 3


def test_index_reads_only_files_of_the_rarest_grams(engine):
    engine.build_index()
    state = engine.store.state()
    postings = engine.store.read("grams", state)
    wanted = [r.gram for r in engine.spark.sql("SELECT 'thr' AS gram UNION ALL SELECT 'hre'").collect()]
    one = postings.where(postings.bucket.isin([3]) & postings.gram.isin(wanted))
    text = plan(one)
    assert "bucket" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "PushedFilters: [In(gram" in text
    near = gramindex.narrowed(engine.store.read("entries", state), postings, engine.store.read("gram_counts", state), ["three"])
    assert "PushedFilters" in plan(near) and "GreaterThanOrEqual(id" in plan(near) and sorted(r.content for r in near.collect()) == ["a", "b", "one", "three", "two"]


def test_rebuilding_the_index_drops_what_is_out_of_date(engine):
    engine.build_index()
    number = ids(engine)["three"]
    engine.apply_edits({number: "four"}, NOW)
    assert engine.store.read("grams").where("gram = 'thr'").count() == 1
    engine.build_index()
    assert engine.store.read("grams").where("gram = 'thr'").count() == 0 and engine.store.read("grams").where("gram = 'fou'").count() == 1


def test_uploads_know_their_files(spark, engine):
    rows = [("notes", "b.txt", " second ", datetime(2024, 1, 1, 0, 0, 2)), ("notes", "a.txt", "first", datetime(2024, 1, 1, 0, 0, 1)), ("LORE", "c.md", " ", NOW), ("notes", "0.txt", "third\n\nfourth", datetime(2024, 1, 1, 0, 0, 2))]
    frame = spark.createDataFrame(rows, "file_key string, name string, content string, place timestamp")
    assert engine.append_uploads(frame, NOW) is Outcome.UPLOADED
    assert engine.text("notes") == "a\n\nb\n\nfirst\n\nthird\n\nfourth\n\nsecond" and engine.text("lore") == "one\n\ntwo\n\nthree"
    assert sorted((r.file_key, r.name, r.byte_length) for r in engine.store.read("uploads").collect()) == [("lore", "c.md", 1), ("notes", "0.txt", 13), ("notes", "a.txt", 5), ("notes", "b.txt", 8)]
    assert [r.content for r in engine.history("notes").collect()] == ["a\n\nb"] and engine.history("lore").count() == 0
