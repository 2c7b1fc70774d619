"""The engine over a store: saving, history, files, and crash safety."""

import shutil
from datetime import datetime

from slotloom.service import Engine, Outcome
from slotloom.sources import files
from slotloom.sources.store import Change

NOW = datetime(2024, 1, 2, 3, 4, 5)


def contents(engine, slot):
    return [r.content for r in engine.entries().where(f"file_key = '{slot}'").orderBy("entry_index").collect()]


def test_life_of_a_slot(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.text("lore") == ""
    assert engine.save("LORE", "one\n\ntwo\n\nthree", NOW) is Outcome.SAVED
    assert engine.save("notes", "note", NOW) is Outcome.SAVED
    ids = {r.content: r.id for r in engine.entries().collect()}
    assert sorted(ids.values()) == [1, 2, 3, 4]
    assert engine.history("lore").count() == 0
    assert engine.delete([ids["two"], 99], NOW) is Outcome.RESULTS_DELETED
    assert [(r.entry_index, r.content) for r in engine.entries().where("file_key = 'lore'").orderBy("entry_index").collect()] == [(1, "one"), (2, "three")]
    assert [r.content for r in engine.history("lore").collect()] == ["one\n\ntwo\n\nthree"]
    assert engine.apply_edits({ids["one"]: " ONE ", ids["three"]: " "}, NOW) is Outcome.RESULTS_SAVED
    assert engine.text("lore") == "ONE\n\nthree"
    assert engine.clear("lore", NOW) is Outcome.CLEARED
    assert engine.text("lore") == "" and engine.text("notes") == "note"
    assert [r.content for r in engine.history("lore").collect()] == ["ONE\n\nthree", "one\n\nthree", "one\n\ntwo\n\nthree"]
    assert engine.restore("lore", 2, NOW) is Outcome.RESTORED
    assert contents(engine, "lore") == ["one", "two", "three"]
    assert engine.restore("lore", 3, NOW) is Outcome.REVISION_MISSING
    assert min(r.id for r in engine.entries().where("file_key = 'lore'").collect()) > 4


def test_lists_search_and_replace(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.save("lore", "Alice met Bob\n\nnobody", NOW)
    assert engine.save_lists({1: "bob, Bob,Alice"}, NOW) is Outcome.LISTS_SAVED
    assert [r.matched_terms for r in engine.search("", {1: "Alice", 2: "Alice"}).collect()] == [["Alice"]]
    engine.save_lists({1: "Zoe"}, NOW)
    assert engine.restore_lists(0, NOW) is Outcome.RESTORED
    assert {r.list_index: r.text for r in engine.store.read("term_lists").collect()} == {1: "Alice\nbob", 2: "", 3: ""}
    assert engine.restore_lists(5, NOW) is Outcome.REVISION_MISSING
    rows = engine.preview("lore", " o ", "0").collect()
    assert sorted(r.preview_content for r in rows) == ["Alice met B0b", "n0b0dy"]
    assert engine.apply_replacement("o", {r.id: r.preview_content for r in rows}, NOW) is Outcome.REPLACED
    assert engine.apply_replacement(" ", {1: "x"}, NOW) is Outcome.REPLACE_MISSING
    assert engine.apply_replacement("o", {1: " "}, NOW) is Outcome.REPLACE_NO_MATCHES
    assert engine.text("lore") == "Alice met B0b\n\nn0b0dy"


def test_files(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    (tmp_path / "a.TXT").write_bytes("﻿x\r\n\r\ny".encode())
    assert engine.append_file("lore", None, NOW) is Outcome.UPLOAD_MISSING
    assert engine.append_file("lore", str(tmp_path / "a.pdf"), NOW) is Outcome.UPLOAD_INVALID
    assert engine.append_file("lore", str(tmp_path / "missing.md"), NOW) is Outcome.UPLOAD_UNREADABLE
    assert engine.append_file("lore", str(tmp_path / "a.TXT"), NOW) is Outcome.UPLOADED
    assert contents(engine, "lore") == ["﻿x", "y"]
    engine.export(str(tmp_path / "out"))
    written = {p.name: p.read_bytes().decode() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert written == {"lore.txt": "﻿x\n\ny"} | {f"{n}.txt": "" for n in ("writing-style", "reminders", "user-profile", "notes")}
    named = files.downloads(engine.entries()).collect()
    assert {r.file_name: r.byte_length for r in named} == {n: len(t.encode()) for n, t in written.items()}


def test_migration_once_and_failed_write(spark, tmp_path):
    legacy = spark.createDataFrame([("lore", "a\n\nb")], "file_key string, content string")
    path = str(tmp_path / "store")
    assert contents(Engine(spark, path, legacy=legacy, now=NOW), "lore") == ["a", "b"]
    engine = Engine(spark, path, legacy=legacy, now=NOW)
    assert contents(engine, "lore") == ["a", "b"]
    before = engine.store.state()
    bad = spark.createDataFrame([(1,)], "id long").selectExpr("id", "'lore' AS file_key", "1L AS entry_index", "raise_error('stop') AS content", "timestamp_ntz'2024-01-01' AS updated_at")
    try:
        engine.store.commit(before, {"entries": Change(bad)})
    except Exception:
        pass
    assert engine.store.state() == before and contents(engine, "lore") == ["a", "b"]


def test_edit_stream(spark, tmp_path):
    from slotloom.streaming.edits import apply_edit_stream

    engine = Engine(spark, str(tmp_path / "store"))
    engine.save("lore", "a\n\nb", NOW)
    source = str(tmp_path / "edits")
    spark.createDataFrame([(1, " A "), (2, " ")], "id long, content string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long, content string").parquet(source)
    apply_edit_stream(engine, stream, str(tmp_path / "check"), NOW, once=True).awaitTermination()
    assert engine.text("lore") == "A\n\nb"
    assert [r.content for r in engine.history("lore").collect()] == ["a\n\nb"]
    state = engine.store.state()
    shutil.rmtree(tmp_path / "check" / "commits")  # as if the driver was lost after the version was written
    apply_edit_stream(engine, stream, str(tmp_path / "check"), NOW, once=True).awaitTermination()
    assert engine.store.state() == state
