"""Streams: uploads exactly once and in order, rings that go on after a restart."""

import os
import random
import shutil
from datetime import datetime

from pyspark.sql import functions as F

from slotloom.operators import revisions
from slotloom.service import Engine
from slotloom.sources.files import read_uploads
from slotloom.streaming.rings import PROVIDER, ring_stream
from slotloom.streaming.uploads import append_upload_stream, upload_stream

NOW = datetime(2024, 1, 2, 3, 4, 5)


def put(folder, name, text, second):
    path = folder / name
    path.write_bytes(text.encode())
    os.utime(path, (second, second))


def test_uploads_once_and_in_order(spark, tmp_path):
    engine, folder, check = Engine(spark, str(tmp_path / "store")), tmp_path / "in", str(tmp_path / "check")
    folder.mkdir()
    engine.save("lore", "old", NOW)
    slot = lambda name: F.when(name.startswith("n"), F.lit("notes")).otherwise(F.lit("lore"))
    run = lambda: append_upload_stream(engine, upload_stream(spark, str(folder), slot, 2), check, NOW, once=True).awaitTermination()
    put(folder, "z.txt", "first\r\n\r\nsecond", 1_000)
    put(folder, "a.md", " third ", 2_000)
    put(folder, "n.TXT", "note", 1_500)
    put(folder, "skip.pdf", "no", 1_100)
    put(folder, "blank.txt", " \n", 1_200)
    run()
    assert engine.text("lore") == "old\n\nfirst\n\nsecond\n\nthird" and engine.text("notes") == "note"
    state = engine.store.state()
    run()
    assert engine.store.state() == state
    shutil.rmtree(tmp_path / "check" / "commits")  # as if the driver was lost after the states were published
    run()
    assert engine.store.state() == state
    put(folder, "b.txt", "fourth", 3_000)
    run()
    assert engine.text("lore") == "old\n\nfirst\n\nsecond\n\nthird\n\nfourth"
    assert sorted(r.name for r in engine.store.read("uploads").collect()) == ["a.md", "b.txt", "blank.txt", "n.TXT", "z.txt"]
    assert read_uploads(spark, str(folder)).count() == 5


def rings(batches):
    found = {}
    for rows in batches:  # a slot's last ring counts
        own = {}
        for r in rows:
            own.setdefault(r.file_key, []).append((r.position, r.seq, r.content, r.saved_at))
        found |= {k: sorted(v) for k, v in own.items()}
    return found


def test_ring_as_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["lore", "notes", "x"]), s, rng.choice(["a", "a ", "b", " ", "a\n\nb", "a\n\n\nb", "c"]), 10 * s) for s in range(90)]
    kind = "file_key string, seq long, content string, saved_at long"
    want = {}
    for r in revisions.ring(spark.createDataFrame(rows, kind)).orderBy("position").collect():
        want.setdefault(r.file_key, []).append((r.position, r.seq, r.content, r.saved_at))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for name, cuts in (("one", [0, 90]), ("many", [0, 7, 8, 40, 90])):
            folder, check, seen = tmp_path / name, str(tmp_path / f"{name}-check"), []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # the stream ends and starts again from its checkpoint each time
                spark.createDataFrame(rng.sample(rows[a:b], b - a), kind).coalesce(1).write.mode("append").parquet(str(folder))
                log = spark.readStream.schema(kind).parquet(str(folder))
                writer = ring_stream(log).writeStream.outputMode("update").option("checkpointLocation", check)
                writer.foreachBatch(lambda df, _: seen.append(df.collect())).trigger(availableNow=True).start().awaitTermination()
            assert rings(seen) == want, name
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
