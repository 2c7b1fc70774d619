"""Mixing and sharding against plain restatements."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from slotloom.llm import mixing, sharding


def targets(sizes):
    """The excess over each cap is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in open_}
        capped |= {s: 3.0 * sizes[s] for s in over}


def documents():
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else [None, "é", "a", "b", "zero", "tiny"][i % 6]
        text = None if i % 50 == 7 else "" if source == "zero" else " w\t" * (1 if source == "tiny" else (i * 7919) % 90)
        rows.append((i if i != 13 else None, text, source))
    return rows + [(20, "a b", "a")] * 2


def test_mix(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "extra", 5) for r in rows], "doc_id long, text string, source string, target string, size int").repartition(3)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want = targets(sizes)
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        coin = int(hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        if abs(rate - int(rate) - coin) > 1e-9 and abs(rate - round(rate)) > 1e-9:
            assert r.copies == int(rate) + (coin < rate - int(rate))
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.2 * want[s] + 100 for s in want)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = defaultdict(int)
    for r in got:
        copies[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == {k: n for k, n in copies.items() if n}
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    rows = [(i, None if i % 9 == 0 else "é" * (i % 40), i) for i in range(1500)] + [(None, "x", 1), (None, "y", 2), (3, "same", 3), (3, "same", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long").repartition(3)
    got = sharding.shard_records(docs).collect()
    assert len(got) == len(rows)
    draw = lambda key, s: int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16)
    by_shard = defaultdict(list)
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert r.shard == max(range(24), key=lambda s: draw(key, s)) and r.grown_shard == max(range(25), key=lambda s: draw(key, s))
        assert r.grown_shard in (r.shard, 24)
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sharding.shard_records(docs.limit(0)).count() == 0


def test_weighted_shards(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text")
    got = sharding.shard_records(docs, (1.0, 2.0, 1.0), 4.0).collect()
    share = Counter(r.shard for r in got)
    assert abs(share[1] / 6000 - 0.5) < 0.03 and abs(share[0] / 6000 - 0.25) < 0.03
    assert all(r.grown_shard in (r.shard, 3) for r in got) and abs(sum(r.grown_shard == 3 for r in got) / 6000 - 0.5) < 0.03
