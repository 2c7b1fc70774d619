"""Token alignment against whole texts that are tokenised and aligned by plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotloom.llm import alignment, queries

BITS = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "\r", "\x0b", "\x0c", " \n ", " ", "  ", " ", "　 ", "\u0085", "​ ", "\x1c ", "\x00", "a", "the", "don't", "'ll", "{\r", "x;\r\n", "é", "é", "日本", "語",
    "🙂", "👩‍👩‍👧", "word", "Word,", "123", "1,000.5", "...", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", "ẞ", "﻿", "�", "“q” ", "–", "def f(x):\n    return x\n",
]


def fuzzed(seed, n, more=()):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS + list(more)) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def tokens(pair, text):
    """Ids of whole texts by both libraries, or None where they do not give the text back."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.a_raw[i] for i in a) != whole or b"".join(pair.b_raw[i] for i in b) != whole:
        return None
    return a, b


def placed(ids, raw):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(raw[i]), i))
        at += len(raw[i])
    return out


def plain(pair, rows):
    found, counts = [], Counter()
    for i, text in rows:
        ids = tokens(pair, text)
        if ids is None:
            found.append((i, None))
            continue
        a, b = placed(ids[0], pair.a_raw), placed(ids[1], pair.b_raw)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        common = sorted({x[1] for x in a} & {y[1] for y in b})
        groups = []
        for low, high in zip([0, *common], common):
            groups.append("|".join(",".join(str(t[2]) for t in side if low < t[1] <= high) for side in (a, b)))
        found.append((i, (len(a), len(b), groups, links)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", ""))
        else:
            n_a, n_b, groups, links = f
            whole = ";".join(groups)
            out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(whole.encode()).hexdigest(), whole))
    return sorted(out, key=repr), counts


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.public_files())


def test_token_bytes(pair):
    everything = "".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000 and c != 0x2581)
    for ids, raw, text in ((pair.a.encode(everything).ids, pair.a_raw, everything), (pair.b.encode(everything), pair.b_raw, " " + everything)):
        assert b"".join(raw[i] for i in ids) == text.encode()


def test_stops_are_those_that_no_piece_crosses(pair):
    assert pair.stops[ord(" ")] and pair.stops[ord("\n")]
    assert not pair.stops[ord("\r")]  # ";\r" is a piece


def test_segments_give_the_tokens_of_whole_texts(pair):
    for text in fuzzed(1, 3_000):
        whole = (" " + text).encode()
        cuts = pair.cuts(np.frombuffer(whole, np.uint8), np.array([0])).tolist()
        segments = [whole[x:y] for x, y in zip(cuts, [*cuts[1:], len(whole)])]
        a, b = pair.tokens(segments)
        if text:
            assert sum(a, []) == pair.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
            assert sum(b, []) == pair.b.encode(text), repr(text)


@pytest.mark.parametrize("more", [[], ["▁", "▁x"]], ids=["whole", "with texts that are not given back"])
def test_documents(spark, pair, more):
    texts = fuzzed(2, 120, more) + ["the same text"] * 40 + [None, "", " ", "\n", "   ", "x" * 5_000, "日本語" * 500, "some words and more " * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (3, texts[3])]
    if more:
        assert any(t and "▁" in t for t in texts)
    want, counts = plain(pair, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("block", "place", "segment", "n", "groups", "pair")})
    parts, block = (1, alignment.BLOCK_BYTES) if more else (3, 2_000)
    got = alignment.align_documents(docs.repartition(parts), with_groups=True, block_bytes=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    linked = {(r.a, r.b): (r["count"], r.best) for r in alignment.link_counts(docs).collect()}
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    assert {k: v for k, v in linked.items() if v[0]} == {k: (n, n == most[k[1]]) for k, n in counts.items()}


def test_stretches(spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "_STRETCH", 7)
    rows = [(1, "a few words that go on, " * 50), (2, "short")]
    want, _ = plain(pair, rows)
    assert sorted((tuple(r) for r in alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), with_groups=True).collect()), key=repr) == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(none).count() == 0 and alignment.link_counts(none).count() == 0
    empty = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_documents(empty).collect()), key=repr) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=repr)


def test_other_vocabularies_are_refused(tmp_path):
    import json

    a, b = alignment.public_files()
    for change in ({"add_prefix_space": True}, {"use_regex": False}):
        model = json.load(open(a))
        model["pre_tokenizer"] |= change
        path = tmp_path / "changed.json"
        path.write_text(json.dumps(model))
        with pytest.raises(ValueError, match="white space"):
            alignment.Pair(str(path), b)


def test_query(spark, pair):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want, counts = plain_fast(pair, rows)
    got = queries.op11_token_alignment(spark, folder)
    assert got.columns == [f.split()[0] for f in alignment.SCHEMA.split(", ")]
    found = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(found) == len(rows)
    for row in want:
        assert found[row[0]] == row


def plain_fast(pair, rows):
    """As ``plain``, by walking both token lists together."""
    found, counts = [], Counter()
    for i, text in rows:
        ids = tokens(pair, text)
        if ids is None:
            found.append((i, None))
            continue
        a, b = placed(ids[0], pair.a_raw), placed(ids[1], pair.b_raw)
        links, x, y = [], 0, 0
        while x < len(a) and y < len(b):
            links.append((a[x][2], b[y][2]))
            p, q = a[x][1], b[y][1]
            x, y = x + (p <= q), y + (q <= p)
        common = sorted({t[1] for t in a} & {t[1] for t in b})
        number = {end: k for k, end in enumerate(common)}
        sides = []
        for side in (a, b):
            own = [[] for _ in common]
            k = 0
            for t in side:
                own[k].append(str(t[2]))
                k = number[t[1]] + 1 if t[1] in number else k
            sides.append(own)
        whole = ";".join(f"{','.join(p)}|{','.join(q)}" for p, q in zip(*sides))
        counts.update(links)
        found.append((i, (len(a), len(b), len(common), links, whole)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, f[0], f[1], f[2], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest()))
    return out, counts
