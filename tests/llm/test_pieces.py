"""Piece sampling: lossless, reproducible, and distributed as the lattice says."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from slotloom.llm import pieces

ODD = ["", " ", "  a  b\n\n c▁d \x00é日本語🙂ẞ\t", "x" * 3000, "日" * 300, "a\r\nb", "the quick brown fox", " lead", "trail ", "\x00", "\n", "   \n  "]


def encoded(sampler, some_texts, keys):
    ids, offsets = sampler.encode([t.encode() for t in some_texts], np.asarray(keys))
    assert sampler.decode(ids, offsets) == [t.encode() for t in some_texts]
    return [tuple(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]


def test_lossless_and_reproducible():
    sampler = pieces.PieceSampler(pieces.public_model())
    found = encoded(sampler, ODD, range(len(ODD)))
    other = pieces.PieceSampler(pieces.public_model(), cache_nodes=1)
    for key in [*range(len(ODD)), *range(len(ODD))]:
        assert encoded(other, [ODD[key]], [key]) == [found[key]]
    again = pieces.PieceSampler(pieces.public_model(), cache_nodes=1)
    assert encoded(again, ODD[::-1], range(len(ODD))[::-1]) == found[::-1]


def ways(sampler, text):
    """Every segmentation of a text and its weight, by plain recursion; no piece crosses a chunk's end."""
    total = {(): 1.0}
    for chunk in re.findall(r" *[^ \n]+|\n| +", " " + text):

        def every(rest, whole=chunk):
            if not rest:
                yield 1.0, ()
            for n in range(1, len(rest) + 1):
                if rest[:n] in sampler.weight:
                    w, i = sampler.weight[rest[:n]]
                    first = (i,)
                elif n == 1 and not any(whole[: len(whole) - len(rest) + 1].endswith(p) for p in sampler.weight):
                    w, first = 1e-6, tuple(sampler.byte_ids[b] for b in rest[0].encode())
                else:
                    continue
                for p, tail in every(rest[n:]):
                    yield w * p, first + tail

        own = Counter()
        for w, way in every(chunk):
            own[way] += w
        total = {a + b: p * w for a, p in total.items() for b, w in own.items()}
    return total


@pytest.mark.parametrize("text", ["hello", "to be\nor", "a🙂b", "ẞa  \n at"])
def test_distribution(text):
    sampler = pieces.PieceSampler(pieces.public_model(), alpha=0.3)
    exact = ways(sampler, text)
    total = sum(exact.values())
    n = 40_000
    seen = Counter(encoded(sampler, [text] * n, np.arange(n)))
    assert set(seen) <= set(exact) and len(seen) > 1
    for way, p in exact.items():
        share = p / total
        assert abs(seen[way] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3


def test_blocks_give_the_sums_of_one_pass(monkeypatch):
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdeéth🙂ein"), 3_000))
    mixed = [f"plain {long} words", long[:700], "x" * 65, long[:64]]
    whole = pieces.PieceSampler(pieces.public_model())
    monkeypatch.setattr(pieces, "LONG_CHUNK", 10_000)
    want = encoded(whole, mixed, range(4))
    for block, at_once in ((16, 3), (64, 512), (512, 2)):
        monkeypatch.setattr(pieces, "LONG_CHUNK", 64)
        monkeypatch.setattr(pieces, "BLOCK", block)
        monkeypatch.setattr(pieces, "_BLOCKS_AT_ONCE", at_once)
        parted = pieces.PieceSampler(pieces.public_model())
        assert encoded(parted, mixed, range(4)) == want
        n = whole.known.edges
        assert parted.known.edges == n and np.allclose(parted.known.cdf[:n], whole.known.cdf[:n], rtol=1e-9)


def test_unbroken_texts_take_time_in_proportion():
    sampler = pieces.PieceSampler(pieces.public_model())
    rng = np.random.default_rng(4)
    took = []
    for n in (100_000, 1_000_000):
        text = "".join(rng.choice(list("etaoinshrdlu"), n))
        began = time.process_time()
        assert len(encoded(sampler, [text], [n])[0]) < n
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0] + 1


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null key"), (3, None), (0, ""), (6, ODD[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = pieces.encode_documents(docs)
    got = found.collect()
    want = Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.decoded_crc32) for r in got) == want and all(r.lossless for r in got)
    assert Counter((r.doc_id, r.text) for r in pieces.decode_documents(found).collect()) == Counter((i, t or "") for i, t in rows)
    again = {(r.doc_id, r.decoded_crc32): r.piece_ids for r in pieces.encode_documents(docs.coalesce(1)).collect()}
    assert all(again[r.doc_id, r.decoded_crc32] == r.piece_ids for r in got)
    assert pieces.encode_documents(docs.limit(0)).count() == 0
