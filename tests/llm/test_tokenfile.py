"""Token files: exact round trips, the library's own ids, order and starts."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from slotloom.llm import tokenfile as T


@pytest.mark.parametrize("kind", ["small", "outliers", "equal", "wide", "one"])
def test_blocks_round_trip(kind):
    rng = np.random.default_rng(1)
    ids = {
        "small": rng.integers(0, 900, 5000), "outliers": np.where(rng.random(5000) < 0.05, rng.integers(0, 2**32, 5000), rng.integers(7, 9, 5000)),
        "equal": np.full(700, 2**32 - 1), "wide": rng.integers(0, 2**32, 3000), "one": np.array([5]),
    }[kind].astype(np.uint32)
    writer = T.TokenFileWriter()
    cuts = np.sort(rng.integers(0, len(ids) + 1, 40))
    parts = np.split(ids, cuts)
    for k, part in enumerate(parts):
        writer.add([k], np.array([len(part)]), part)
    found = T.TokenFile(b"".join(writer.pieces()))
    assert found.total == len(ids) and (found.ids(0, len(ids)) == ids).all()
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ids)]])):
        assert (found.ids(int(a), int(b)) == ids[a:b]).all()
    assert kind != "outliers" or len(found.positions) and found.starts[-1] < len(ids)


def test_documents_match_the_library(spark):
    texts = ["Hello, World's end!", None, "", "<|endoftext|> a<|startoftext|>b", "123abc,,, 日本語 ñ\x0bq\x1fr x y z", "É é ÉÁ", "İSTANBUL Σας ﬁ", "a" * 300, "don't I'LL"] * 4
    rows = [(50 - i, t) for i, t in enumerate(texts)] + [(None, "zz"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, T.token_file_digests(docs).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(T.public_tokenizer())
    start, want = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_case_and_marks_are_left_to_the_library(spark):
    texts = [
        "<|ENDOFTEXT|>", "a<|EndOfText|>B <|endoftext|> <|STARTOFTEXT|>", "H\u0331allo", "T\u0308 W\u030a J\u030c, w\u030a", "É<|ENDOFTEXT|> THE The the.",
        "Straße STRASSE ÀÉÎ Ÿ, İx ŠĐŽ; \u212a \u212b \u1e9e", "NAÏVE Naïve naïve! E\u0301 I\u0307", "Don'T É I'LL X-Ray 3D", "Plain ASCII text, With Don'T I'LL A1b2.",
    ]
    texts += [f"x{chr(c)}Y {chr(c)} {chr(c)}." for c in range(0x80, 0x250)]
    library = Tokenizer.from_file(T.public_tokenizer())
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    starts = np.cumsum([0, *map(len, ids)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, T.token_file_digests(docs).collect()))
    assert got == [(k, starts[k], len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids)]


def test_empty_table(spark):
    assert T.token_file_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
