"""Vector codes against plain whole-number arithmetic, and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from slotloom.llm import queries, veccodes


def plain(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error, digest by comparing every part with every entry."""
    kept = [(i, [float(x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = []
    for _, v, _ in kept:
        w = [256 * n // d for n, d in (x.as_integer_ratio() for x in v)]
        w += [0] * (width * parts - len(w))
        whole.append([w[p * width : (p + 1) * width] for p in range(parts)])
    books = [[w[p] for w in whole[:entries]] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        found = [[near(p, w[p])[1] for w in whole] for p in range(parts)]
        new = []
        for p in range(parts):
            book = []
            for e, entry in enumerate(books[p]):
                own = [w[p] for w, f in zip(whole, found[p]) if f == e]
                book.append([sum(c) // len(own) for c in zip(*own)] if own else entry)
            new.append(book)
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for (i, _, label), w in zip(kept, whole):
        each = [near(p, w[p]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for _, e in each), sum(d for d, _ in each), label])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=repr)


def coded(df):
    return sorted((tuple(r) for r in veccodes.code_table(df).collect()), key=repr)


KIND = "vec_id long, embedding array<double>, label int"


def vectors(seed, n, width, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.float32(v) * scale], int(i) % 3 or None) for i, v in zip(rng.permutation(n), rng.normal(size=(n, width)))]


ODD = [(None, [0.5] * 32, 1), (7, [0.25] * 32, None), (7, [0.25] * 32, None), (8, None, 1), (9, [None] * 32, 1), (10, [float("nan")] * 32, 1), (11, [float("inf")] * 32, 2), (12, [1.0], 2), (13, [], 9)]


@pytest.mark.parametrize("rows", [
    vectors(1, 300, 32) + ODD, vectors(2, 40, 32) + ODD, vectors(3, 120, 35), vectors(4, 100, 16) * 2, [(1, [], None), (0, [], 2)], [(5, [3.0, -2.5], 1)],
    [(i, [1.0] * 16, 0) for i in range(90)], vectors(5, 90, 16, 2.0**20), vectors(6, 90, 16, 2.0**24),
], ids=["odd", "few", "uneven", "repeats", "empty", "one", "equal", "long", "longer"])
def test_plain_arithmetic(spark, rows):
    assert coded(spark.createDataFrame(rows, KIND).repartition(3)) == plain(rows)


def test_whole_numbers_beyond_64_bits(spark):
    """Products beyond 64 bits are compared as Python's integers; distances are what must fit."""
    rows = [(i, [1e300, -1e18, 2.0**80] + [float(x) for x in v], 1) for i, v in enumerate(np.random.default_rng(7).normal(size=(80, 13)))]
    assert coded(spark.createDataFrame(rows, KIND)) == plain(rows)
    far = spark.createDataFrame([(i, [float(10.0**i)] * 16, 1) for i in range(0, 300, 4)], KIND)
    with pytest.raises(Exception, match="too large|too big|out of bounds|OverflowError"):
        coded(far)


def test_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame(vectors(8, 70, 16), KIND)
    assert coded(df.limit(0)) == []
    assert coded(df.where("false").unionByName(spark.createDataFrame([(1, None, 2)], KIND))) == []
    from pyspark.sql import functions as F

    assert coded(df.withColumns({c: F.lit("clash") for c in ("x", "code", "error", "of", "label_error", "part", "n")})) == coded(df)


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_bounds_hold(bits):
    rng = np.random.default_rng(9)
    entries = np.floor(rng.normal(size=(64, 4)) * 300).astype(int)
    entries[5] = entries[9]
    book = veccodes.Codebook(entries.tolist(), bits)
    parts = np.floor(rng.normal(size=(500, 4)) * 300).astype(np.int64)
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    lower, upper = book.bounds(parts / 256.0)
    assert (lower * 65536 <= exact).all() and (exact <= upper * 65536).all()
    assert bits < 4 or (lower <= upper.min(axis=1)[:, None]).mean() < 0.5  # the filter leaves few to refine
    index, distance = book.nearest(parts)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_whole_parts():
    column = pa.array([[1.0, -0.001], [], [2.5] * 5])
    assert veccodes.whole_parts(column, 2, 3).tolist() == [[[256, -1, 0], [0, 0, 0]], [[0, 0, 0], [0, 0, 0]], [[640, 640, 640], [640, 640, 0]]]


def test_sql(spark, tmp_path):
    spark.createDataFrame(vectors(10, 150, 33) + ODD, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        want = sorted((tuple(r) for r in db.sql(f"SELECT {', '.join(names)} FROM ({queries.OP13_SQL})").fetchall()), key=repr)
    got = queries.op13_vector_codes(spark, str(tmp_path))
    assert got.columns == names and sorted((tuple(r) for r in got.collect()), key=repr) == want
