"""Top inner products against all products."""

import math

import numpy as np
import pytest

from slotloom.llm import queries, topk


def brute(rows, k=5, every=50):
    good = {}
    whole = []
    width = max((len(v) for _, v in rows if v), default=0)
    for i, v in rows:
        if i is None or not v or len(v) != width or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(256 * x) for x in v]))
    for i, v in whole:
        if i % every == 0:
            good[i] = min(good.get(i, v), v)
    out = []
    for q, v in good.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("part_rows", [100, topk.PART_ROWS])
def test_matches_all_products(spark, monkeypatch, part_rows):
    monkeypatch.setattr(topk, "PART_ROWS", part_rows)
    monkeypatch.setattr(topk, "HEAD", 20)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 16)) * rng.gamma(1.0, 1.0, (700, 1))
    base[200:260] = base[5]
    base[300:320] = 0
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(base)]
    rows += [(700, None), (750, [None] * 16), (800, [float("nan")] * 16), (850, [float("inf")] * 16), (900, [1.0]), (None, [1.0] * 16), (50, rows[51][1]), (950, [-3.0] * 16), (1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(df).collect())
    assert got == brute(rows)


def test_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_products(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_products(spark.createDataFrame([(1, [1.0]), (2, [2.0])], kind)).count() == 0
    two = topk.top_products(spark.createDataFrame([(0, [1.0, 2.0]), (2, [2.0, 0.5]), (3, [-1.0, 0.0])], kind))
    assert sorted((r["rank"], r.vec_id, r.score) for r in two.collect()) == [(1, 2, 256 * 512 + 512 * 128), (2, 3, -256 * 256)]


def by_sql(folder):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
        return sorted(db.sql(queries.OP8_SQL).fetchall())


def by_query(spark, folder):
    return sorted(map(tuple, queries.op8_inner_products(spark, str(folder)).collect()))


@pytest.mark.parametrize("kind", ["one longer", "mixed", "with empty", "only empty"])
def test_lengths_as_in_sql(spark, tmp_path, kind):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)] + [(200, None), (250, [1.0, None]), (300, [float("inf")]), (None, [2.0] * 9)]
    if kind == "one longer":
        rows.append((7_001, [0.5] * 9))
    elif kind == "mixed":
        rows += [(350, [4.0]), (400, [1.0, -2.0, 3.0]), (401, [9.0]), (450, [1.0] * 12)]
    elif kind == "with empty":
        rows = [(0, [1.0, 2.0]), (50, []), (51, []), (3, [-1.0]), (4, []), (100, [3.0] * 3), (52, [])]
    else:
        rows = [(0, []), (50, []), (7, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = by_sql(tmp_path)
    assert want and by_query(spark, tmp_path) == want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_great_components_as_in_sql(spark, tmp_path, kind):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3)]) for i in range(120)]
    rows += [(150, [140_000.0, 1.0, -2.5]), (151, [-3.0e6, 140_000.25, 0.0]), (200, [9.0e6, -1.0, 3.0]), (201, [9.0e6, -1.0, 3.0]), (202, [1.1e7, 0.0, 1.0]), (250, [0.0, 0.0, 1.5e7])]
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = by_sql(tmp_path)
    assert max(r[3] for r in want) > 2**61 and by_query(spark, tmp_path) == want


def test_only_great_components(spark):
    rows = [(0, [2.0**23, 1.0]), (1, [2.0**23, 2.0]), (2, [2.0**23, 2.0]), (50, [-(2.0**23), 3.0])]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, all_lengths=True)
    assert sorted(map(tuple, got.collect())) == brute(rows, k=3)


def test_scores_beyond_64_bits(spark):
    kind = "vec_id long, embedding array<double>"
    far = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 4.0]), (3, [-0.0, -5.0])]
    two = topk.top_products(spark.createDataFrame(far, kind), k=2)  # the product beyond comes after both others
    assert sorted(map(tuple, two.collect())) == [(0, 1, 2, 0), (0, 2, 3, 0)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_products(spark.createDataFrame(far, kind), k=3).collect()


def as_written(spark, rows, kind="double", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    return sorted(map(tuple, topk.top_products(df, all_lengths=True, **more).collect()))


@pytest.mark.parametrize("dense", [True, False])
def test_whole_numbers_above_the_doubles(spark, dense):
    """Thousands of long vectors, whose scores have more than 53 bits, on both ways of multiplying."""
    rng = np.random.default_rng(11)
    whole = rng.integers(-(2**20), 2**20, size=(4_000, 8)) if dense else np.where(rng.random((4_000, 8)) < 0.3, rng.integers(-(2**22), 2**22, size=(4_000, 8)), rng.integers(-9, 9, size=(4_000, 8)))
    rows = [(i, [float(x) + float(f) / 256 for x, f in zip(v, rng.integers(0, 256, 8))]) for i, v in enumerate(whole)]
    got = as_written(spark, rows)
    assert got == brute(rows) and any(abs(r[3]) > 2**53 and r[3] % 2 for r in got)


def test_long_vectors_that_nearly_cancel(spark):
    """A query of great norm with candidates at right angles: scores are far below what doubles' rounding leaves certain."""
    rng = np.random.default_rng(12)
    rows = [(0, [float(2**21)] * 4 + [-float(2**21)] * 4)]
    for i in range(1, 900):
        half = rng.integers(-(2**20), 2**20, 4)
        rows.append((i, [float(x) for x in half] + [float(x) + float(e) / 256 for x, e in zip(rng.permutation(half), rng.integers(0, 9, 4))]))
    assert as_written(spark, rows) == brute(rows)


@pytest.mark.parametrize("scale", [1.3 * 2.0**22, 2.0**40])
def test_norms_at_and_beyond_the_bound(spark, scale):
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) * (scale if i % 7 == 0 else 1.0) for x in v]) for i, v in enumerate(rng.uniform(-1, 1, size=(400, 3)))] + [(700, [scale] * 3), (701, [-scale] * 3)]
    if scale < 2**30:
        assert as_written(spark, rows) == brute(rows)
    else:  # scores among the best have more than 64 bits, which a long cannot hold
        with pytest.raises(Exception, match="beyond 64 bits"):
            as_written(spark, rows)


def test_exact_products_stop_at_short_candidates():
    rng = np.random.default_rng(14)
    vectors = rng.normal(size=(9_000, 4)) * np.exp2(rng.integers(0, 60, (9_000, 1)))
    ids, own, asked = np.arange(9_000), np.array([3, 8]), vectors[[3, 8]]
    got = topk._exact_best(own, asked, ids, vectors, 5)
    whole = [topk._integers(v) for v in vectors]
    for q in own.tolist():
        want = sorted((-sum(a * b for a, b in zip(whole[q], w)), c) for c, w in enumerate(whole) if c != q)[:5]
        assert [(c, s) for i, c, s in got if i == q] == [(c, -s) for s, c in want]


def test_repeated_query_ids_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(15)
    rows = [(i % 120, [float(x) for x in rng.normal(size=4)]) for i in range(300)] + [(0, []), (50, [0.5]), (50, [-9.0, 1.0]), (100, []), (250, []), (250, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert by_query(spark, tmp_path) == by_sql(tmp_path)
