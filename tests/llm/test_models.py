"""Quality and toxicity: held-out accuracy, odd inputs, and their small parts against plain restatements."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from slotloom.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    known = {r.doc_id: r for r in labels.collect()}
    return docs, labels, {k: r for k, r in known.items() if zlib.crc32(str(k).encode()) % 5 == 0}


def test_quality_on_held_out_rows(data):
    docs, labels, held = data
    rows = {r.doc_id: r for r in quality.score_documents(docs, quality.fit(docs, labels)).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert {k for k in held if not rows[k].held_out} == set()
    right = np.mean([rows[k].predicted == r.quality for k, r in held.items()])
    good = [rows[k].score for k, r in held.items() if r.quality]
    bad = [rows[k].score for k, r in held.items() if not r.quality]
    assert right > 0.97 and np.mean([g > b for g in good for b in bad]) > 0.98


def test_toxicity_on_held_out_rows(data):
    docs, labels, held = data
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()}
    caught = np.mean([rows[k].toxic for k, r in held.items() if r.toxic])
    false = np.mean([rows[k].toxic for k, r in held.items() if not r.toxic])
    assert caught > 0.8 and false < 0.02
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in rows.values())


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "word " * 3000), (3, "again"), (4, "é" * 10), (5, "idiot"), (6, "fine")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    for kind in ("doc_id long, quality int, toxic int",):
        none = spark.createDataFrame([], kind)
        some = spark.createDataFrame([(i, i % 2, int(i == 5)) for i in range(1, 7)] * 2 + [(None, 1, 1), (2, None, None), (77, 1, 0)], kind)
        for labels in (none, some):
            found = quality.score_documents(docs, quality.fit(docs, labels))
            assert found.count() == len(rows) and found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
            assert quality.keep_good(docs, quality.fit(docs, labels), 0.0).count() == len(rows)
            model = toxicity.fit(docs, labels)
            assert toxicity.score_documents(docs, model).count() == len(rows)
            assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert quality.score_documents(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0
    assert toxicity.score_documents(docs.limit(0), toxicity.fit(docs.limit(0), some)).count() == 0


def test_pool_adjacent():
    rng = np.random.default_rng(2)
    y, n = rng.random(40) * 5, rng.integers(1, 9, 40).astype(float)
    knots, levels = quality.pool_adjacent(np.arange(40.0), y, n)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    # the max-min formula of isotonic regression at each point
    blocks = np.searchsorted(knots, np.arange(40.0))
    for i in range(40):
        want = max(min(y[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1))
        assert min(abs(want - x) for x in levels) < 1e-9
    assert blocks.max() <= len(levels)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(5)
    width, count = len(quality.STATISTICS), 20_000
    model = quality.Model(np.zeros(width), np.ones(width), rng.normal(0, 1 / np.sqrt(width), (width, count)), rng.uniform(0, 2 * np.pi, count), np.zeros(count + 1), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(6, width))
    z = model.features(x)[:, :-1]
    for i in range(6):
        for j in range(6):
            assert z[i] @ z[j] == pytest.approx(math.exp(-((x[i] - x[j]) ** 2).sum() / 2 / width), abs=0.05)


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(3)
    rows = [{int(i): float(x) for i, x in zip(rng.choice(6, 3, replace=False), rng.random(3) * 2)} for _ in range(600)]
    true = np.array([2.0, 1.0, 0, 0, -1, -2])
    eta = np.array([sum(true[i] * x for i, x in r.items()) for r in rows])
    grades = (eta[:, None] + rng.logistic(size=600)[:, None] > np.array([-1.0, 0.5, 2.0])).sum(1)
    weights, thresholds = toxicity.fit_ordinal(rows, grades, 6, 4)
    assert (np.diff(thresholds) > 0).all() and np.corrcoef(weights, true)[0, 1] > 0.95


def known_rows(data, grade):
    """Texts, grades and folds of the labelled rows that a fit may see, by plain Python."""
    docs, labels, _ = data
    best = {}
    for r in labels.collect():
        if r.doc_id is not None and r[grade] is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            best[r.doc_id] = max(best.get(r.doc_id, 0), r[grade])
    return [((r.text or "").encode(), best[r.doc_id], zlib.crc32(str(r.doc_id).encode()) % 5) for r in docs.collect() if r.doc_id in best]


def test_quality_query_against_one_matrix(data):
    docs, labels, _ = data
    known = known_rows(data, "quality")
    x = np.array([quality.statistics(t) for t, _, _ in known])
    y, fold = np.array([float(g > 0) for _, g, _ in known]), np.array([f for _, _, f in known])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    rng = np.random.default_rng(quality.SEED)
    width = x.shape[1]
    frequencies, phases = rng.normal(0, 1 / np.sqrt(width), (width, quality.FOURIER)), rng.uniform(0, 2 * np.pi, quality.FOURIER)
    waves = lambda v: np.hstack([np.cos(np.clip((v - mean) / scale, -8, 8) @ frequencies + phases) * np.sqrt(2 / quality.FOURIER), np.ones((len(v), 1))])
    z = waves(x)

    def ridge(rows):
        penalty = np.full(z.shape[1], quality.RIDGE * np.sqrt(rows.sum()) * 0.01)
        penalty[-1] = 1e-9 * rows.sum()
        return np.linalg.solve(z[rows].T @ z[rows] + np.diag(penalty), z[rows].T @ y[rows])

    apart = np.zeros(len(y))
    for f in np.unique(fold):
        apart[fold == f] = z[fold == f] @ ridge(fold != f)
    bins = np.floor(np.clip(apart, -0.5, 1.5) * 2000)
    order = np.unique(bins)
    mean_y, n = np.array([y[bins == b].mean() for b in order]), np.array([(bins == b).sum() for b in order])
    level = [max(min((mean_y * n)[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(order))) for a in range(i + 1)) for i in range(0, len(order), max(1, len(order) // 40))]
    model = quality.fit(docs, labels)
    assert np.allclose(model.weights, ridge(np.ones(len(y), bool)), rtol=1e-5, atol=1e-6)
    for b, want in zip(order[:: max(1, len(order) // 40)], level, strict=True):
        block = np.argmin(np.abs(model.knots - (b + 0.5) / 2000))
        assert min(abs(model.levels[max(block - 1, 0) : block + 2] - want)) < 0.02 or want in model.levels
    some = docs.limit(300).collect()
    raw = waves(np.array([quality.statistics((r.text or "").encode()) for r in some])) @ model.weights
    want = np.clip(0.999 * np.interp(raw, model.knots, model.levels) + 0.001 * np.clip(raw, 0, 1), 0, 1)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert np.allclose([got[r.doc_id] for r in some], want, atol=1e-9)


def test_toxicity_query_against_a_plain_fit(data):
    docs, labels, _ = data
    known = known_rows(data, "toxic")
    model = toxicity.fit(docs, labels)
    bags = [Counter(f for w, n in toxicity._words(t).items() for f in toxicity.word_features(w) for _ in range(n)) for t, _, _ in known]
    toxic = np.array([g > 0 for _, g, _ in known])
    total, pos = len(toxic), toxic.sum()
    seen, hits = Counter(f for b in bags for f in b), Counter(f for b, g in zip(bags, toxic) for f in b if g)
    chosen = set()
    for f, n in seen.items():
        table = np.array([[hits[f], n - hits[f]], [pos - hits[f], total - n - pos + hits[f]]], float)
        expected = table.sum(1, keepdims=True) @ table.sum(0, keepdims=True) / total
        if 3 <= n < total:
            chi = ((table - expected) ** 2 / expected).sum()
            if chi >= 24 - 1e-9 or chi >= 0.3 * total:
                chosen.add(f)
    assert set(model.index) == chosen
    raised = {f for f in chosen if hits[f] / seen[f] > pos / total}
    count = np.array([sum(n for f, n in b.items() if f in raised) for b in bags], float)
    cuts = np.quantile(count[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + (count[:, None] > cuts).sum(1), 0)
    x = np.zeros((total, len(model.index)))
    for i, b in enumerate(bags):
        for f in chosen & set(b):
            x[i, model.index[f]] = np.log1p(b[f])

    def loss(weights, thresholds):
        below = 1 / (1 + np.exp(-np.clip(np.append(thresholds, np.inf) - (x @ weights)[:, None], -40, 40)))
        p = np.diff(np.hstack([np.zeros((total, 1)), below]), axis=1)[np.arange(total), grades]
        return -np.log(np.maximum(p, 1e-12)).mean() + 0.5e-4 * (weights**2).sum()

    found = loss(model.weights, model.thresholds)
    # a plain search along coordinates and at random finds nothing that is better by more than a hair
    rng = np.random.default_rng(1)
    for _ in range(300):
        step = rng.normal(size=len(model.weights)) * rng.choice([1e-3, 1e-2, 1e-1]) * (rng.random(len(model.weights)) < 0.1)
        assert loss(model.weights + step, np.sort(model.thresholds + rng.normal(size=3) * 1e-2)) > found - 2e-4
    assert found < loss(np.zeros_like(model.weights), np.log([0.9, 0.94, 0.97]) - np.log([0.1, 0.06, 0.03]))
