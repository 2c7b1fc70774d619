"""The set join against all pairs."""

import random

import numpy as np
import pytest

from slotloom.llm import setjoin
from slotloom.llm.components import components


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, threshold):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), (min(ids) if ids else None) if sets[i] else k))
    return sorted(out, key=repr)


def near_texts(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.75:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 6)):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 20, 60, 90, 150, 400]))))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = list(enumerate(near_texts(seed))) + [(1000, None), (1001, ""), (1002, " \n"), (None, "a b c d e"), (1003, "A B c d e"), (7, "a b c d e"), (None, "only this")]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in setjoin.linked_components(docs).collect()), key=repr)
    assert got == brute(rows, 4, 85)


def test_other_parameters(spark):
    rows = list(enumerate(near_texts(3, 150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in setjoin.linked_components(docs, 5, 80).collect()), key=repr)
    assert got == brute(rows, 5, 80)


def test_empty_table(spark):
    assert setjoin.linked_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_keeps_one_of_each(spark):
    rows = list(enumerate(near_texts(4, 120))) + [(500, "a b c d e f"), (500, "a b c d e f"), (501, "A b c d e f"), (502, ""), (503, ""), (502, ""), (None, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, place string").repartition(3)
    got = setjoin.keep_one_of_each(docs, 5, 80)
    assert got.columns == docs.columns
    groups = brute(rows, 5, 80)
    expected = [*{c for _, n, c in groups if n}, *(k for k, n, _ in groups if not n)]
    assert sorted(r.doc_id for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("crowd", [2, 5, 1000])
def test_forest_settles_all_pairs(monkeypatch, crowd):
    monkeypatch.setattr(setjoin, "CROWD", crowd)
    rng = np.random.default_rng(crowd)
    base = [rng.choice(5000, 120, replace=False) for _ in range(3)]
    parts = []
    for k in range(90):
        own = base[k % 3].copy()
        own[rng.choice(120, rng.integers(0, 22), replace=False)] = rng.integers(5000, 10**6)
        parts.append(np.unique(own).astype(np.uint64))

    class Held:
        def take(self, _, local):
            return parts[local]

    forest = setjoin.Forest(Held(), 85)
    groups = [sorted(rng.choice(90, rng.integers(2, 40), replace=False).tolist()) for _ in range(40)]
    for group in groups:
        forest.group(group)
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for group in groups:
        for i, x in enumerate(group):
            for y in group[:i]:
                if setjoin.linked(parts[x], parts[y], 85):
                    parent[find(x)] = find(y)
    assert all(setjoin.linked(parts[x], parts[y], 85) for x, y in forest.edges) and len(forest.edges) == 90 - len({find(x) for x in range(90)})
    assert all((forest.find(x) == forest.find(y)) == (find(x) == find(y)) for x in range(90) for y in range(x))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(9)
    for _ in range(150):
        a = np.unique(rng.integers(0, 2**48, rng.integers(1, 400), dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.85, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**48, rng.integers(0, 1 + len(a) // 10), dtype=np.uint64)]))
        if len(b) and setjoin.linked(a, b, 85):
            signature, of = setjoin.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85)
            assert set(signature[of == 0].tolist()) & set(signature[of == 1].tolist())


@pytest.mark.parametrize("threshold", [80, 85])
def test_small_sets_against_all_pairs(threshold):
    """Sets of 1 to 14 features: every linked pair shares a signature, and no signature is shared by very many sets."""
    rng = np.random.default_rng(threshold)
    parts = [np.unique(rng.integers(0, 2**63, rng.integers(1, 15)).astype(np.uint64)) for _ in range(3000)]
    near = []
    for own in parts[:600]:
        more = rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64)
        near.append(np.unique(np.concatenate([own[rng.integers(0, 2) :], more])))
    parts += [x for x in near if len(x)]
    features, offsets = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    signature, of = setjoin.signatures(features, offsets, threshold)
    own = [set() for _ in parts]
    for s, k in zip(signature.tolist(), of.tolist()):
        own[k].add(s)
    links = 0
    for k, x in enumerate(near):
        if len(x) and setjoin.linked(x, parts[k], threshold):
            links += 1
            assert own[k] & own[3000 + sum(len(y) > 0 for y in near[:k])]
    assert links > 100
    assert np.unique(signature, return_counts=True)[1].max() < 30


def test_crowds_that_are_not_connected(monkeypatch):
    monkeypatch.setattr(setjoin, "_HELD_FEATURES", 3_000)
    monkeypatch.setattr(setjoin, "BIG", 32)
    rng = np.random.default_rng(12)
    parts = [np.sort(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(300)]
    for k in range(0, 300, 10):
        parts.append(np.unique(np.concatenate([parts[k][:57], rng.integers(0, 2**63, 2).astype(np.uint64)])))
    mapped = []

    class Held:
        def take(self, _, local):
            mapped.append(local)
            return parts[local]

    forest = setjoin.Forest(Held(), 85)
    forest.group(list(range(len(parts))))
    assert sorted(tuple(sorted(e)) for e in forest.edges) == [(k, 300 + k // 10) for k in range(0, 300, 10)]
    assert len(mapped) < 20 * len(parts)


def test_crowds_compare_few_sets_in_full(monkeypatch):
    """A cluster of near copies, most of them just too far apart to link: marks decide all but the closest pairs."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    parts = [np.unique(np.concatenate([base[rng.random(len(base)) < rng.choice([0.8, 0.88, 0.97])], rng.integers(0, 2**63, 30, dtype=np.uint64)])) for _ in range(120)]

    class Held:
        def take(self, _, local):
            return parts[local]

    sizes = np.array([len(p) for p in parts])
    for words in (8 << 20, 8 * 120):
        monkeypatch.setattr(setjoin, "_HELD_MARKS", words)
        marks = setjoin._marks(parts, sizes, [(0, 50), (50, 120)])
        apart = lambda x, y: len(parts[x]) + len(parts[y]) - 2 * setjoin._common(parts[x], parts[y])
        assert all(np.bitwise_count(marks[x] ^ marks[y]).sum() <= apart(x, y) for x in range(120) for y in range(x))
    monkeypatch.setattr(setjoin, "_HELD_MARKS", 8 << 20)
    forest, compared = setjoin.Forest(Held(), 80), []
    exact = setjoin.linked
    monkeypatch.setattr(setjoin, "linked", lambda a, b, t: compared.append(1) or exact(a, b, t))
    forest.group(list(range(120)))
    links = {(x, y) for x in range(120) for y in range(x) if exact(parts[x], parts[y], 80)}
    root = list(range(120))
    for x, y in links:
        old, new = root[x], root[y]
        root = [new if r == old else r for r in root]
    assert all((forest.find(x) == forest.find(y)) == (root[x] == root[y]) for x in range(120) for y in range(x))
    assert len(set(root)) > 20 and len(compared) < 500  # of 7,140 pairs
