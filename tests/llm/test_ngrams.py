"""The n-gram model against a plain restatement over dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from slotloom.llm import ngrams, queries

TEXTS = ["the cat sat on the mat", "The cat ate", "", None, "a b \x0b c\x1fd", "the the the", "dog on the mat\nthe cat sat", "É é", "x " * 300] * 3 + [
    "zebra unknown", "the cat", "mat mat cat on",
]


def words(text):
    return [w for w in (text or "").encode().lower().split()] + [None]


def brute(train, docs):
    uni, pairs = Counter(), Counter()
    for t in train:
        before = "start"
        for w in words(t):
            uni[w] += 1
            pairs[before, w] += 1
            before = w
    n, v = sum(uni.values()), len(uni)
    disc = lambda kinds: ngrams.kneser_ney_discounts([kinds[k] for k in (1, 2, 3, 4)])
    d = disc(Counter(pairs.values()))
    before = Counter(w for _, w in pairs)
    e = disc(Counter(before.values()))
    types = len(pairs)
    gamma = sum(e[min(c, 3) - 1] for c in before.values()) / types if types else 1.0
    follow = defaultdict(list)
    for (a, _), c in pairs.items():
        follow[a].append(c)

    def low(w):
        c = before[w]
        return (c - (e[min(c, 3) - 1] if c else 0)) / max(types, 1) + gamma / (v + 1)

    out = []
    for t in docs:
        score, base, last, known = 0.0, 0.0, "start", 0
        for w in words(t):
            cs = follow.get(last)
            if cs:
                c = pairs[last, w]
                p = (c - (d[min(c, 3) - 1] if c else 0)) / sum(cs) + sum(d[min(x, 3) - 1] for x in cs) / sum(cs) * low(w)
            else:
                p = low(w)
            score += math.log10(p)
            base += math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1)))
            known += uni[w] > 0
            last = w
        out.append((len(words(t)), known, n, base, score))
    return out


@pytest.mark.parametrize("pairs_per_shard", [20, ngrams.SHARD_PAIRS])
def test_scores_match_dictionaries(spark, monkeypatch, pairs_per_shard):
    monkeypatch.setattr(ngrams, "SHARD_PAIRS", pairs_per_shard)
    monkeypatch.setattr(ngrams, "SHARD_WORDS", 4 if pairs_per_shard == 20 else 131_072)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ngrams.score_held_out(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(TEXTS))}
    expected = brute([t for i, t in enumerate(TEXTS) if not held[i]], TEXTS)
    assert len(got) == len(TEXTS) and any(held.values())
    for i, (n, known, train, base, score) in enumerate(expected):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a b"), (3, "c c a")], "doc_id long, text string")
    model = ngrams.train_model(docs)
    scorer = ngrams.Scorer(model)
    # one-word texts: p(w | start) * p(end | w); dividing by the second part needs it alone, so sum pairs of words
    total = sum(10 ** scorer.score([t])[3][0] for t in (b"", b"a", b"b", b"c", b"unseen"))
    assert 0 < total < 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngrams.score_held_out(docs).count() == 0
    only = spark.createDataFrame([(None, None)], "doc_id long, text string")
    row = ngrams.score_documents(only, ngrams.train_model(docs)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (1, 0, 0) and row.score == 0.0


def brute3(train, docs):
    """Scores of the interpolated model of order 3 by dictionaries: raw triples, pairs by kinds of words before, words likewise."""
    triples, firsts, uni = Counter(), Counter(), Counter()
    for t in train:
        a, b = None, "start"
        for w in words(t):
            uni[w] += 1
            if b == "start":
                firsts[b, w] += 1
            else:
                triples[a, b, w] += 1
            a, b = b, w
    pairs = firsts + Counter((b, c) for _, b, c in triples)
    before = Counter(w for _, w in pairs)
    levels = []
    for counts in (triples, pairs, before):
        kinds = Counter(counts.values())
        levels.append(ngrams.kneser_ney_discounts([kinds[k] for k in (1, 2, 3, 4)]))
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0
    after = [defaultdict(list), defaultdict(list)]
    for (a, b, _), c in triples.items():
        after[0][a, b].append(c)
    for (b, _), c in pairs.items():
        after[1][b].append(c)
    types = sum(before.values())
    gamma = sum(cut(c, levels[2]) for c in before.values()) / types

    def prob(a, b, w):
        p = (before[w] - cut(before[w], levels[2])) / types + gamma / (len(uni) + 1)
        for d, cs, c in ((levels[1], after[1].get(b), pairs[b, w]), (levels[0], after[0].get((a, b)), triples[a, b, w])):
            if cs:
                p = (c - cut(c, d)) / sum(cs) + sum(cut(x, d) for x in cs) / sum(cs) * p
        return p

    out = []
    for t in docs:
        a, b, score = None, "start", 0.0
        for w in words(t):
            score += math.log10(prob(a, b, w))
            a, b = b, w
        out.append(score)
    return out


@pytest.mark.parametrize("pairs_per_shard", [20, ngrams.SHARD_PAIRS])
def test_query_scores_by_two_words_before(spark, monkeypatch, tmp_path, pairs_per_shard):
    monkeypatch.setattr(ngrams, "SHARD_PAIRS", pairs_per_shard)
    monkeypatch.setattr(ngrams, "SHARD_WORDS", 4 if pairs_per_shard == 20 else 131_072)
    all_texts = TEXTS + [f"new{i} the cat sat on new{i} mat the the" for i in range(30)]
    spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op4_ngram_scores(spark, str(tmp_path)).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(all_texts))]
    want = brute3([t for t, h in zip(all_texts, held, strict=True) if not h], all_texts)
    assert any(held[len(TEXTS) :]) and [got[i] for i in range(len(all_texts))] == pytest.approx(want, rel=1e-9)


def test_empty_table_of_order_3(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngrams.score_held_out(docs, order=3).count() == 0
    only = spark.createDataFrame([(None, None), (1, "a b c")], "doc_id long, text string")
    assert [r.score for r in ngrams.score_documents(only, ngrams.train_model(docs, order=3)).collect()] == [0.0, 0.0]
