"""The pipeline's stages, each against the operator that it calls and on its own input."""


import corpus_pipeline as P
from slotloom.llm import quality, toxicity
from slotloom.llm.shared import DOCUMENT_COLUMNS

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near copies", "source mix", "piece sampling"]
    toxic = {r.doc_id for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).where("toxic").collect()}
    clean = P.drop_toxic(spark, docs, FOLDER)
    assert clean.columns == list(DOCUMENT_COLUMNS)
    clean = clean.cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic
    kept = P.drop_poor(spark, clean, FOLDER).cache()
    poor = {r.doc_id for r in quality.score_documents(clean, quality.fit(clean, labels)).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in clean.collect()} - poor
    texts = {r.doc_id: r.text for r in kept.collect()}
    sets = {}
    for k, t in texts.items():
        words = t.encode().lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if j < i and find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    single = P.drop_near_copies(spark, kept, FOLDER).cache()
    assert {r.doc_id for r in single.collect()} == {find(k) for k in ids}
    mixed = P.mix_sources(spark, single, FOLDER).cache()
    assert mixed.columns == list(DOCUMENT_COLUMNS) and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    last = P.sample_pieces(spark, mixed, FOLDER).collect()
    assert len(last) == mixed.count() and all(r.lossless and r.n_pieces == len(r.piece_ids) for r in last)
    assert sorted(map(str, P.run(spark, FOLDER).collect())) == sorted(map(str, last))


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
