"""Every operator and stage on odd tables: nulls in any column, clashing extra columns, repeats, long texts, no rows."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotloom.llm import alignment, identifiers, media, mixing, ngrams, pieces, quality, setjoin, sharding, tokenfile, topk, toxicity, veccodes
from slotloom.llm.shared import DOCUMENT_COLUMNS

CLASHES = ["score", "key", "text_hash", "class", "place", "held_out", "shard", "slot", "copies", "size", "target", "grade", "toxic", "fold", "x", "bucket", "block", "segment", "uid", "kind", "base", "start", "groups"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "plain words in a row", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id at all here", "en", None, 1), (None, None, None, None, None),
        (4, "word " * 30_000, "en", "b", 1), (5, "same text twice over", "en", "a", 1), (5, "same text twice over", "en", "a", 1), (6, "same text twice over", "de", "b", 2),
        (7, " \n\t ", "en", "b", 3), (8, "stupid idiot", "en", "c", 3), (9, "é" * 200, "fr", "c", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(1, 1, 0), (8, 0, 1), (None, 1, 1), (5, None, 0), (5, 1, None), (77, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def apply_all(docs, labels):
    yield pieces.encode_documents(docs)
    yield quality.score_documents(docs, quality.fit(docs, labels))
    yield media.text_media_digests(docs)
    yield ngrams.score_held_out(docs, order=3)
    yield mixing.mixed_sizes(docs)
    yield sharding.shard_records(docs)
    yield setjoin.linked_components(docs)
    yield tokenfile.token_file_digests(docs)
    yield toxicity.score_documents(docs, toxicity.fit(docs, labels))
    yield alignment.align_documents(docs, with_groups=True)
    yield identifiers.find_identifiers(docs)


def test_operators(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    want = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    for found in apply_all(docs, labels):
        assert sorted(str(r.doc_id) for r in found.select("doc_id").collect()) == want


def rows_of(found):
    return sorted(repr(tuple(sorted(r.asDict(recursive=True).items()))) for r in found.collect())


def test_values_do_not_depend_on_clashing_columns_order_or_parts(spark, docs, folder):
    """The clashing table's results are those of a bare table in another order and other partitions."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bare = docs.select(*DOCUMENT_COLUMNS).orderBy(F.desc("text")).repartition(5)
    for k, (found, want) in enumerate(zip(apply_all(docs, labels), apply_all(bare, labels), strict=True)):
        assert rows_of(found) == rows_of(want), k


def test_values(spark, docs, folder):
    """Defined results of the odd rows."""
    by = lambda df, *columns: Counter((r.doc_id, *(r[c] for c in columns)) for r in df.collect())
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    words = lambda t: len(t.encode().split())
    pieces_ = pieces.encode_documents(docs).collect()
    assert Counter((r.doc_id, r.decoded_crc32) for r in pieces_) == Counter((i, zlib.crc32(t.encode())) for i, t in texts)
    assert all(r.lossless and bool(r.piece_ids) == (r.decoded_crc32 != 0) for r in pieces_)
    scores = ngrams.score_held_out(docs, order=3)
    assert by(scores, "n_tokens", "held_out") == Counter((i, words(t) + 1, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0) for i, t in texts)
    assert by(mixing.mixed_sizes(docs), "size") == Counter((i, words(t)) for i, t in texts)
    shards = sharding.shard_records(docs)
    assert by(shards, "size", "text_crc32") == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in [[r for r in shards.collect() if r.shard == s] for s in range(24)])
    sizes = {"plain words in a row": 2, "no id at all here": 2, "same text twice over": 1, "stupid idiot": 1, "é" * 200: 1, "word " * 30_000: 1}
    first = {"same text twice over": 5}
    assert by(setjoin.linked_components(docs), "n_shingles", "component_id") == Counter((i, sizes.get(t, 0), first.get(t, i)) for i, t in texts)
    tokens = sorted(((r.start, r.doc_id, r.n_tokens) for r in tokenfile.token_file_digests(docs).collect()))
    assert [i for _, i, _ in tokens] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i)) and tokens[0][0] == 0
    assert all(a[0] + a[2] == b[0] for a, b in zip(tokens, tokens[1:])) and Counter(n for _, _, n in tokens)[1] == 4
    media_ = media.text_media_digests(docs)
    assert by(media_, "n_bytes", "tail_crc32") == Counter((i, len(t.encode()), zlib.crc32((t.encode() + b"\0" * (-len(t.encode()) % 64 or 64 * (not t)))[-64:])) for i, t in texts)


def test_values_of_alignment_and_identifiers(spark, docs):
    pair = alignment.Pair(*alignment.public_files())
    aligned = alignment.align_documents(docs).collect()
    want = Counter((r.doc_id, *((len(pair.a.encode(" " + r.text, add_special_tokens=False).ids), len(pair.b.encode(r.text)), True) if r.text else (0, 0, False))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_a, r.n_b, r.groups_sha256 != "") for r in aligned) == want
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in aligned)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "mail a@b.c"), (None, "mail a@b.c"), (4, "x" * 50_000 + " +1 (743) 555-3824")]
    spans = identifiers.find_identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.spans) for r in spans) == Counter((i, {"mail a@b.c": "email:5:10"}.get(t, "phone:50001:50018" if t and t.endswith("3824") else "")) for i, t in rows)


def test_codes_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], None), (None, [3.0], 1), (5, None, 1), (6, [None], 1), (7, [], None), (8, [float("inf")], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("x", "code", "of", "label_error")})
    found = veccodes.code_table(df).collect()
    assert sorted(((r.vec_id, r.error, r.label_error) for r in found), key=repr) == sorted([(0, 0, 0), (0, 0, 0), (None, 0, 0), (7, 0, 0)], key=repr)
    assert len({r.codebooks_sha256 for r in found}) == 1 and all(len(r.code) == 32 for r in found)
    assert veccodes.code_table(df.limit(0)).count() == 0


def test_inner_products_with_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [None, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [9.0, 9.0]), (3, []), (150, [float("nan"), 1.0]), (4, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("w", "norm", "score", "rank", "query_id", "side")})
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(df, all_lengths=True).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 256 * 128 * 3), (0, 2, 2, 256 * 128 * 3), (0, 3, 4, 65536), (0, 4, 3, None)]
    assert topk.top_products(df.limit(0), all_lengths=True).count() == 0


def test_pipeline(spark, docs, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, now, folder).collect()
        if name != "piece sampling":
            assert stage(spark, now, folder).columns == list(DOCUMENT_COLUMNS)
            now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.lossless for r in rows)
    one = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert sorted(str(r.doc_id) for r in one) == sorted(map(str, [1, 2, 3, None, None, 4, 5, 7, 8, 9]))
