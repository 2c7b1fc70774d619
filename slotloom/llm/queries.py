"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Each applies its operator to a whole table.  For all of them: null texts count as empty, rows may lack an id,
repeated rows give repeated results (but for the queries of ``op8_inner_products``, which are ids), texts are
taken whole at any length, tables without rows give no rows, and further columns of a table are not looked at,
whatever their names.
"""
from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm import alignment, identifiers, identifiers_sql, media, mixing, ngrams, pieces, quality, setjoin, sharding, tokenfile, topk, toxicity, veccodes
from slotloom.llm.shared import table


def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document and what they decode to."""
    rows = pieces.encode_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "decoded_crc32", "lossless")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; without labelled rows all score alike, 0.4995."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's payload and media file as read back, its features, and its timed clips."""
    return media.text_media_digests(table(spark, sf_dir, "documents"))


def op4_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the model of the documents that are not held out; an empty text is its end alone."""
    return ngrams.score_held_out(table(spark, sf_dir, "documents"), order=3)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and taken words of every document; rows without a source are one source, the last."""
    rows = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [1, 2, 3][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM sizes GROUP BY source
), ratios AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM totals
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
  SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS common FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN ratio <= common THEN CAST(3 * source_size AS DOUBLE) ELSE common * weight END AS target FROM shared
), rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS coin
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rates
"""


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and slots of every document by rendezvous hashing of its id; rows without an id share a key."""
    rows = sharding.shard_records(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _crc_table() -> list[int]:
    """The 256 remainders of one byte by the polynomial of crc32."""
    found = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        found.append(value)
    return found


OP6_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents
), summed AS (
  SELECT doc_id, key, CAST(strlen(t) + 8 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(0, strlen(t)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
      lambda c, x: xor(c >> 8, CAST({_crc_table()}[(xor(c, x) & 255) + 1] AS BIGINT))), 4294967295) AS text_crc32
  FROM texts
), drawn AS (
  SELECT *, list_transform(range(0, 25), lambda s: CAST('0x' || substr(md5(key || '/' || CAST(s AS VARCHAR)), 1, 13) AS BIGINT)) AS d,
         CAST('0x' || substr(md5(key || ':' || CAST(text_crc32 AS VARCHAR)), 1, 13) AS BIGINT) AS place FROM summed
), dealt AS (
  SELECT *, CAST(list_position(d[1:24], list_max(d[1:24])) - 1 AS INTEGER) AS shard, CAST(list_position(d, list_max(d)) - 1 AS INTEGER) AS grown_shard FROM drawn
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM dealt
"""


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; empty sets are components of their own."""
    return setjoin.linked_components(table(spark, sf_dir, "documents"))


def op8_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best products of every vector whose id 50 divides, as in the SQL: a missing component counts as zero.

    A product with an empty vector has no terms, is null, and comes last.  A repeated query id is one query, with the
    smallest of its vectors that are not empty.
    """
    return topk.top_products(table(spark, sf_dir, "embeddings"), all_lengths=True)


OP8_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), widest AS (
  SELECT max(len(v)) AS width FROM whole
), asked AS (
  SELECT vec_id, coalesce(min(list_resize(v, width, 0)) FILTER (len(v) > 0), []) AS v FROM whole, widest WHERE vec_id % 50 = 0 GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM asked q JOIN whole c ON q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number and crc32 of every document's ids as read back from the files; rows without an id come first."""
    return tokenfile.token_file_digests(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and verdict of every document; without labelled rows of both kinds nothing is toxic."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers' tokens for every document; texts without tokens have zeros and an empty digest."""
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def op12_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans by kind, their digest, all spans, and the number of added ones, of every document; null texts have none."""
    return identifiers.find_identifiers(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector by codebooks of 64 entries for 16 parts, after two rounds; shorter vectors end in zeros."""
    return veccodes.code_table(table(spark, sf_dir, "embeddings"))


_ROUND = """, near{0} AS (
  SELECT r, x.p, min({{'d': coalesce(list_sum(list_transform(list_zip(x.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0), 'e': e}}) AS m
  FROM parts x JOIN book{0} b ON x.p = b.p GROUP BY r, x.p
), sums{0} AS (
  SELECT p, e, i, sum(c) AS s, count(*) AS n
  FROM (SELECT x.p, m.e AS e, unnest(part) AS c, generate_subscripts(part, 1) AS i FROM near{0} JOIN parts x USING (r, p)) GROUP BY p, e, i
), means{0} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS part FROM sums{0} GROUP BY p, e
), book{1} AS (
  SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM book{0} b LEFT JOIN means{0} m ON b.p = m.p AND b.e = m.e
)"""
OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sized AS (
  SELECT CAST(ceil(max(len(v)) / 16.0) AS BIGINT) AS size FROM kept
), parts AS (
  SELECT r, p, list_transform(range(0, size), lambda i: coalesce(v[p * size + i + 1], 0)) AS part FROM kept, sized, range(16) AS t(p)
), book0 AS (
  SELECT p, r - 1 AS e, part FROM parts WHERE r <= 64
){_ROUND.format(0, 1)}{_ROUND.format(1, 2)}, last AS (
  SELECT r, x.p, min({{'d': coalesce(list_sum(list_transform(list_zip(x.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0), 'e': e}}) AS m
  FROM parts x JOIN book2 b ON x.p = b.p GROUP BY r, x.p
), coded AS (
  SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM last GROUP BY r
), digest AS (
  SELECT sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i), '')) AS codebooks_sha256
  FROM (SELECT p, e, unnest(part) AS c, generate_subscripts(part, 1) AS i FROM book2)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_piece_sampling": op1_piece_sampling,
        "op2_quality": op2_quality,
        "op3_media": op3_media,
        "op4_ngram_scores": op4_ngram_scores,
        "op5_mix_sources": op5_mix_sources,
        "op6_shard": op6_shard,
        "op7_shingle_join": op7_shingle_join,
        "op8_inner_products": op8_inner_products,
        "op9_token_files": op9_token_files,
        "op10_toxicity": op10_toxicity,
        "op11_token_alignment": op11_token_alignment,
        "op12_identifiers": op12_identifiers,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": OP5_SQL, "op6_shard": OP6_SQL, "op8_inner_products": OP8_SQL, "op12_identifiers": identifiers_sql.SQL, "op13_vector_codes": OP13_SQL}
