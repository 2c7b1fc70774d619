"""The catalogue: every operator as a query over a data folder, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotloom.functions import text as X
from slotloom.operators import chunks, digests, gramindex, migration, replacing, revisions, search, terms
from slotloom.operators import entries as E
from slotloom.service import Engine
from slotloom.sources import downloads, files
from slotloom.sources import tables as S
from slotloom.sources.scratch import scratch
from slotloom.sources.store import Change
from slotloom.streaming import rings, uploads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Parts of the SQL that several queries share.
_ENTRIES = """entries AS (
  SELECT doc_id + 1 AS id, ['lore', 'writing_style', 'reminders', 'user_profile', 'notes'][CAST(doc_id % 5 AS INTEGER) + 1] AS file_key,
         doc_id // 5 + 1 AS entry_index, coalesce(text, '') AS content FROM documents)"""
_TURNS = "turns AS (SELECT 'c' || CAST(conv_id AS VARCHAR) AS file_key, turn AS entry_index, turn AS id, text AS content FROM conversations)"


def _trim(x: str, side: str = "trim") -> str:
    return f"{side}({x}, ' ' || chr(10) || chr(13) || chr(9) || chr(11))"


def _unix(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _split(x: str) -> str:
    parts = f"regexp_split_to_array({_unix(x)}, '\\n[ \\t\\n\\x0B\\f\\r]*\\n+')"
    return f"list_filter(list_transform({parts}, lambda e: {_trim('e')}), lambda e: e <> '')"


_SPACE = r" \t\n\x0B\f\r"
_NATURAL = (
    "array_to_string(list_transform(regexp_extract_all(regexp_replace(translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '^0+([0-9])', '\\1'), "
    f"'[0-9]+|[{_SPACE}]+|[^0-9{_SPACE}]+'), lambda r: CASE WHEN regexp_matches(r, '^[1-9]') THEN "
    "CAST(length(CAST(length(r) AS VARCHAR)) AS VARCHAR) || CAST(length(r) AS VARCHAR) || r "
    f"WHEN regexp_matches(r, '^0') THEN r || chr(1) WHEN regexp_matches(r, '^[{_SPACE}]') THEN '' ELSE r END), '')"
)
_LISTS = """lists AS (
  SELECT p_brand AS list_index, string_agg(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name || ' ' || p_size) ELSE p_name || ' ' || p_size END, ', ' ORDER BY p_partkey) AS text
  FROM part GROUP BY p_brand)"""


def _terms(source: str, key: str = "list_index") -> str:
    """CTEs pieces, firsts, sorted: the terms of a list-like CTE ``source`` (key, text)."""
    return f"""pieces AS (
  SELECT {key}, i AS place, {_trim('parts[i]')} AS term
  FROM (SELECT {key}, regexp_split_to_array({_unix('text')}, '[\\n,]+') AS parts FROM {source}), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
), firsts AS (
  SELECT {key}, place, term FROM pieces WHERE term <> '' QUALIFY row_number() OVER (PARTITION BY {key}, lower(term) ORDER BY place) = 1
), sorted AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY {_NATURAL.format('term')}, place) AS position, term FROM firsts)"""


def _add(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


# Scans and counts


@_add("entries_scan", f"WITH {_ENTRIES} SELECT id, file_key, entry_index, content FROM entries ORDER BY file_key, entry_index, id")
def entries_scan(spark, folder):
    return E.scan(S.entries(spark, folder))


@_add("slot_entries", f"WITH {_ENTRIES} SELECT id, file_key, entry_index, content FROM entries WHERE file_key = 'notes' ORDER BY entry_index, id")
def slot_entries(spark, folder):
    return E.of_slot(S.entries(spark, folder), "No tes!")


@_add("slot_entry_count", f"WITH {_ENTRIES} SELECT file_key, count(*) AS entry_count FROM entries GROUP BY file_key")
def slot_entry_count(spark, folder):
    return E.counts(S.entries(spark, folder))


_DOOMED = "doomed AS (SELECT doc_id + 1 AS id FROM labels WHERE toxic = 1)"


@_add("slots_for_ids", f"WITH {_ENTRIES}, {_DOOMED} SELECT DISTINCT file_key FROM entries WHERE id IN (SELECT id FROM doomed)")
def slots_for_ids(spark, folder):
    return E.slots_of(S.entries(spark, folder), S.doomed(spark, folder))


_COMPOSED = f"""composed AS (
  SELECT file_key, string_agg({_trim('content')}, chr(10) || chr(10) ORDER BY entry_index, id) AS content FROM turns WHERE {_trim('content')} <> '' GROUP BY file_key)"""


@_add("slot_compose", f"WITH {_TURNS}, {_COMPOSED} SELECT file_key, content FROM composed")
def slot_compose(spark, folder):
    return E.compose_groups(S.turns(spark, folder), "file_key")


# Text functions

_RAW = "CASE doc_id % 4 WHEN 0 THEN upper(file_key) WHEN 1 THEN ' ' || file_key || '!' WHEN 2 THEN source ELSE '' END"


@_add("slot_key_normalize", f"""WITH raw AS (
  SELECT doc_id, {_RAW} AS raw FROM (SELECT *, ['lore', 'writing_style', 'reminders', 'user_profile', 'notes'][CAST(doc_id % 5 AS INTEGER) + 1] AS file_key FROM documents)
), clean AS (SELECT doc_id, raw, regexp_replace(lower(raw), '[^a-z0-9_-]', '', 'g') AS k FROM raw)
SELECT doc_id, raw, CASE WHEN k IN ('lore', 'writing_style', 'reminders', 'user_profile', 'notes') THEN k ELSE 'lore' END AS file_key FROM clean""")  # fmt: skip
def slot_key_normalize(spark, folder):
    docs = S.table(spark, folder, "documents").withColumn("key", S.slot_of(F.col("doc_id")))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.upper("key")).when(kind == 1, F.concat(F.lit(" "), "key", F.lit("!"))).when(kind == 2, F.col("source")).otherwise(F.lit(""))
    return docs.select("doc_id", raw.alias("raw")).withColumn("file_key", X.slot_key(F.col("raw")))


@_add("newline_normalize", "SELECT doc_id, text AS content FROM documents")
def newline_normalize(spark, folder):
    docs = S.table(spark, folder, "documents")
    end = F.when(F.col("doc_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r"))
    return docs.select("doc_id", X.unix_newlines(F.replace("text", F.lit("\n"), end)).alias("content"))


_WIDE = "replace(text, chr(10), chr(10) || ' ' || chr(9) || chr(10))"


@_add("split_entries", f"""WITH split AS (SELECT doc_id, {_split(_WIDE)} AS e FROM documents)
SELECT doc_id, i AS position, e[i] AS entry FROM split, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i)""")  # fmt: skip
def split_entries(spark, folder):
    docs = S.table(spark, folder, "documents").select("doc_id", S.widened(F.col("text")).alias("text"))
    rows = E.with_entries(docs, "doc_id", "text")
    return rows.select("doc_id", F.col("entry_index").alias("position"), F.col("content").alias("entry"))


@_add("content_equivalence", f"""SELECT doc_id, {_split(_WIDE)} = {_split("replace(text, chr(10), chr(10) || chr(10) || chr(10)) || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE chr(10) || ' ' END")} AS equivalent FROM documents""")
def content_equivalence(spark, folder):
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.lit("\n "))
    other = F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n\n")), tail)
    return S.table(spark, folder, "documents").select("doc_id", X.equivalent(S.widened(F.col("text")), other).alias("equivalent"))


# Search


def _search_sql(needles: list[str]) -> str:
    hits = ", ".join(f"CASE WHEN contains(lower(c), lower('{n}')) THEN '{n}' END" for n in needles)
    return f"""WITH {_ENTRIES}, hits AS (
  SELECT id, file_key, entry_index, c AS content, concat_ws('|', {hits}) AS matched_terms
  FROM (SELECT *, {_trim('content')} AS c FROM entries) WHERE c <> '')
SELECT id, file_key, entry_index, content, matched_terms FROM hits WHERE matched_terms <> ''"""


def _flat(hits: DataFrame) -> DataFrame:
    return hits.withColumn("matched_terms", F.array_join("matched_terms", "|"))


@_add("search_keyword", _search_sql(["ÉOI"]))
def search_keyword(spark, folder):
    return _flat(search.search(S.entries(spark, folder), " ÉOI "))


@_add("search_terms", _search_sql(["The", "eau"]))
def search_terms(spark, folder):
    return _flat(search.search(S.entries(spark, folder), "", ["The", "eau", "The"]))


_COMBINED = ["The", "eau", "ción", "ung"]


def _combined(spark, folder):
    return search.search(S.entries(spark, folder), "ung", _COMBINED[:3])


@_add("search_combined", _search_sql(_COMBINED))
def search_combined(spark, folder):
    return _flat(_combined(spark, folder))


_CHOSEN = "chosen AS (SELECT p_brand AS list_index, CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name || ' ' || p_size ELSE lower(p_name) END AS choice FROM part)"


@_add("search_terms_validate", f"""WITH {_LISTS}, {_terms('lists')}, {_CHOSEN}, asked AS (SELECT DISTINCT list_index, {_trim('choice')} AS term FROM chosen)
SELECT list_index, term FROM asked WHERE (list_index, term) IN (SELECT list_index, term FROM sorted)""")  # fmt: skip
def search_terms_validate(spark, folder):
    even = F.concat(F.lit(" "), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))
    choice = F.when(F.col("p_partkey") % 2 == 0, even).otherwise(F.lower("p_name"))
    chosen = S.table(spark, folder, "part").select(F.col("p_brand").alias("list_index"), choice.alias("choice"))
    return search.selected_terms(S.part_lists(spark, folder), chosen)


@_add("search_page", f"SELECT * FROM ({_search_sql(_COMBINED)}) ORDER BY file_key, entry_index, id LIMIT 25 OFFSET 25")
def search_page(spark, folder):
    return _flat(search.page(_combined(spark, folder), 2))


@_add("search_page_count", f"SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS pages FROM ({_search_sql(_COMBINED)})")
def search_page_count(spark, folder):
    return search.page_count(_combined(spark, folder))


@_add("search_many_needles", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''")
def search_many_needles(spark, folder):
    return search.search_many(S.table(spark, folder, "documents"), S.table(spark, folder, "benchmark"), "doc_id", "text", "item_id", "text")


@_add("search_many_indexed", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE length(lower(b.text)) >= 3")
def search_many_indexed(spark, folder):
    """As search_many_needles, by way of a stored index of the documents' grams."""
    docs = S.table(spark, folder, "documents")
    at = scratch(spark, "index")
    gramindex.postings(docs, "doc_id", "text").write.parquet(f"{at}/grams")
    postings = spark.read.parquet(f"{at}/grams")
    gramindex.counts(postings).write.parquet(f"{at}/counts")
    return gramindex.search_many(docs, postings, spark.read.parquet(f"{at}/counts"), S.table(spark, folder, "benchmark"), "doc_id", "text", "item_id", "text")


@_add("search_page_by_rank", f"""SELECT id, file_key, entry_index, content, matched_terms FROM (
  SELECT *, row_number() OVER (ORDER BY file_key, entry_index, id) AS at_row, count(*) OVER () AS total FROM ({_search_sql(_COMBINED)}))
WHERE at_row > (least(30, ceil(total / 25.0)) - 1) * 25 AND at_row <= least(30, ceil(total / 25.0)) * 25""")
def search_page_by_rank(spark, folder):
    return _flat(search.page_by_rank(_combined(spark, folder), 30))


# Search and replace

_PREVIEW = f"""{_ENTRIES}, preview AS (
  SELECT id, entry_index, content AS original_content, replace(content, 'the', 'THE ') AS preview_content,
         CAST((length(content) - length(replace(content, 'the', ''))) // 3 AS BIGINT) AS replacement_count
  FROM entries WHERE file_key = 'lore' AND contains(content, 'the'))"""


@_add("replace_preview", f"WITH {_PREVIEW} SELECT * FROM preview")
def replace_preview(spark, folder):
    return replacing.preview(S.entries(spark, folder), "LORE", "the", "THE ")


@_add("replace_apply", f"""WITH {_PREVIEW} SELECT e.id, file_key, e.entry_index,
CASE WHEN {_trim('preview_content')} <> '' THEN {_trim('preview_content')} ELSE content END AS content FROM entries e LEFT JOIN preview p ON e.id = p.id""")
def replace_apply(spark, folder):
    return replacing.apply(S.entries(spark, folder), "lore", "the", "THE ")


# Term lists


@_add("term_lists_parse", f"WITH {_LISTS}, {_terms('lists')} SELECT list_index, position, term FROM sorted")
def term_lists_parse(spark, folder):
    return terms.parsed(S.part_lists(spark, folder))


_NORMAL = "normal AS (SELECT list_index, string_agg(term, chr(10) ORDER BY position) AS text FROM sorted GROUP BY list_index)"


@_add("term_list_normalize", f"WITH {_LISTS}, {_terms('lists')}, {_NORMAL} SELECT list_index, text FROM normal")
def term_list_normalize(spark, folder):
    return S.part_lists(spark, folder).select("list_index", X.normal_terms(F.col("text")).alias("text"))


@_add("term_lists_save", f"WITH {_LISTS}, {_terms('lists')}, {_NORMAL} SELECT list_index, text FROM normal")
def term_lists_save(spark, folder):
    return terms.saved(S.part_lists(spark, folder))


@_add("term_lists_equivalence", f"""WITH {_LISTS}, both_sides AS (
  SELECT list_index || '/a' AS list_index, text FROM lists
  UNION ALL SELECT list_index || '/b', CASE WHEN list_index = 'Brand#11' THEN text || ',one more' ELSE ' ,' || replace(text, ', ', chr(10) || ' ') || chr(10) END FROM lists
), {_terms('both_sides')}, {_NORMAL}
SELECT replace(a.list_index, '/a', '') AS list_index, a.text = b.text AS equivalent FROM normal a JOIN normal b ON a.list_index LIKE '%/a' AND b.list_index = replace(a.list_index, '/a', '/b')""")
def term_lists_equivalence(spark, folder):
    same = F.concat(F.lit(" ,"), F.replace("text", F.lit(", "), F.lit("\n ")), F.lit("\n"))
    other = F.when(F.col("list_index") == "Brand#11", F.concat("text", F.lit(",one more"))).otherwise(same)
    pairs = S.part_lists(spark, folder).withColumn("other", other)
    return terms.equivalent(pairs, "text", "other", "list_index")


@_add("term_lists_empty", f"""WITH {_LISTS} SELECT list_index, bool_and({_trim("CASE WHEN list_index LIKE '%1' THEN chr(9) || ' ' ELSE text END")} = '') AS is_empty FROM lists GROUP BY list_index""")
def term_lists_empty(spark, folder):
    blanked = F.when(F.col("list_index").endswith("1"), F.lit("\t ")).otherwise(F.col("text"))
    return terms.empty(S.part_lists(spark, folder).withColumn("text", blanked), "list_index")


# Mutations

_EVEN = "CAST(substr(file_key, 2) AS BIGINT) % 2 = 0"
_NEW = f"texts AS (SELECT file_key, 'new ' || content AS content FROM composed WHERE {_EVEN})"


def _texts(spark, folder) -> DataFrame:
    return E.compose_groups(S.turns(spark, folder), "file_key")


def _numbered(modulus: int):
    return F.substring("file_key", 2, 20).cast("long") % modulus


@_add("slot_replace", f"""WITH {_TURNS}, {_COMPOSED}, {_NEW}, split AS (SELECT file_key, {_split('content')} AS e FROM texts)
SELECT file_key, entry_index, content FROM turns WHERE file_key NOT IN (SELECT file_key FROM texts)
UNION ALL SELECT file_key, CAST(i AS BIGINT), e[i] FROM split, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i)""")
def slot_replace(spark, folder):
    texts = _texts(spark, folder).where(_numbered(2) == 0).select("file_key", F.concat(F.lit("new "), "content").alias("content"))
    return E.replace_slots(S.turns(spark, folder), texts)


@_add("slot_clear", f"WITH {_TURNS} SELECT file_key, entry_index, content FROM turns WHERE CAST(substr(file_key, 2) AS BIGINT) % 3 <> 0")
def slot_clear(spark, folder):
    rows = S.turns(spark, folder)
    cleared = rows.select("file_key").distinct().where(_numbered(3) == 0).withColumn("content", F.lit(""))
    return E.replace_slots(rows, cleared)


_UPLOADS = """uploads AS (SELECT file_key, CASE CAST(substr(file_key, 2) AS BIGINT) % 3 WHEN 0 THEN ' ' WHEN 1 THEN chr(10) || ' new text ' ELSE 'a' || chr(10) || chr(10) || 'b' END AS upload,
  CASE WHEN CAST(substr(file_key, 2) AS BIGINT) % 5 = 0 THEN ' ' ELSE content || chr(10) END AS existing FROM composed)"""


@_add("upload_append", f"""WITH {_TURNS}, {_COMPOSED}, {_UPLOADS} SELECT file_key, CASE WHEN {_trim('upload')} = '' THEN existing WHEN {_trim('existing')} = '' THEN {_trim('upload')}
ELSE {_trim('existing', 'rtrim')} || chr(10) || chr(10) || {_trim('upload')} END AS content FROM uploads""")
def upload_append(spark, folder):
    upload = F.when(_numbered(3) == 0, F.lit(" ")).when(_numbered(3) == 1, F.lit("\n new text ")).otherwise(F.lit("a\n\nb"))
    existing = F.when(_numbered(5) == 0, F.lit(" ")).otherwise(F.concat("content", F.lit("\n")))
    return _texts(spark, folder).select("file_key", X.appended(existing, upload).alias("content"))


def _region_files(spark, folder) -> str:
    target = scratch(spark, "uploads")
    rows = S.table(spark, folder, "region").select(F.concat("r_name", F.lit("\r\n\r\n"), F.col("r_regionkey").cast("string")).alias("value"))
    rows.repartitionByRange(5, "value").write.option("lineSep", "\r\n").text(target)
    return target


@_add("upload_read", """SELECT r_name || chr(13) || chr(10) || chr(13) || chr(10) || CAST(r_regionkey AS VARCHAR) || chr(13) || chr(10) AS content,
CAST(strlen(r_name || CAST(r_regionkey AS VARCHAR)) + 6 AS BIGINT) AS byte_length FROM region""")
def upload_read(spark, folder):
    """Regions written as text files with line ends of another system, read back as uploads."""
    found = files.read_uploads(spark, _region_files(spark, folder))
    return found.select("content", F.octet_length("content").cast("long").alias("byte_length"))


_EDITS = """edits AS (SELECT doc_id + 1 AS id, CASE WHEN quality = 1 THEN ' edited ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || 'second ' ELSE ' ' END AS content FROM labels)"""


@_add("entries_update", f"""WITH {_ENTRIES}, {_EDITS} SELECT e.id, file_key, entry_index, coalesce({_trim('x.content')}, e.content) AS content
FROM entries e LEFT JOIN (SELECT * FROM edits WHERE {_trim('content')} <> '') x ON e.id = x.id""")
def entries_update(spark, folder):
    return E.apply_edits(S.entries(spark, folder), S.edits(spark, folder))


@_add("entries_update_count", f"WITH {_EDITS} SELECT count(*) AS saved_count FROM edits WHERE id >= 1 AND {_trim('content')} <> ''")
def entries_update_count(spark, folder):
    return E.saved_count(S.edits(spark, folder))


@_add("delete_entries", f"""WITH {_ENTRIES}, {_DOOMED}, left_over AS (SELECT * FROM entries WHERE id NOT IN (SELECT id FROM doomed))
SELECT id, file_key, CASE WHEN file_key IN (SELECT file_key FROM entries WHERE id IN (SELECT id FROM doomed))
THEN row_number() OVER (PARTITION BY file_key ORDER BY entry_index, id) ELSE entry_index END AS entry_index, content FROM left_over""")
def delete_entries(spark, folder):
    return E.delete(S.entries(spark, folder), S.doomed(spark, folder))


@_add("delete_count", f"WITH {_ENTRIES}, {_DOOMED} SELECT count(*) AS deleted_count FROM entries WHERE id IN (SELECT id FROM doomed)")
def delete_count(spark, folder):
    return E.deleted_count(S.entries(spark, folder), S.doomed(spark, folder))


@_add("resequence", f"WITH {_ENTRIES} SELECT id, file_key, row_number() OVER (PARTITION BY file_key ORDER BY entry_index * 3, id) AS entry_index, content FROM entries")
def resequence(spark, folder):
    return E.resequence(S.entries(spark, folder).withColumn("entry_index", F.col("entry_index") * 3))


# Revisions

_RING = """ring AS (
  SELECT file_key, seq, content, saved_at, row_number() OVER (PARTITION BY file_key ORDER BY seq DESC) AS position
  FROM (SELECT *, lag(content) OVER (PARTITION BY file_key ORDER BY seq) AS before FROM log) WHERE before IS NULL OR before <> content)"""
_LOG = "log AS (SELECT user_id AS file_key, event_id AS seq, event_type AS content, CAST(floor(epoch(ts)) AS BIGINT) AS saved_at FROM events)"


@_add("revision_ring", f"WITH {_LOG}, {_RING} SELECT file_key, position, seq, content, saved_at FROM ring WHERE position <= 3")
def revision_ring(spark, folder):
    return revisions.ring(S.event_log(spark, folder)).select("file_key", "position", "seq", "content", "saved_at")


_SLOT_TEXTS = f"""slot_texts AS (
  SELECT file_key, string_agg({_trim('content')}, chr(10) || chr(10) ORDER BY entry_index, id) AS content FROM entries WHERE {_trim('content')} <> '' GROUP BY file_key)"""


@_add("revision_for_ids", f"""WITH {_ENTRIES}, {_DOOMED}, {_SLOT_TEXTS} SELECT file_key, CAST(strlen(content) AS BIGINT) AS byte_length, md5(content) AS digest
FROM slot_texts WHERE file_key IN (SELECT file_key FROM entries WHERE id IN (SELECT id FROM doomed))""")
def revision_for_ids(spark, folder):
    rows = revisions.rows_for_ids(S.entries(spark, folder), S.doomed(spark, folder))
    return downloads.text_digests(chunks.chunks(rows), "file_key")


_STORED = """stored AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY seq DESC) AS position FROM log WHERE seq % 4 <> 1)"""


def _stored(spark, folder):
    log = S.event_log(spark, folder)
    return log.withColumn("content", F.when(F.col("seq") % 4 != 1, F.col("content")))


@_add("revisions_read", f"WITH {_LOG}, {_STORED} SELECT file_key, position, content, saved_at FROM stored WHERE position <= 3")
def revisions_read(spark, folder):
    return revisions.stored_revisions(_stored(spark, folder))


@_add("revision_restore", f"WITH {_LOG}, {_STORED} SELECT file_key, content FROM stored WHERE position = 2")
def revision_restore(spark, folder):
    return revisions.restore(_stored(spark, folder), 1)


@_add("revision_display", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def revision_display(spark, folder):
    return S.event_log(spark, folder).select(F.col("seq").alias("event_id"), revisions.display_time(F.col("saved_at")).alias("shown"))


_LIST_LOG = """list_log AS (
  SELECT user_id AS file_key, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS saved_at,
         CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS text_1, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'a' || chr(10) || 'B' END AS text_2, '' AS text_3 FROM events)"""


def _list_log(spark, folder):
    some = F.col("seq") % 7 != 0
    one = F.when(some, F.concat("content", F.lit(" ,"), "content")).otherwise(F.lit(" ,"))
    two = F.when(some, F.when(F.col("seq") % 2 == 0, F.lit("B,a\n b")).otherwise(F.lit("a,B"))).otherwise(F.lit("\n"))
    return S.event_log(spark, folder).withColumn("lists", F.create_map(F.lit(1), one, F.lit(2), two)).drop("content")


@_add("list_revision_ring", f"""WITH {_LIST_LOG}, seen AS (
  SELECT *, lag(text_1) OVER (PARTITION BY file_key ORDER BY seq) AS before FROM list_log WHERE text_1 <> ''
), ring AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY seq DESC) AS position FROM seen WHERE before IS NULL OR before <> text_1)
SELECT file_key, position, seq, saved_at, text_1, text_2, text_3 FROM ring WHERE position <= 3""")
def list_revision_ring(spark, folder):
    rows = revisions.list_ring(_list_log(spark, folder), group="file_key")
    return rows.select("file_key", "position", "seq", "saved_at", *[F.element_at("lists", i).alias(f"text_{i}") for i in (1, 2, 3)])


@_add("list_revisions_read", f"""WITH {_LIST_LOG}, stored AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY seq DESC) AS position FROM list_log WHERE seq % 4 <> 1)
SELECT file_key, position, CASE WHEN seq % 7 = 0 THEN ' ,' ELSE text_1 || ' ,' || text_1 END AS text_1,
CASE WHEN seq % 7 = 0 THEN chr(10) WHEN seq % 2 = 0 THEN 'B,a' || chr(10) || ' b' ELSE 'a,B' END AS text_2, '' AS text_3, saved_at FROM stored WHERE position <= 3""")
def list_revisions_read(spark, folder):
    log = _list_log(spark, folder)
    return revisions.stored_list_revisions(log.withColumn("lists", F.when(F.col("seq") % 4 != 1, F.col("lists"))), "file_key")


# Files and migration


@_add("download_manifest", f"""WITH {_ENTRIES}, {_SLOT_TEXTS} SELECT file_key, replace(file_key, '_', '-') || '.txt' AS file_name, CAST(strlen(content) AS BIGINT) AS byte_length FROM slot_texts""")
def download_manifest(spark, folder):
    return files.manifest(S.entries(spark, folder))


_LEGACY = """legacy AS (
  SELECT CASE WHEN n_nationkey < 5 THEN ['lore', 'writing_style', 'reminders', 'user_profile', 'notes'][n_nationkey + 1] ELSE n_name END AS file_key,
         CASE WHEN n_nationkey = 1 THEN ' ' ELSE n_name || chr(10) || chr(10) || ' ' || n_regionkey END AS content FROM nation)"""


def _legacy(spark, folder) -> DataFrame:
    key, name = F.col("n_nationkey"), F.col("n_name")
    content = F.when(key == 1, F.lit(" ")).otherwise(F.concat(name, F.lit("\n\n "), F.col("n_regionkey").cast("string")))
    return S.table(spark, folder, "nation").select(F.when(key < 5, S.slot_of(key)).otherwise(name).alias("file_key"), content.alias("content"))


@_add("legacy_migrate", f"""WITH {_LEGACY}, split AS (
  SELECT file_key, {_split('content')} AS e FROM legacy WHERE {_trim('content')} <> '' AND file_key IN ('lore', 'writing_style', 'user_profile', 'notes'))
SELECT file_key, CAST(i AS BIGINT) AS entry_index, e[i] AS content FROM split, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i)""")
def legacy_migrate(spark, folder):
    return migration.migrate(_legacy(spark, folder), S.entries(spark, folder).where("file_key = 'reminders'"))


# Texts beyond one string

_CHUNK = 4_096


@_add("slot_chunks", f"""WITH {_ENTRIES}, {_SLOT_TEXTS}, sized AS (SELECT file_key, hex(encode(content)) AS h, strlen(content) AS n FROM slot_texts)
SELECT file_key, CAST(k AS BIGINT) AS chunk, CAST(least({_CHUNK}, n - k * {_CHUNK}) AS BIGINT) AS byte_length, md5(unhex(substr(h, k * {2 * _CHUNK} + 1, {2 * _CHUNK}))) AS digest
FROM sized, LATERAL (SELECT unnest(range(0, CAST(ceil(n / {float(_CHUNK)}) AS BIGINT))) AS k)""")
def slot_chunks(spark, folder):
    rows = chunks.chunks(S.entries(spark, folder), limit=_CHUNK)
    return rows.select("file_key", "chunk", F.octet_length("bytes").cast("long").alias("byte_length"), F.md5("bytes").alias("digest"))


@_add("slot_digest_equivalence", f"""WITH {_TURNS}, {_COMPOSED}
SELECT file_key, {_split('content')} = {_split("content || CASE WHEN CAST(substr(file_key, 2) AS BIGINT) % 3 = 0 THEN chr(10) || chr(10) || 'x' ELSE chr(10) || ' ' || chr(10) END")} AS equivalent FROM composed""")
def slot_digest_equivalence(spark, folder):
    """Entries against texts to be saved, by digests; no slot is composed on the entries' side."""
    tail = F.when(_numbered(3) == 0, F.lit("\n\nx")).otherwise(F.lit("\n \n"))
    texts = _texts(spark, folder).select("file_key", F.concat("content", tail).alias("content"))
    return digests.equal(digests.digest(S.turns(spark, folder)), digests.of_texts(texts))


# The engine over a store of the documents

_NOW = datetime(2024, 1, 2, 3, 4, 5)


def _engine(spark, folder) -> Engine:
    engine = Engine(spark, scratch(spark, "store"))
    rows = S.entries(spark, folder).withColumn("updated_at", F.lit(_NOW).cast("timestamp_ntz"))
    after = rows.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    engine.store.commit(engine.store.state(), {"entries": Change(rows)}, next_id=after)
    return engine


def _kept(engine: Engine) -> DataFrame:
    return engine.entries().select("id", "file_key", "entry_index", "content")


def _ring_of(engine: Engine) -> DataFrame:
    name = F.concat_ws("/", "file_key", F.col("seq").cast("string")).alias("name")
    pieces = engine.store.read("revision_pieces").select(name, (F.col("piece") * chunks.CHUNK_BYTES).alias("offset"), F.encode("content", "utf-8").alias("bytes"))
    newest = Window.partitionBy("file_key").orderBy(F.desc("seq"))
    heads = engine.store.read("revisions").select("file_key", F.row_number().over(newest).cast("long").alias("position"), name)
    return heads.join(downloads.text_digests(pieces, "name"), "name").select("file_key", "position", "byte_length", "digest")


@_add("service_edit", ORACLE["entries_update"])
def service_edit(spark, folder):
    """Entries of a store after edits from a client."""
    engine = _engine(spark, folder)
    engine.edit_all(S.edits(spark, folder), _NOW)
    return _kept(engine)


@_add("service_delete", ORACLE["delete_entries"])
def service_delete(spark, folder):
    """Entries of a store after a client's deletions."""
    engine = _engine(spark, folder)
    engine.delete([r.id for r in S.doomed(spark, folder).collect()], _NOW)  # what a client sends is a list
    return _kept(engine)


@_add("service_delete_revisions", f"""WITH {_ENTRIES}, {_DOOMED}, {_SLOT_TEXTS} SELECT file_key, CAST(1 AS BIGINT) AS position, CAST(strlen(content) AS BIGINT) AS byte_length, md5(content) AS digest
FROM slot_texts WHERE file_key IN (SELECT file_key FROM entries WHERE id IN (SELECT id FROM doomed))""")
def service_delete_revisions(spark, folder):
    """What a client's deletions leave as revisions."""
    engine = _engine(spark, folder)
    engine.delete([r.id for r in S.doomed(spark, folder).collect()], _NOW)
    return _ring_of(engine)


@_add("service_save_restore", f"""WITH {_ENTRIES}, {_SLOT_TEXTS}, split AS (SELECT file_key, {_split('content')} AS e FROM slot_texts WHERE file_key = 'notes')
SELECT file_key, CAST(i AS BIGINT) AS entry_index, e[i] AS content FROM split, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i)
UNION ALL SELECT 'lore', CAST(1 AS BIGINT), 'new text'""")
def service_save_restore(spark, folder):
    """Two slots of a store: one saved whole, one cleared and restored from its newest revision."""
    engine = _engine(spark, folder)
    engine.save("lore", " new text\n\n", _NOW)
    engine.clear("notes", _NOW)
    engine.restore("notes", 0, _NOW)
    return engine.entries().where("file_key IN ('lore', 'notes')").select("file_key", "entry_index", "content")


@_add("service_search", f"{_search_sql(['ÉOI'])}")
def service_search(spark, folder):
    """Hits of a client's search by the store's index."""
    engine = _engine(spark, folder)
    engine.build_index()
    return _flat(engine.hits(" ÉOI "))


@_add("service_lists", f"""WITH {_LISTS}, {_terms('lists')}, {_NORMAL}, numbered AS (
  SELECT row_number() OVER (ORDER BY list_index) AS list_index, text FROM normal WHERE list_index IN ('Brand#11', 'Brand#12', 'Brand#13'))
SELECT CAST(list_index AS INTEGER) AS list_index, text FROM numbered""")
def service_lists(spark, folder):
    """Term lists of a store that were saved, replaced and restored."""
    engine = Engine(spark, scratch(spark, "store"))
    own = S.part_lists(spark, folder).where(F.col("list_index").isin("Brand#11", "Brand#12", "Brand#13")).orderBy("list_index").collect()  # what a client sends
    engine.save_lists({k: r.text for k, r in enumerate(own, 1)}, _NOW)
    engine.save_lists({1: "other"}, _NOW)
    engine.restore_lists(0, _NOW)
    return engine.store.read("term_lists").where("text <> ''")


@_add("service_slot", ORACLE["slot_entries"])
def service_slot(spark, folder):
    """One slot of a store; its files alone are read."""
    return _engine(spark, folder).slot("No tes!")


@_add("service_migrate", ORACLE["legacy_migrate"].replace("'writing_style', 'user_profile'", "'writing_style', 'reminders', 'user_profile'"))
def service_migrate(spark, folder):
    """Entries of a store that was opened twice beside a legacy table among files."""
    at, legacy = scratch(spark, "store"), scratch(spark, "legacy")
    _legacy(spark, folder).write.parquet(legacy)
    Engine(spark, at, legacy=legacy, now=_NOW)
    return Engine(spark, at, legacy=legacy, now=_NOW).entries().select("file_key", "entry_index", "content")


@_add("download_files", f"""WITH {_ENTRIES}, {_SLOT_TEXTS} SELECT replace(file_key, '_', '-') || '.txt' AS file_name, CAST(strlen(content) AS BIGINT) AS byte_length, md5(content) AS digest FROM slot_texts""")
def download_files(spark, folder):
    """The files of all downloads, as executors wrote them."""
    at = scratch(spark, "downloads")
    downloads.write(S.entries(spark, folder), at)
    return downloads.written(spark, at)


# Streams


@_add("upload_stream", "SELECT 'notes' AS file_key, unnest([r_name, CAST(r_regionkey AS VARCHAR)]) AS content FROM region")
def upload_stream(spark, folder):
    """Entries of a slot that text files were streamed into."""
    engine = Engine(spark, scratch(spark, "store"))
    stream = uploads.upload_stream(spark, _region_files(spark, folder), lambda name: F.lit("notes"), files_at_once=2)
    uploads.append_upload_stream(engine, stream, scratch(spark, "uploads-check"), _NOW, once=True).awaitTermination()
    return engine.entries().select("file_key", "content")


@_add("revision_ring_stream", ORACLE["revision_ring"].replace("SELECT user_id AS file_key", "SELECT CAST(user_id AS VARCHAR) AS file_key"))
def revision_ring_stream(spark, folder):
    """Rings of users that the stream of events leaves; their state is kept in RocksDB."""
    setting, at = "spark.sql.streaming.stateStore.providerClass", scratch(spark, "rings")
    before = spark.conf.get(setting)
    spark.conf.set(setting, rings.PROVIDER)
    try:
        events = spark.readStream.schema(S.table(spark, folder, "events").schema).parquet(f"{folder}/event[s].parquet")  # a pattern, as a plain path has to be a folder
        log = S.as_log(events)
        rings.write_rings(rings.ring_stream(log), f"{at}/rings", f"{at}/check", once=True).awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return rings.read_rings(spark, f"{at}/rings").select("file_key", "position", "seq", "content", "saved_at")
