"""The query of ``identifiers`` in SQL."""

from __future__ import annotations

from slotloom.llm.identifiers import KINDS


def _matches(kind: str, base: bool, pattern: str) -> str:
    """Matches of a pattern with the pieces of text beside them."""
    return f"""
  SELECT uid, '{kind}' AS kind, {base} AS base, unnest(range(1, len(h) + 1)) AS place, unnest(h) AS value, unnest(p[1:len(h)]) AS before, unnest(p[2:]) AS after
  FROM (SELECT uid, regexp_extract_all(t, '{pattern}', 0) AS h, regexp_split_to_array(t, '{pattern}') AS p FROM docs) WHERE len(h) > 0"""


_SHAPES = [
    ("email", True, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", True, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", True, r"[0-9](?:[\x20-]?[0-9])+"), ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"[\p{L}\p{N}._%+-]+(?:@|\x20?[\[(]at[\])]\x20?)[\p{L}\p{N}.-]*[\p{L}\p{N}]"), ("ip", False, r"[0-9]{1,3}(?:[.,:-][0-9]{1,3}){3}"),
    ("card", False, r"[0-9]{12,}"), ("phone", False, r"\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){1,4}"),
]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _plain(word: str) -> str:
    return f"translate({word}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')"


_LAST = _plain(r"regexp_extract(before, '([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*\z', 1)")
_SECOND = _plain(r"regexp_extract(before, '([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*\z', 1)")
_FOLLOWING = _plain(r"regexp_extract(after, '\A[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)', 1)")
_ROUND = """, reliable{1} AS (
  SELECT pattern, sum(coalesce(score, 0)) // (count(*) + 1) AS score FROM edges LEFT JOIN known{0} USING (instance) GROUP BY pattern
  HAVING sum(coalesce(score, 0)) // (count(*) + 1) >= 800000
), known{1} AS (
  SELECT instance, 1000000 AS score FROM seeds
  UNION ALL SELECT instance, max(score) FROM edges JOIN reliable{1} USING (pattern) WHERE instance NOT IN (SELECT instance FROM seeds) GROUP BY instance
)"""
_DIGIT = "CAST(digits[length(digits) - k] AS BIGINT)"

SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents
), raw AS ({" UNION ALL ".join(_matches(*shape) for shape in _SHAPES)}
), placed AS (
  SELECT uid, kind, base, value, right(before, 64) AS before, left(after, 64) AS after, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
         sum(length(before) + length(value)) OVER (PARTITION BY uid, kind, base ORDER BY place) AS stop FROM raw
), sound AS (
  SELECT *, CAST(stop - length(value) AS BIGINT) AS start,
         NOT regexp_matches(before, '[0-9][\x20.,:-]\z') AND NOT regexp_matches(after, '\A[\x20.,:-][0-9]') AS ended FROM placed
  WHERE CASE WHEN base THEN CASE kind
      WHEN 'email' THEN true
      WHEN 'ip' THEN regexp_matches(value, '\A{_PART}(?:\.{_PART}){{3}}\z')
      WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(digits)),
        lambda k: CASE WHEN k % 2 = 0 THEN {_DIGIT} ELSE 2 * {_DIGIT} - CASE WHEN {_DIGIT} > 4 THEN 9 ELSE 0 END END)) % 10 = 0
      ELSE length(digits) BETWEEN 9 AND 15 END
    ELSE NOT regexp_matches(before, '[A-Za-z0-9]\z') AND NOT regexp_matches(after, '\A[A-Za-z0-9]') END
), base_spans AS (
  SELECT uid, start, stop FROM sound WHERE base
), loose AS (
  SELECT * FROM sound s WHERE NOT base AND CASE kind
      WHEN 'email' THEN true
      WHEN 'ip' THEN ended AND regexp_matches(value, '\A{_PART}(?:[.,:-]{_PART}){{3}}\z')
      WHEN 'card' THEN length(digits) <= 19
      ELSE ended AND length(digits) BETWEEN 7 AND 15 END
    AND NOT EXISTS (SELECT 1 FROM base_spans b WHERE b.uid = s.uid AND b.start < s.stop AND s.start < b.stop)
), every AS (
  SELECT uid, kind, base, start, CAST(stop AS BIGINT) AS stop, kind || ':' || CASE kind
      WHEN 'email' THEN translate(regexp_replace(value, '\x20?[\[(]at[\])]\x20?', '@', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      WHEN 'ip' THEN regexp_replace(value, '[.,:-]', '.', 'g') WHEN 'card' THEN digits ELSE right(digits, 9) END AS instance,
    {_LAST} AS last, {_SECOND} AS second, {_FOLLOWING} AS following
  FROM (SELECT * FROM sound WHERE base UNION ALL SELECT * FROM loose)
), edges AS (
  SELECT instance, pattern FROM (
    SELECT instance, kind || ' ' || second || ' ' || last || ' _' AS pattern FROM every WHERE second <> '' AND last <> ''
    UNION ALL SELECT instance, kind || ' ' || last || ' _ ' || following FROM every WHERE last <> '' AND following <> '') GROUP BY ALL
), seeds AS (
  SELECT DISTINCT instance FROM every WHERE base
), known0 AS (
  SELECT instance, 1000000 AS score FROM seeds
){"".join(_ROUND.format(k, k + 1) for k in range(3))}, ordered AS (
  SELECT *, list_position(['email', 'ip', 'card', 'phone'], kind) AS ordinal FROM every WHERE base OR instance IN (SELECT instance FROM known3)
), clear AS (
  SELECT *, max(CASE WHEN NOT base THEN stop END) OVER (PARTITION BY uid, base ORDER BY start, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ordered
), spans AS (
  SELECT uid, base, kind, ordinal, start, kind || ':' || start || ':' || stop AS span FROM clear WHERE base OR coalesce(reached, 0) <= start
)
SELECT doc_id, {", ".join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in KINDS)},
       sha256(coalesce(string_agg(span, ',' ORDER BY ordinal, start) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY ordinal, start), '') AS spans, count(*) FILTER (NOT base) AS n_added
FROM docs LEFT JOIN spans USING (uid) GROUP BY uid, doc_id
"""
