"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP2 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3
), win AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM g
), rep AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM win WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
         length(regexp_replace(array_to_string(w, ''), '\P{{L}}', '', 'g')) AS n_letters,
         length(regexp_replace(array_to_string(w, ''), '\P{{Lu}}', '', 'g')) AS n_upper,
         len(list_distinct(list_filter(w, lambda x: x IN ({_STOPS})))) AS n_stops
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1
         AND n_dup_lines / n_lines <= 0.4 AND n_ellipsis / n_lines <= 0.3 AND n_bullets / n_lines <= 0.9
         AND n_letters / word_chars >= 0.6 AND n_stops >= 2 AND n_upper / word_chars <= 0.4 AS kept
FROM b
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, len(w[p : p + least(len(w), 5) - 1]) AS n, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bs),
ds AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (n, g) GROUP BY ALL
), m AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM hits JOIN m USING (item_id)
WHERE 100 * n_shared >= 80 * n_item
"""

OP3 = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS h, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS b FROM pages
), e AS (
  SELECT page_id, n, min(page_id) OVER (PARTITION BY h) AS least,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (substr(b, 5 * i + j + 1, 1)::INT) << (4 - j)))::INT, 1)), '') AS digest
  FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM e
"""

OP7 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, p, array_to_string(w[p : p + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY s) AS c FROM g) WHERE c > 1
), gone AS (
  SELECT r, list(DISTINCT q) AS q FROM (SELECT r, unnest(range(p, p + 35)) AS q FROM twice) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(q), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN q IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(q, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": OP2, "op3_warc_converter": OP3, "op5_decontamination": OP5, "op7_substring_dedup": OP7}
