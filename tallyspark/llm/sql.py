"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tallyspark.llm import chat, divergence

SUBSTRING = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), f AS (
  SELECT g, min(doc_id) AS first FROM p GROUP BY g
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM p JOIN f USING (g) WHERE first < doc_id
), a AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w
), kept AS (
  SELECT a.doc_id, string_agg(ws[a.k], ' ' ORDER BY a.k) AS s, count(*) AS n
  FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.k = r.k WHERE r.k IS NULL GROUP BY 1
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

SUFFIX = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents
), p AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99)) AS i FROM b)
), q AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS occurrence FROM p
), later AS (
  SELECT doc_id, i FROM q WHERE occurrence > 1
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM later)
), spans AS (
  SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM runs GROUP BY 1, 2
), gaps AS (
  SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_, hi,
         lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next FROM spans
), cut AS (
  SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (lo - from_) AS BIGINT)), '' ORDER BY lo) || substr(any_value(h), CAST(2 * max(hi) + 1 AS BIGINT)) AS kept
  FROM gaps JOIN b USING (doc_id) GROUP BY 1
)
SELECT b.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN cut USING (doc_id)
"""


LINES = r"""
WITH a AS (
  SELECT doc_id, text, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), l AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS flat, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM a) WHERE flat <> ''
), w AS (
  SELECT doc_id, k, s, len(string_split(flat, ' ')) AS n, lead(s) OVER o AS s2, lead(s, 2) OVER o AS s3,
         lead(len(string_split(flat, ' '))) OVER o AS n2, lead(len(string_split(flat, ' ')), 2) OVER o AS n3 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), runs AS (
  SELECT doc_id, k, 1 AS span, s AS g FROM w WHERE n >= 3
  UNION ALL SELECT doc_id, k, 2, s || chr(10) || s2 FROM w WHERE n + n2 >= 3
  UNION ALL SELECT doc_id, k, 3, s || chr(10) || s2 || chr(10) || s3 FROM w WHERE n + n2 + n3 >= 3
), f AS (
  SELECT span, g, min(doc_id) AS first FROM runs GROUP BY 1, 2
), r AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + span)) AS k FROM runs JOIN f USING (span, g) WHERE first < doc_id
), gone AS (
  SELECT l.doc_id, l.i FROM l JOIN r USING (doc_id, k)
)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY a.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM a LEFT JOIN gone USING (doc_id, i) LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY 1) USING (doc_id)
GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.SQL, "op4_substring_dedup": SUBSTRING, "op9_line_dedup": LINES, "op10_suffix_dedup": SUFFIX, "op11_source_divergence": divergence.SQL}
