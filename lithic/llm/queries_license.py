"""Query of the licence scan."""

from lithic.llm.common import table
from lithic.llm.license_scan import PHRASES, SHARE, TEMPLATES, scan


def op6_license(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _words(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


#: Every word with its place; phrases and key phrases are looked for behind each place of their first word.
SQL = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), places AS (
    SELECT doc_id, w, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), phrases(p, label) AS (
    VALUES {", ".join(f"({_words(p)}, '{label}')" for p, label in PHRASES)}
), base AS (
    SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels
    FROM places JOIN phrases ON word = p[1] AND w[i:i + len(p) - 1] = p GROUP BY doc_id
), templates(t, k, ahead, label) AS (
    VALUES {", ".join(f"({_words(t.text)}, {_words(t.key)}, {t.key_at}, '{t.label}')" for t in TEMPLATES)}
), starts AS (
    SELECT doc_id, w, t, label, i - ahead AS s FROM places JOIN templates ON word = k[1] AND w[i:i + len(k) - 1] = k
), shares AS (
    SELECT doc_id, label, len(list_filter(range(1, len(t) + 1), lambda j: s + j - 1 >= 1 AND w[CAST(greatest(s + j - 1, 1) AS BIGINT)] = t[j])) / CAST(len(t) AS DOUBLE) AS share FROM starts
), found AS (
    SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM shares WHERE share >= {SHARE} GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

QUERIES = {"op6_license": op6_license}
ORACLES = {"op6_license": SQL}
