"""Query of the suffix-array deduplication."""

from lithic.llm.common import table
from lithic.llm.suffix_dedup import repeats


def op4_suffix_dedup(spark, sf_dir):
    return repeats(table(spark, sf_dir, "documents"))


#: Every 100-byte string of a text in hexadecimal, cut from blocks of 1,000 starts, by its MD5.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
b AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2198) AS part, least(1000, n - 99 - o) AS windows
  FROM (SELECT *, unnest(range(0, greatest(n - 99, 0), 1000)) AS o FROM n)),
w AS (SELECT doc_id, o + i AS i, md5_number(substr(part, 2 * i + 1, 200)) AS k FROM (SELECT *, unnest(range(windows)) AS i FROM b)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT *, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS fresh FROM r),
j AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM j GROUP BY 1, 2),
t AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY 1),
p AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s
  UNION ALL SELECT n.doc_id, coalesce(max(z), 0), n.n FROM n LEFT JOIN s USING (doc_id) GROUP BY n.doc_id, n.n),
k AS (SELECT p.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM p JOIN n USING (doc_id) GROUP BY 1)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id) JOIN k USING (doc_id)
"""

QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES = {"op4_suffix_dedup": REPEATS}
