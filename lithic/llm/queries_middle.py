"""Query of the fill-in-the-middle transformation."""

from pyspark.sql import functions as F

from lithic.llm.common import table
from lithic.llm.fill_middle import restored, transform


def op13_fill_middle(spark, sf_dir):
    cut = transform(table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {
    "op13_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || doc_id) AS h
            FROM documents
        ), k AS (
            SELECT *, len(lines) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(lines) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(lines) + 1) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                        WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), c AS (
            SELECT *, array_to_string(lines[1:least(a, b)], '') AS p, array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(lines[greatest(a, b) + 1:n], '') AS s
            FROM k
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM c
    """
}
