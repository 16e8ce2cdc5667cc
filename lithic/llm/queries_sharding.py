"""Query of the sharding operator."""

from pyspark.sql import functions as F

from lithic.llm.common import table
from lithic.llm.rendezvous import equal_weights, placed

SHARDS = 16


def op11_rendezvous(spark, sf_dir):
    rows = placed(table(spark, sf_dir, "documents"), equal_weights(SHARDS), equal_weights(SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: A checksum goes through the text's bytes with the table of the 256 remainders of a byte.
SQL = """
    WITH RECURSIVE bits AS (
        SELECT i, 0 AS round, i AS c FROM range(256) t(i)
        UNION ALL SELECT i, round + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE round < 8
    ), steps AS (
        SELECT list(c ORDER BY i) AS step FROM bits WHERE round = 8
    ), d AS (
        SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents
    ), summed AS (
        SELECT doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size,
               xor(list_reduce(bytes, lambda a, x: xor(a // 256, step[xor(a % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
        FROM d, steps
    ), drawn AS (
        SELECT doc_id, s, CAST('0x' || substr(md5(doc_id || ':' || s), 1, 13) AS BIGINT) AS x FROM documents, range(17) t(s)
    ), won AS (
        SELECT doc_id, arg_max(s, x) FILTER (WHERE s < 16) AS shard, arg_max(s, x) AS grown_shard FROM drawn GROUP BY doc_id
    )
    SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || ':' || size || ':' || text_crc32)) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
    FROM summed JOIN won USING (doc_id)
"""

QUERIES = {"op11_rendezvous": op11_rendezvous}
ORACLES = {"op11_rendezvous": SQL}
