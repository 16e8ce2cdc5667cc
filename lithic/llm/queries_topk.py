"""Query of the exact top-k operator."""

from pyspark.sql import functions as F

from lithic.llm.common import table
from lithic.llm.impact_topk import quantised, top_k

K = 5


def op3_exact_topk(spark, sf_dir):
    index = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(index, index.where(F.col("id") % 50 == 0), K)


QUERIES = {"op3_exact_topk": op3_exact_topk}
ORACLES = {
    "op3_exact_topk": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), ranked AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), numbered AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM ranked
        )
        SELECT query_id, rank, vec_id, score FROM numbered WHERE rank <= 5
    """
}
