import duckdb
import numpy as np

from lithic.plans import queries


def test_vector_topk_answers_every_stated_query(spark, sf):
    rows = {i: np.array(v, dtype=np.float64) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()}
    want = {}
    for q in (i for i in rows if i % 50 == 0):
        score = {i: round(float(rows[q] @ v / np.linalg.norm(rows[q]) / np.linalg.norm(v)), 6) for i, v in rows.items() if i != q}
        want[q] = sorted(score, key=lambda i: (-score[i], i))[:5]
    got = {}
    for r in queries.QUERIES["vector_topk"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
