"""Every vector is a query, and a pair is computed once for both its rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.functions import vectors as vc
from lithic.operators import evaluation as ev
from lithic.operators import search as se
from lithic.plans import queries


def test_every_vector_is_a_query(spark, sf):
    embeddings = duckdb.read_parquet(f"{sf}/embeddings.parquet")  # noqa: F841  read by the SQL
    got = queries.QUERIES["semantic_match"](spark, sf).select("vec_id", "pairs", "matches", "closest").collect()
    want = duckdb.sql(queries.ORACLES["semantic_match"]).fetchall()
    near = lambda rows: sorted((i, p, m, round(c + 0.0, 5)) for i, p, m, c in rows)
    assert near(map(tuple, got)) == near(want) and len(got) == duckdb.sql("SELECT count(DISTINCT vec_id) FROM embeddings").fetchall()[0][0]


@pytest.mark.parametrize("block_bytes", [se.BLOCK_BYTES, 150])
@pytest.mark.parametrize("same", [True, False])
def test_all_pairs_of_a_table_with_itself(spark, monkeypatch, block_bytes, same):
    monkeypatch.setattr(se, "_TILE", 3, raising=False)
    rng = random.Random(4)
    vector = lambda: [rng.choice((1.0, 1.0, 0.5, -0.25)) for _ in range(3)]
    nan = float("nan")
    rows = [(i, rng.choice((0.0, 0.0, 1.0, nan)), vector()) for i in range(90)]
    rows += [(200, 0.0, None), (201, 0.0, []), (202, 0.0, [0.0, 0.0, 0.0]), (203, 0.0, [1.0, None, 1.0]), (204, 1.0, [1.0, 1.0]), (205, 9.0, [1.0, 1.0, 1.0]), (None, 0.0, vector()), (206, None, vector()), (4, 0.0, vector()), (300, 5.0, [nan, 1.0, 1.0]), (301, 5.0, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, label double, v array<double>").repartition(3)
    got = se.alike_counts(v, v if same else v.select("*"), ev.COSINE, block_bytes)
    joined = v.alias("a").join(v.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("b.id") != F.col("a.id")))
    near = joined.select(F.col("a.id"), vc.cosine(F.col("a.v"), F.col("b.v")).alias("c"))
    want = near.groupBy("id").agg(F.count("*").alias("pairs"), F.count_if(ev.alike(F.col("c"))).alias("matches"), F.max("c").alias("closest"))
    key = lambda r: (r.id, r.pairs, r.matches, repr(np.round(r.closest, 9) + 0.0))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert got.count() > 90 and got.dtypes == want.dtypes
