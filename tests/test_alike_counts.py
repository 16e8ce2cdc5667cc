"""Rows of a label are compared by blocks, with the result of the join of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.functions import vectors as vc
from lithic.operators import evaluation as ev
from lithic.operators import search as se
from lithic.plans import queries


def test_pairs_are_not_joined(spark, sf):
    plan = queries.QUERIES["semantic_match"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("block_bytes", [se.BLOCK_BYTES, 150])
def test_counts_are_those_of_all_pairs(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(se, "_ROWS", 3)
    monkeypatch.setattr(se, "_COLUMNS", 5)
    rng = random.Random(3)
    vector = lambda: [rng.choice((1.0, 1.0, 0.5, -0.25)) for _ in range(3)]
    rows = [(i, rng.choice((0, 1, 2)), vector()) for i in range(120)]
    rows += [(200, 0, None), (202, 1, []), (204, 2, [0.0, 0.0, 0.0]), (206, 0, [1.0, None, 1.0]), (208, 1, [1.0, 1.0]), (210, 9, [1.0, 1.0, 1.0]), (212, None, vector()), (None, 0, vector()), (4, 0, vector())]
    rows += [(300, 5, [1.0, 1.0, 1.0]), (301, 5, [float("nan"), 1.0, 1.0]), (303, 5, [1.0, 0.0, 0.0]), (400, 6, [1.0, 1.0, 0.0]), (401, 6, [-1.0, -0.5, 0.0]), (500, 7, [float("inf"), 1.0, 0.0]), (501, 7, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, label int, v array<double>").repartition(3)
    got = se.alike_counts(v.where("id % 2 = 0"), v, ev.COSINE, block_bytes)
    joined = v.where("id % 2 = 0").alias("a").join(v.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("b.id") != F.col("a.id")))
    near = joined.select(F.col("a.id"), vc.cosine(F.col("a.v"), F.col("b.v")).alias("c"))
    want = near.groupBy("id").agg(F.count("*").alias("pairs"), F.count_if(ev.alike(F.col("c"))).alias("matches"), F.max("c").alias("closest"))
    key = lambda r: (r.id, r.pairs, r.matches, repr(np.round(r.closest, 9) + 0.0))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert got.count() > 60 and got.dtypes == want.dtypes


def test_no_queries(spark):
    v = spark.createDataFrame([(1, 0, [1.0]), (3, 0, [1.0])], "id long, label int, v array<double>")
    assert se.alike_counts(v.where("id = 2"), v, ev.COSINE).collect() == []
