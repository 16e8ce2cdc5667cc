import random
import time

import pytest
from pyspark.sql import functions as F

from lithic.operators import evaluation as ev


def plain(pairs):
    taken, done, out = set(), set(), []
    for g, f, e in sorted({(str(g), f, e) for g, e, f in pairs if e is not None and f is not None}):
        if (g, f) not in done and (g, e) not in taken:
            done.add((g, f))
            taken.add((g, e))
            out.append((g, e, f))
    return sorted(out)


@pytest.mark.parametrize("few", [0, 10**9])
def test_rounds_equal_the_plain_loop(spark, few):
    rng = random.Random(9)
    sparse = [(rng.choice(("a", "b", None)), rng.randrange(60), rng.randrange(60)) for _ in range(500)]
    full = [("full", e, f) for e in range(12) for f in range(15)]
    chain = [("chain", i + d, i) for i in range(40) for d in (0, 1)]
    pairs = sparse + full + chain + sparse[:40] + [("a", None, 3), ("a", 3, None)]
    got = ev.assigned(spark.createDataFrame(pairs, "k string, expected_at long, found_at long"), ["k"], few=few).collect()
    assert sorted((str(r.k), r.expected_at, r.found_at) for r in got) == plain(pairs)


def test_a_group_of_a_million_pairs(spark):
    n = 200_000
    rows = spark.range(n * 5).select(F.lit("one").alias("k"), (F.col("id") % n).alias("expected_at"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("found_at"))
    began = time.time()
    got = ev.assigned(rows, ["k"], few=1000)
    assert sorted((r.k, r.expected_at, r.found_at) for r in got.collect()) == plain([tuple(r) for r in rows.collect()])
    assert time.time() - began < 240


def test_no_group_and_other_columns(spark):
    pairs = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 1, "z"), (2, 2, "w")], "expected_at int, found_at int, note string")
    got = ev.assigned(pairs, []).collect()
    assert sorted((r.expected_at, r.found_at) for r in got) == [(1, 1), (2, 2)] and got[0].note in ("x", "y", "w")
    assert ev.assigned(pairs.limit(0), []).count() == 0
