import numpy as np

from lithic.llm import impact_topk as t


def brute(rows, asked, k):
    out = []
    for q, w in asked:
        best = sorted(((-int(np.dot(v, w)), i) for i, v in rows if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_small_shards_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    heavy = [(i, (rng.standard_cauchy(12) * 9).clip(-900, 900).astype(int).tolist()) for i in range(300)]
    rows = heavy + [(300 + i, heavy[7][1]) for i in range(200)] + [(500, [0] * 12)]
    index = spark.createDataFrame(rows, "id long, v array<int>")
    asked = index.where("id % 25 = 0")
    got = t.top_k(index, asked, 5, shard=64, block=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 25 == 0], 5)


def test_index_stops_before_the_last_level():
    rng = np.random.default_rng(1)
    vectors = (rng.standard_cauchy((4000, 16)) * 20).clip(-3000, 3000).astype(int)
    index = t.ImpactIndex(vectors)
    found = {q: rows for q, rows, _ in index.search(vectors[:20], 3, np.arange(20))}
    exact = vectors @ vectors[:20].T
    for q in range(20):
        exact[q, q] = -(10**12)
        assert set(np.argsort(-exact[:, q])[:3]) <= set(found[q]) and len(found[q]) < 100


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.001], 1), (1, None, 2), (2, [nan, 1.0], 3), (3, [inf, 1.0], 4), (4, [0.0, 0.0], 5), (5, [None, 1.0], 6), (6, [0.5, 0.5], 7), (6, [0.5, 0.5], 8), (None, [1.0, 1.0], 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    index = t.quantised(vectors, "vec_id", "embedding")
    assert {(r.id, tuple(r.v)) for r in index.collect()} == {(0, (256, -1)), (4, (0, 0)), (6, (128, 128))}
    got = sorted(map(tuple, t.top_k(index, index, 5).collect()))
    one = [(0, 1, 6, 32640), (0, 2, 6, 32640), (0, 3, 4, 0)]
    assert [r for r in got if r[0] == 0] == one and [r for r in got if r[0] == 4] == [(4, 1, 0, 0), (4, 2, 6, 0), (4, 3, 6, 0)]
    assert t.top_k(index.limit(0), index, 5).count() == 0 and t.top_k(index, index.limit(0), 5).count() == 0


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(rng.uniform(-9e6, 9e6)), *(float(x) for x in rng.standard_normal(7) * 1e5)]) for i in range(40)] + [(100 + i, [float(x) for x in rng.integers(-(2**21), 2**21, 8)]) for i in range(40)]
    index = t.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    plain = {r.id: [int(x) for x in r.v] for r in index.collect()}
    assert max(abs(x) for v in plain.values() for x in v) > 2**31 - 1
    expected = []
    for q in plain:
        best = sorted((-sum(a * b for a, b in zip(plain[q], v)), i) for i, v in plain.items() if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, t.top_k(index, index, 5, shard=20, block=30).collect())) == sorted(expected)


def test_products_beyond_doubles():
    rng = np.random.default_rng(5)
    v, w = rng.integers(2**29, 2**30, (35, 6)), rng.integers(2**29, 2**30, 6)
    assert t.products(v, w).tolist() == [sum(int(a) * int(b) for a, b in zip(x, w)) for x in v]
    with np.testing.assert_raises(OverflowError):
        t.products(v * 2**20, w)


def test_repeated_queries_and_other_dimensions(spark):
    index = spark.createDataFrame([(0, [1, 0]), (0, [1, 0]), (1, [2, 0]), (2, [1, 1]), (3, [9, 9, 9])], "id long, v array<long>")
    got = sorted(map(tuple, t.top_k(index, index.where("id in (0, 3)"), 2).collect()))
    assert got == [(0, 1, 1, 2), (0, 2, 2, 1)]
