import numpy as np

from lithic.llm import lsh_multiprobe as m
from lithic.llm.common import table
from lithic.llm.queries_ann import op2_multiprobe


def exact(rows, q, k):
    w = rows[q]
    cos = {i: float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)) for i, v in rows.items() if i != q}
    return sorted(cos.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_recall_on_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table(spark, sf, "embeddings").collect()}
    got = {}
    for r in op2_multiprobe(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert sorted(found, key=lambda x: (-x[2], x[1])) == found
        best = exact(rows, q, 5)
        hits += len({i for i, _ in best} & {i for _, i, _ in found})
        assert all(abs(s - float(rows[q] @ rows[i] / np.linalg.norm(rows[q]) / np.linalg.norm(rows[i]))) < 1e-12 for _, i, s in found)
    assert hits >= 0.9 * 5 * len(got)


def test_hot_bucket_is_split_and_ties_are_settled(spark):
    rng = np.random.default_rng(5)
    same = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, same) for i in range(300)] + [(i, rng.standard_normal(4).tolist()) for i in range(300, 400)]
    frame = m.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted(map(tuple, m.nearest(frame, frame.where("id in (0, 7, 299)"), 3, cell=40, asked=2).select("query_id", "rank", "vec_id").collect()))
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (7, 1, 0), (7, 2, 1), (7, 3, 2), (299, 1, 0), (299, 2, 1), (299, 3, 2)]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [-inf, 1.0], 1), (5, [None, 1.0], 1), (6, [2.0, 0.0], 1), (6, [0.0, 1.0], 1), (7, [], 1), (None, [1.0, 1.0], 1)]
    frame = m.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), "vec_id", "embedding")
    assert sorted(r.id for r in frame.collect()) == [0, 6, 6]
    assert [tuple(r) for r in m.nearest(frame, frame.where("id = 0"), 5).collect()] == [(0, 1, 6, 1.0)]
    assert m.nearest(frame, frame.limit(0), 5).count() == 0 and m.nearest(frame.limit(0), frame, 5).count() == 0


def test_probing_reaches_its_share_at_any_size():
    share = 1 - 0.04 ** (1 / 3)
    rng = np.random.default_rng(3)
    for n in (10**3, 10**6, 10**9, 10**12):
        k = m.functions_of(n, share)
        hashing = m.Hashing(np.zeros((1, 1, k)), np.zeros((1, k)), m.WIDTH, 1.0, share)
        for _ in range(3):
            chances = hashing._chances(rng.random(k) * m.WIDTH)
            moves = m._best_moves(chances, share)
            reached = np.prod([chances[i, moves[:, i] + m.REACH] for i in range(k)], axis=0).sum()
            assert reached >= share and len(moves) <= 4 * m.MOST


def test_planted_neighbours_are_found(spark):
    """5,000 vectors, one neighbour each at a known distance: as many are found as the probing aims at."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((2500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    step = rng.standard_normal(base.shape)
    step -= (step * base).sum(axis=1, keepdims=True) * base
    near = base + 0.3 * step / np.linalg.norm(step, axis=1, keepdims=True)
    rows = [(2 * i, v.tolist()) for i, v in enumerate(base)] + [(2 * i + 1, v.tolist()) for i, v in enumerate(near)]
    frame = m.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = m.nearest(frame, frame.where("id % 50 = 0"), 1).collect()
    assert len(got) == 100 and sum(r.vec_id == r.query_id + 1 for r in got) >= 90


def test_vectors_of_another_dimension_and_repeated_queries(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0])]
    frame = m.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    asked = frame.where("id in (0, 3)")
    got = sorted(map(tuple, m.nearest(frame, asked.union(asked), 5).select("query_id", "rank", "vec_id").collect()))
    assert got == [(0, 1, 1), (0, 2, 2)]
