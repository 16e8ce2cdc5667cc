import numpy as np
import pytest

from lithic.llm import hard_negatives as h

SCHEMA = "id long, label long, v array<double>"


def brute(rows, asked, scale, positives=5, negatives=10):
    whole = [(i, label, [int(np.floor(x * scale)) for x in v]) for i, label, v in rows]
    out = []
    for a, label, v in sorted((i, lab, [int(np.floor(x * scale)) for x in v]) for i, lab, v in asked):
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, lab) for i, lab, w in whole if i != a)
        own = [(i, -s) for s, i, lab in scored if lab == label][:positives]
        for k, (p, ps) in enumerate(own):
            inside = [(i, -s) for s, i, lab in scored if lab != label and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out += [(a, p, k + 1, n + 1, i, ps, s) for n, (i, s) in enumerate(inside)]
    return sorted(out)


def got(spark, rows, asked, **more):
    mined = h.mine(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA), **more)
    return sorted(map(tuple, mined.collect()))


def test_equals_brute_force_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 4)), rng.standard_normal(6).round(2).tolist()) for i in range(700)]
    rows += [(1000 + i, i % 4, rows[11][2]) for i in range(200)] + [(2000 + i, 3, rows[12][2]) for i in range(100)]
    asked = [r for r in rows if r[0] % 5 == 0]
    expected = brute(rows, asked, 8.0)
    assert got(spark, rows, asked, scale=8.0, anchor_bytes=1) == expected  # 64 anchors in a block
    monkeypatch.setattr(h, "_ROWS", 7)
    monkeypatch.setattr(h, "_COLUMNS", 50)
    block = h.Block(np.array([a for a, _, _ in asked]), np.array([x for _, x, _ in asked]), np.floor(np.array([v for _, _, v in asked]) * 8))
    ids, labels, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.floor(np.array([r[2] for r in rows]) * 8)
    best = h.Best(len(asked), 5)
    for at in range(0, len(rows), 50):
        h.positives_of(block, ids[at : at + 50], labels[at : at + 50], vectors[at : at + 50], best)
    rank = np.arange(len(best.group)) - np.searchsorted(best.group, best.group)
    block.windows(best.group, rank, best.score, 5, 30, 90)
    found = h.Best(len(asked) * 5, 10)
    for at in range(0, len(rows), 50):
        h.negatives_of(block, ids[at : at + 50], labels[at : at + 50], vectors[at : at + 50], found)
    assert sorted((int(block.ids[g // 5]), int(g % 5) + 1, int(i), int(s)) for g, i, s in zip(found.group, found.id, found.score)) == sorted((a, k, i, s) for a, _, k, _, i, _, s in expected)


def test_large_products_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(x) for x in rng.integers(-(2**30), 2**30, 3)]) for i in range(40)]
    assert got(spark, rows, rows[:10], scale=1) == brute(rows, rows[:10], 1)
    with pytest.raises(Exception, match="does not fit"):
        got(spark, [(0, 0, [2.0**40]), (1, 0, [2.0**40])], [(0, 0, [2.0**40])], scale=1)


def test_edge_cases(spark):
    one = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 1, [0.5, 0.0]), (3, 1, [0.5, 9.0]), (4, 2, [-1.0, 0.0])]
    assert got(spark, one, one[:1], scale=10) == [(0, 1, 1, 1, 2, 100, 50), (0, 1, 1, 2, 3, 100, 50)]
    assert got(spark, one, one[4:], scale=10) == []  # no other row of its label
    assert got(spark, one + one, one[:1], scale=10) == [(0, 1, k, n, i, 100, 50) for k in (1, 2) for n, i in enumerate((2, 2, 3, 3), 1)]
    assert got(spark, one + [(9, 0, [1.0, 0.0, 5.0])], one[:1] + one[:1] + [(0, 7, [3.0, 3.0])], scale=10) == got(spark, one, one[:1], scale=10)
    assert got(spark, [], [], scale=10) == [] and got(spark, one, [], scale=10) == []
    negative = [(0, 0, [1.0]), (1, 0, [-1.0]), (2, 1, [-0.5])]
    assert got(spark, negative, negative[:1], scale=10) == []


def test_rows_that_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0], 1, "a"), (1, None, 1, "b"), (2, [nan], 1, "c"), (3, [inf], 1, "d"), (4, [None], 1, "e"), (5, [1.0], None, "f"), (None, [1.0], 1, "g"), (7, [], 1, "h")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")
    assert [tuple(r) for r in h.usable(table, "vec_id", "label", "embedding").collect()] == [(0, 1, [1.0])]


def test_tasks_give_few_rows_each(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, i % 3, rng.standard_normal(4).tolist()) for i in range(3000)], SCHEMA).repartition(8)
    mined = h.mine(rows, rows.where("id % 300 = 0"))
    assert 0 < mined.count() <= 10 * 5 * 10
    shares = h.scores_by_rank(mined).collect()
    assert all(0.3 <= s.share <= 0.9 for s in shares)
