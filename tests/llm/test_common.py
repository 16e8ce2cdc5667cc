import random

from lithic.llm import common


def test_components_equal_union_find(spark):
    rng = random.Random(12)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + i, 5001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_staged_tables_go_when_superseded(spark):
    kept = common.staged(spark.range(5))
    assert kept.count() == 5 and (spark, kept.staged_at) in common._STAGED
    common.unstage(kept)
    common.unstage(spark.range(3))
    assert (spark, kept.staged_at) not in common._STAGED


def test_slices_hold_whole_texts(spark):
    import pyarrow as pa

    texts = ["a" * 3, None, "b" * 10, "", "c" * 2, "d" * 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "t"])
    parts = list(common.text_slices(batch, 1, 5))
    assert [t for _, own in parts for t in own] == [t or "" for t in texts]
    assert [p.column(0).to_pylist() for p, _ in parts] == [[0, 1], [2], [3, 4, 5]] or [len(own) for _, own in parts] == [2, 1, 3]
