import numpy as np

from lithic.llm import lsh_multiprobe as m

from .test_ann import exact


def test_queries_far_from_all_groups_get_their_nearest(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 64))
    rows = {i: (centres[i % 30] + 0.02 * rng.standard_normal(64) if i % 20 else rng.standard_normal(64)) for i in range(3000)}
    frame = m.usable(spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    asked = [i for i in rows if i % 100 == 0 or i % 50 == 7]
    got = {}
    for r in m.nearest(frame, frame.where("id % 100 = 0 or id % 50 = 7"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert all(len(got.get(q, [])) == 5 for q in asked)
    far = [q for q in asked if q % 20 == 0]
    assert len(far) == 30 and all([i for _, i in sorted(got[q])] == [i for i, _ in exact(rows, q, 5)] for q in far)


def test_tiny_tables_give_every_candidate(spark):
    rng = np.random.default_rng(2)
    frame = m.usable(spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(4)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert m.nearest(frame, frame, 5).count() == 12
