import math
import random
import zlib
from collections import Counter
from hashlib import md5

import pytest

from lithic.llm import rendezvous as r


def brute(key, weights):
    u = {s: (int(md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 1) / 16**13 for s, w in weights.items() if w > 0}
    return min((-math.log(u[s]) / weights[s], s) for s in u)[1]


def test_placed_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights, after = r.equal_weights(16), r.equal_weights(17)
    rows = r.placed(docs, weights, after).collect()
    texts = {d.doc_id: (d.text or "").encode() for d in docs.collect()}
    assert sorted(x.doc_id for x in rows) == sorted(texts)
    for x in rows:
        assert (x.size, x.text_crc32) == (len(texts[x.doc_id]) + 1, zlib.crc32(texts[x.doc_id]))
        assert x.shard == brute(x.doc_id, weights) and x.grown_shard == brute(x.doc_id, after) and x.grown_shard in (x.shard, 16)
    gapless(rows)


def gapless(rows):
    slots = {}
    for x in rows:
        slots.setdefault(x.shard, []).append(x.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def test_weights_give_shares_and_few_rows_move(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before, after = {0: 1.0, 1: 2.0, 2: 5.0, 7: 0.0}, {0: 1.0, 1: 2.0, 2: 4.0, 9: 1.0}
    rows = r.assigned(docs, before, after).collect()
    shares = Counter(x.shard for x in rows)
    assert set(shares) == {0, 1, 2} and all(abs(shares[s] / 20_000 - before[s] / 8) < 0.015 for s in shares)
    for x in rows:  # only the shard that grew lighter gives rows, and the new one alone or others take them
        assert x.shard == x.grown_shard or x.shard == 2 or x.grown_shard == 9
    went = {(m.shard, m.grown_shard): m.n for m in r.moved(docs, before, after).collect()}
    assert sum(went.values()) == 20_000 and sum(n for (a, b), n in went.items() if a != b) < 20_000 * 0.26


def test_hot_keys_and_copies(spark):
    rng = random.Random(1)
    rows = [(5, f"text {rng.random()}", 1) for _ in range(3000)] + [(9, "same", 2)] * 9000 + [(None, None, 3), (None, "", 4)] + [(100 + i, "same", 5) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = r.placed(docs, r.equal_weights(3)).collect()
    assert len(got) == len(rows) and len({x.shard for x in got if x.doc_id == 9}) == 1
    gapless(got)
    assert {(x.size, x.text_crc32) for x in got if x.doc_id is None} == {(1, 0)}
    window = next(line for line in r.placed(docs, r.equal_weights(3))._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line and "order#" in line)
    assert "bucket#" in window and "shard#" in window


def test_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a" * 3_000_000, "x", "y", "z"), (2, "é", "x", "y", "z")], "doc_id long, text string, shard string, drawn string, grown_shard string")
    both = r.assigned(docs, r.equal_weights(4), r.equal_weights(5))
    assert both.columns == ["doc_id", "text", "drawn", "shard", "grown_shard"] and [x.drawn for x in both.collect()] == ["y", "y"]
    alone = r.assigned(docs, r.equal_weights(4))
    assert alone.columns == ["doc_id", "text", "drawn", "grown_shard", "shard"]
    assert {x.size for x in r.placed(docs, r.equal_weights(4)).collect()} == {3_000_001, 3}
    assert r.placed(docs.limit(0), r.equal_weights(4)).count() == 0
    with pytest.raises(ValueError):
        r.assigned(docs, {0: 0.0})
    r.write(docs, f"{tmp_path}/out", r.equal_weights(4))
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {(x.doc_id, x.shard) for x in back.collect()} == {(x.doc_id, x.shard) for x in alone.collect()}
