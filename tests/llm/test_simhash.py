import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from lithic.llm import simhash_golay as g

SCHEMA = "doc_id long, text string, fp long, id string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, p), (b, q) in itertools.combinations(rows, 2):
        if (p ^ q).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def test_golay_code_is_perfect():
    words = np.arange(1 << 12, dtype=np.int64) << 11
    code = words | g._syndromes(words)
    assert not g._syndromes(code).any()
    for e in (0, 1, 1 << 22, 0b10100000001, 7 << 9):
        assert (g.codewords(code ^ e) == g.codewords(code)).all()


def test_every_pair_within_three_bits_shares_a_key():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    pairs = [(b, b ^ sum(1 << k for k in rng.sample(range(64), n))) for b in base for n in (1, 2, 3) for _ in range(8)]
    prints = np.array([p for pair in pairs for p in pair], dtype=np.uint64).view(np.int64)
    key, row, asks = g.keys(prints)
    filed, asked = [set() for _ in prints], [set() for _ in prints]
    for k, r, a in zip(key.tolist(), row.tolist(), asks.tolist()):
        (asked if a else filed)[r].add(k)
    for i in range(0, len(prints), 2):
        assert filed[i] & asked[i + 1] and filed[i + 1] & asked[i]


def test_matches_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    expected = plain_components(rows)
    got = {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in g.near_duplicates(docs).collect()}
    assert got == {i: (p, expected[i]) for i, p in rows}


def test_planted_chains_of_fingerprints(spark, monkeypatch):
    rng = random.Random(1)
    prints, texts = [], []
    for _ in range(30):
        p = rng.getrandbits(64)
        for _ in range(6):
            prints.append(p)
            p ^= sum(1 << k for k in rng.sample(range(64), rng.choice((1, 2, 3, 4))))
    edges_in = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    links = edges_in.distinct().mapInArrow(g._keyed, "key long, fp long, asks boolean").repartition("key").sortWithinPartitions("key").mapInArrow(g._linked, "a long, b long").collect()
    ids = {p: i for i, p in enumerate(dict.fromkeys(prints))}
    expected = plain_components([(i, p) for p, i in ids.items()])
    from lithic.llm.common import components

    pairs = spark.createDataFrame([(ids[r.a % 2**64], ids[r.b % 2**64]) for r in links], "a long, b long")
    roots = {r.node: r.root for r in components(pairs).collect()}
    assert {i: roots.get(i, i) for i in ids.values()} == expected


def test_edge_cases(spark):
    long = "word " * 70_000 + "end"
    docs = spark.createDataFrame([(5, None, 1, "x"), (3, "", 2, "y"), (9, " \t\n", 3, None), (1, "A b C d", 4, "z"), (1, "a B c D", 4, "z"), (None, "a b c d", 5, "q"), (8, long, 6, "w")], SCHEMA)
    got = g.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (3, 3), (5, 3), (8, 8), (9, 3)]
    assert {r.fingerprint for r in got if r.doc_id in (3, 5, 9)} == {0}
    assert [r.fingerprint % 2**64 for r in got if r.doc_id == 8] == [plain_fingerprint(long)]
    kept = g.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 3, 8]


@pytest.mark.parametrize("make", [g.near_duplicates, g.one_of_each])
def test_empty_table(spark, make):
    assert make(spark.createDataFrame([], SCHEMA)).count() == 0
