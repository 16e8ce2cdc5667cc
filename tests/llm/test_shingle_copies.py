import itertools
import random
import re

import corpus_pipeline
from lithic.llm import shingle_copies as s
from lithic.llm import simhash_golay as g
from lithic.llm.common import table


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_components(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(i, plain_set(t)) for i, t in rows], 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}


def test_matches_brute_force_on_documents(spark, sf):
    docs = table(spark, sf, "documents")
    expected = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in g.alike(docs).collect()} == expected
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == {i for i, root in expected.items() if i == root}


def test_stage_takes_copies_down_to_four_fifths(spark, sf):
    rng = random.Random(3)
    rows = []
    for n in range(6, 60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for k in range(0, 14, 2):
            rows.append((len(rows), " ".join(words[: n - k] if k % 4 else [*words[:-1], *(f"x{k}_{i}" for i in range(k))])))
    # many with one passage in common, and nothing else
    passage = " ".join(f"p{i}" for i in range(12))
    rows += [(len(rows) + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(i % 7))) for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "ONE ")]
    expected = plain_components(rows)
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert {r.doc_id for r in got.collect()} == {i for i, root in expected.items() if i == root}


def test_edge_cases(spark):
    same = "a b c d e f g h"
    frame = spark.createDataFrame([(None, same), (3, same), (4, same), (4, "else"), (None, "alone")], "doc_id long, text string")
    got = sorted((tuple(r) for r in g.alike(frame).collect()), key=repr)
    assert got == sorted([(None, 3), (3, 3), (4, 3), (4, 4), (None, None)], key=repr)
    assert g.alike(frame.limit(0)).count() == 0


def test_groups_that_fingerprints_link_are_not_paired_again(spark):
    """Several hundred copies with one changed word each: links stay in proportion to the copies, not to their pairs."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: i % 110], f"new{i}", *words[i % 110 + 1 :]])) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in g.alike(frame).collect()} == {0}
    texts = frame.selectExpr("doc_id as id", "text")
    found = s.described(texts)
    roots = found.selectExpr("fp as node", "1L as root")
    assert s.candidates(s.meeting(texts), found, roots).count() == 0


def test_rows_of_one_id(spark):
    frame = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 2), (2, "a b c", 3), (1, "other", 4), (None, "a b c", 5)], "doc_id long, text string, fp int")
    assert sorted((tuple(r) for r in g.one_of_each(frame).select("doc_id", "text").collect()), key=repr) == [(1, "a b c"), (1, "other"), (None, "a b c")]


def test_parities_never_rule_out_what_shares_four_fifths():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(1, 900)
        a = [rng.getrandbits(63) * rng.choice((1, -1)) for _ in range(n)]
        b = [x if rng.random() > 0.15 else rng.getrandbits(63) for x in a]
        a, b = (s.np.unique(s.np.array(x, dtype=s.np.int64)) for x in (a, b))
        folded = [s.np.bitwise_xor.reduce(s.parities(x).reshape(2, 8), axis=0) for x in (a, b)]
        for x, y in ((s.parities(a), s.parities(b)), folded):
            apart = int(s.np.bitwise_count((x ^ y).view(s.np.uint64)).sum())
            assert apart <= len(s.np.setxor1d(a, b))
        order = s.np.argsort([len(a), len(b)], kind="stable")
        columns = [s.np.array(c)[order] for c in ([1, 2], [len(a), len(b)], [0, 0], [0, 0], [1, 2], *zip(*folded))]
        found = s.close(columns)
        assert len(found[0]) or 5 * len(s.np.intersect1d(a, b)) < 4 * len(s.np.union1d(a, b))
