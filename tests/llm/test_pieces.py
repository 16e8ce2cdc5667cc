import itertools
import random
import subprocess
import sys
import time

import numpy as np
import pytest

from lithic.llm import nbest_pieces as nb
from lithic.llm.queries_pieces import model_path


@pytest.fixture(scope="module")
def encoder():
    return nb.Encoder(model_path(), 3)


def paths(into):
    """All paths as (score, starts from the end, ids)."""
    def go(at):
        if not at:
            yield 0.0, (), b""
        for start, score, ids in into[at]:
            for s, starts, own in go(start):
                yield s + score, (start, *starts), own + ids

    return sorted(((-s, starts, ids) for s, starts, ids in go(len(into) - 1)))


def brute(pieces, text, most):
    words = nb._SPACED.findall(" " + text.replace(nb.MARK, " ")) if text else []
    lists = [paths(pieces.edges(w.replace(" ", nb.MARK))) for w in words]
    every = []
    for ranks in itertools.product(*(range(min(len(x), most)) for x in lists)):
        every.append((sum(x[r][0] for x, r in zip(lists, ranks)), ranks[::-1], b"".join(x[r][2] for x, r in zip(lists, ranks))))
    return [(-s, ids) for s, _, ids in sorted(every)[:most]]


def test_front_pass_and_search_equal_enumeration(encoder):
    rng = random.Random(4)
    words = sorted({nb.MARK + "".join(rng.choice("theanrio'.é\n中🙂") for _ in range(rng.randint(0, 8))) for _ in range(300)})
    for word, score, ids, gap in nb.fronts(encoder.pieces, words):
        every = paths(encoder.pieces.edges(word))
        assert (-score, ids) == (every[0][0], every[0][2])
        assert gap == (every[1][0] - every[0][0] if len(every) > 1 else np.inf)
        assert nb.n_best(encoder.pieces.edges(word), 4) == [(-s, own) for s, _, own in every[:4]]


def test_texts_equal_enumeration(encoder):
    rng = random.Random(8)
    texts = ["", " ", "a", "  a b", "the the the", "x▁y  ", "\n\n a"]
    texts += [" ".join("".join(rng.choice("theanrio.é") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    for text, found in zip(texts, encoder(texts)):
        assert [(s, ids.astype("<u4").tobytes()) for s, ids in found] == (brute(encoder.pieces, text, 3) or [(0.0, b"")])


def test_round_trip_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = nb.segmentations(docs, model_path()).collect()
    assert all(r.decoded for r in rows) and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    for own in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r["rank"])), key=lambda r: r.doc_id):
        scores = [r.score for r in own[1]]
        assert scores == sorted(scores, reverse=True)
    back = nb.decode(nb.encode(docs, model_path()), model_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_text == texts[r.doc_id] for r in back.collect())


def test_edge_cases(spark):
    long = "word  " * 40_000
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "a b", 2), (3, "a b", 2), (4, long, 3)], "doc_id long, text string, rank int")
    rows = nb.segmentations(docs, model_path()).collect()
    assert [(r["rank"], r.n_pieces, r.score, r.decoded) for r in rows if r.doc_id in (1, 2)] == [(1, 0, 0.0, True)] * 2
    assert sum(r.doc_id == 3 for r in rows) == 6 and all(r.decoded for r in rows)
    assert nb.segmentations(docs.limit(0), model_path()).count() == 0


def test_long_words_need_memory_in_proportion():
    """Words of 200,000 characters without a space, with and without ties, in less than 1 GB."""
    code = """
import base64, random, resource
from lithic.llm import nbest_pieces as nb
from lithic.llm.queries_pieces import model_path
encoder = nb.Encoder(model_path(), 3)
for word in ("a" * 200_000, base64.b64encode(random.Random(1).randbytes(150_000)).decode(), "\u4e16\u754c" * 100_000):
    found = encoder([word])[0]
    assert found and all(encoder.pieces.decode(ids) == word for _, ids in found)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


def test_repeated_letters_equal_enumeration(encoder):
    for n in range(1, 11):
        for word in ("a" * n, "ab" * (n // 2) + "a", "0" * n):
            into = encoder.pieces.edges(nb.MARK + word)
            assert nb.n_best(into, 6) == [(-s, own) for s, _, own in paths(into)[:6]]


def test_least_sums_equal_all_products():
    rng = random.Random(8)
    for _ in range(60):
        lists = [sorted(rng.choice((0.0, 0.0, 0.25, 1.0, rng.random())) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 4))]
        lists = [[x - own[0] for x in own] for own in lists]
        every = sorted((sum(x[r] for x, r in zip(lists, ranks)), ranks[::-1]) for ranks in itertools.product(*(range(len(x)) for x in lists)))
        assert nb._least_sums(lists, 12) == every[:12]


def test_many_best_of_a_long_text_take_little_time():
    encoder = nb.Encoder(model_path(), 50)
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 12))) for _ in range(200))
    encoder([text])
    began = time.time()
    (found,) = encoder([text])
    assert time.time() - began < 5 and len(found) == 50
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len({ids.tobytes() for _, ids in found}) == 50
    assert all(encoder.pieces.decode(ids) == text for _, ids in found)


def test_decoding_replaces_its_column(spark):
    rows = spark.createDataFrame([([1000], "x"), (None, "y")], "ids array<int>, decoded_text string")
    assert nb.decode(rows, model_path()).columns == ["ids", "decoded_text"]
