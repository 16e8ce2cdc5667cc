import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from lithic.llm import packing as p
from lithic.llm.queries_packing import tokenizer_path


def ids_of(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [p.END_ID]


def check(rows, texts, size):
    by_sequence = {}
    for i, text in texts.items():
        ids = ids_of(text)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        spans.sort()
        assert [s for s, _ in spans] == list(np.cumsum([0, *(n for _, n in spans)])[:-1]) and sum(n for _, n in spans) <= size
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = p.pack_documents(docs, tokenizer_path()).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()}, p.SIZE)
    assert n <= sum(r.length for r in rows) / p.SIZE * 1.05 + 1


def test_edge_cases(spark):
    odd = "İstanbul ΣΑΣ <|endoftext|> é x\x1cy 'S it's 123 !!?? 中文 🙂 ﬁ"
    texts = {1: None, 2: "", 3: odd, 4: "The the THE", 5: "ab " * 5000, 6: "The the THE"}
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in texts.items()], "doc_id long, text string, start int, id string")
    rows = p.pack_documents(docs, tokenizer_path(), size=64).collect()
    check(rows, texts, 64)
    assert p.pack_documents(docs.limit(0), tokenizer_path()).count() == 0
    twice = p.pack_documents(docs.where("doc_id = 4").union(docs.where("doc_id = 4")), tokenizer_path()).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_patterns_place_every_length_once():
    rng = random.Random(3)
    for _ in range(50):
        size = rng.choice((8, 50, 512))
        histogram = {n: rng.randint(1, 10**6) for n in rng.sample(range(1, size + 1), rng.randint(1, min(size, 40)))}
        placed = {}
        for n, lengths in p.patterns(histogram, size):
            assert n > 0 and sum(lengths) <= size
            for length in lengths:
                placed[length] = placed.get(length, 0) + n
        assert placed == histogram


def test_clashing_columns(spark):
    cut = spark.createDataFrame([(1, 0, 5, "a", "b", "c", 7), (2, 0, 4000, "d", "e", "f", 8)], "id long, start long, length long, bucket string, rank string, at string, sequence_id int")
    got = p.pack(cut)
    assert got.columns == ["id", "start", "length", "bucket", "rank", "at", "sequence_id", "offset"]
    assert sorted(r["rank"] for r in got.collect()) == ["b", "e"]
