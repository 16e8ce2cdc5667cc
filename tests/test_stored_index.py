import random

from lithic.operators import search as se
from lithic.operators.stored_index import StoredIndex

SCHEMA = "doc_id long, title string, text string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t[0], t[1]) for i, t in sorted(docs.items())], SCHEMA)


def files(index, table):
    return {f for own in index.tables.manifest()["tables"][table]["parts"].values() for f in own}


def test_updates_equal_an_index_made_anew(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda: (rng.choice(vocabulary), " ".join(rng.choices(vocabulary, range(300, 0, -1), k=30)))
    docs = {i: text() for i in range(400)}
    index = StoredIndex(spark, str(tmp_path / "i"), 16)
    index.update(frame(spark, docs), None, "doc_id", ["title", "text"])
    for n in range(2):
        before = {t: files(index, t) for t in ("postings", "documents", "frequencies")}
        changed = {i: text() for i in (*rng.sample(sorted(docs), 4), 1000 + n)}
        gone = rng.sample(sorted(set(docs) - set(changed)), 2) + [99999] + list(changed)[:1]
        docs = {i: t for i, t in docs.items() if i not in gone} | changed
        index.update(frame(spark, changed), spark.createDataFrame([(i,) for i in gone], "doc_id long"), "doc_id", ["title", "text"])
        assert all(before[t] <= files(index, t) for t in before)  # nothing is rewritten
        same(spark, index, docs)
    version = index.compact()
    assert index.tables.read("gone").count() == 0 and len(files(index, "postings")) <= 16
    same(spark, index, docs)
    again = StoredIndex(spark, str(tmp_path / "i"), 16)
    again.update(None, spark.createDataFrame([(1000,), (None,)], "doc_id long"), "doc_id", [])
    docs.pop(1000, None)
    same(spark, again, docs)
    assert again.tables.manifest()["version"] == version + 1 and again.tables.vacuum() > 0
    same(spark, again, docs)


def same(spark, index, docs):
    fresh = se.postings(frame(spark, docs), "doc_id", ["title", "text"]).distinct()
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, fresh.collect()))
    n = {r.word: r["count"] for r in fresh.groupBy("word").count().collect()}
    asked = ["w0", "w7", "w299", "nowhere"]
    assert {r.word: r.n for r in index.frequency(asked).collect()} == {w: n[w] for w in asked if w in n}
    assert sorted(map(tuple, index.search(["W0", "w1"], every=True).collect())) == sorted(map(tuple, se.full_text(fresh, ["w0", "w1"], every=True).collect()))
    ranked = {r.id: r.hits for r in index.ranked(["w3", "w5"]).collect()}
    assert ranked == {r.id: r.hits for r in se.full_text(fresh, ["w3", "w5"]).collect()}


def test_a_search_reads_a_part_per_word(spark, tmp_path):
    docs = {i: ("t", f"a{i} b{i % 7} c") for i in range(200)}
    index = StoredIndex(spark, str(tmp_path / "i"), 16)
    index.update(frame(spark, docs), None, "doc_id", ["title", "text"])
    (part,) = index.parts_of(["a17"])
    read = {f.split("_part=")[1].split("/")[0] for f in index.postings(["a17"]).inputFiles() if "_part=" in f}
    assert read <= {part, "0"} and [r.id for r in index.search(["a17"]).collect()] == [17]
    assert index.search([]).count() == 0 and index.search(["nothing"]).count() == 0


def test_edge_cases(spark, tmp_path):
    rows = [(1, None, "x y"), (1, "z", "x"), (None, "q", "q"), (2, None, None), (3, "", "")]
    index = StoredIndex(spark, str(tmp_path / "i"), 4)
    index.update(spark.createDataFrame(rows, SCHEMA), None, "doc_id", ["title", "text"])
    assert sorted(map(tuple, index.postings().collect())) == [("x", 1), ("y", 1), ("z", 1)]
    index.update(spark.createDataFrame([], SCHEMA), None, "doc_id", ["title", "text"])
    assert index.postings().count() == 3
