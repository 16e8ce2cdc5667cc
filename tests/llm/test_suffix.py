import hashlib
import random
import shutil

import numpy as np
import pytest

from lithic.llm import suffix_dedup as s

SCHEMA = "doc_id long, text string, n_chars long, id string"


def brute(rows, length=100):
    """{id: (n_bytes, n_removed, n_spans, sha256)} by looking at every window in order."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, dtype=np.int64)
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                gone[p + 1 : p + 1 + length] = 1
            seen.add(window)
        edges = np.flatnonzero(np.diff(gone) == 1)
        kept = bytes(np.frombuffer(raw, np.uint8)[gone[1 : len(raw) + 1] == 0])
        out[i] = (len(raw), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.repeats(docs).collect()}
    assert got == brute(rows)
    return docs


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.repeats(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(v[2] for v in got.values()) > 10


def planted():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, passage = text(40), text(90)
    rows = []
    for i in range(60):
        parts = [text(30), common, text(20)]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 3), passage[rng.randint(0, 40) : rng.randint(200, 400)])
        if i % 7 == 0:
            parts.append("na " * 200)
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[5][1]) for i in range(5)] + [(200, rows[9][1][:150] + "!" + rows[9][1][151:]), (201, "\0" * 300), (202, "\0" * 250)]
    rows += [(203, None), (204, ""), (205, "x" * 99), (206, "x" * 100), (207, "x" * 100)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"HOT": 20, "GROUP": 30, "BATCH": 7, "_GO": 2000}, {"HOT": 8, "HOTTER": 20}, {"HOT": 4, "STRIDE": 7, "_CHUNK": 150}, {"_CHUNK": 150, "GROUP": 5}])
def test_planted_repeats(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(s, name, value)
    docs = check(spark, planted())
    kept = s.without_repeats(docs)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert rows[203].text is None and rows[207].text == "" and rows[207].n_chars == 0 and rows[206].text == "x" * 100
    assert rows[104].text == "" and rows[0].n_chars == len(rows[0].text)


@pytest.mark.parametrize("block", [1 << 16, 5])
def test_family_keeps_levels_geometric(block):
    rng = np.random.default_rng(3)
    pool = rng.integers(97, 99, (500, 12), dtype=np.uint8)
    family, seen = s.SuffixFamily(12, block), set()
    for _ in range(40):
        batch = pool[rng.integers(0, 500, 37)]
        expected = []
        for w in batch:
            expected.append(bytes(w) in seen)
            seen.add(bytes(w))
        assert family.add(batch.ravel(), np.arange(len(batch)) * 12).tolist() == expected
        sizes = [len(order) for _, order in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)


def test_repeated_null_and_missing_ids(spark):
    long = "one two three " * 20
    docs = spark.createDataFrame([(1, long, 0, "a"), (1, long, 0, "a"), (None, long, 0, "b")], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_removed) for r in s.repeats(docs).collect())
    alone = brute([(1, long)])[1][1]
    assert got == [(0, len(long)), (1, alone), (1, alone)]
    assert s.repeats(docs.limit(0)).count() == 0 and s.without_repeats(docs.limit(0)).columns == docs.columns


def test_batches_of_documents_against_a_stored_family(spark, tmp_path):
    """Four batches in turn equal all documents at once, in the order of batches."""
    rows = planted()
    order = sorted(rows, key=lambda r: (r[0] % 4, r[0]))
    expected = brute([(n, text) for n, (_, text) in enumerate(order)])
    family, at = s.StoredFamily(spark, str(tmp_path)), 0
    for part in range(4):
        batch = [r for r in order if r[0] % 4 == part]
        got = {r.doc_id: tuple(r[1:]) for r in family.add(spark.createDataFrame(batch, "doc_id long, text string")).collect()}
        assert got == {i: expected[at + n] for n, (i, _) in enumerate(batch)}
        at += len(batch)
        sizes = [n for _, n in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    assert len(list(tmp_path.iterdir())) == len(family.levels)


def test_a_stored_family_goes_on_in_another_object(spark, tmp_path):
    rows = planted()
    expected = brute(rows)
    order = sorted(rows)
    for part, cut in enumerate(((0, 25), (25, 50), (50, len(order)))):
        family = s.StoredFamily(spark, str(tmp_path))  # as after a restart
        assert family.age == part
        got = {r.doc_id: tuple(r[1:]) for r in family.add(spark.createDataFrame(order[slice(*cut)], "doc_id long, text string")).collect()}
        assert got == {i: expected[i] for i, _ in order[slice(*cut)]}


def test_leavings_of_a_step_that_died_are_deleted(spark, tmp_path):
    family = s.StoredFamily(spark, str(tmp_path))
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(400))
    docs = lambda i: spark.createDataFrame([(i, text)], "doc_id long, text string")
    assert family.add(docs(1)).first().n_removed == 0
    level = family.levels[0][0].rsplit("/", 1)[-1]
    (tmp_path / "level-new-abc").mkdir()
    shutil.copytree(tmp_path / level, tmp_path / level.replace("level-0-0", "level-0-1"))  # a merge that did not delete what it took in
    again = s.StoredFamily(spark, str(tmp_path))
    assert again.age == 2 and len(again.levels) == 1 and sorted(p.name for p in tmp_path.iterdir()) == [level.replace("level-0-0", "level-0-1")]
    assert again.add(docs(2)).first().n_removed == len(text)


def test_places_of_a_gram_within_one_text_are_dealt_out(spark, monkeypatch):
    """A gram that comes very often in one text is hot, and its windows go to many keys."""
    monkeypatch.setattr(s, "HOT", 500)
    rng = random.Random(7)
    gram = "the very same two dozen bytes and more"
    text = "".join(gram + "".join(rng.choice("abcdefgh") for _ in range(70)) for _ in range(3000))
    rows = [(1, text), (2, text[50_000:60_000])]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "id long, text string")
    flagged = docs.repartition(1).mapInArrow(s._anchored, "gram long, id long, places long, more binary").repartition("gram").sortWithinPartitions("gram").mapInArrow(s._repeated, "id long, gram long, heat int")
    assert flagged.where("heat = 1").count() > 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x" * 300, "a", "b", "c", "d")], "doc_id long, text string, __key string, __kept string, cuts string, `a.b` string")
    kept = s.without_repeats(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "x", "a", "b", "c", "d")]


def test_query_gives_the_rows_of_its_sql(spark, sf):
    import duckdb

    from lithic.llm import queries_suffix

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = queries_suffix.QUERIES["op4_suffix_dedup"](spark, sf).select(*columns).collect()
    found = con.sql(queries_suffix.ORACLES["op4_suffix_dedup"])
    assert found.columns == columns
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
