from difflib import SequenceMatcher

import duckdb

from lithic.plans import queries


def test_title_likeness_compares_whole_texts(spark, sf):
    text = {i: t.lower() for i, t in duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()}
    assert max(map(len, text.values())) > 60
    got = {(r.a, r.b): r.ratio for r in queries.QUERIES["title_likeness"](spark, sf).collect()}
    assert got == {(i, i + 1): round(SequenceMatcher(None, text[i], text[i + 1]).ratio(), 6) for i in text if i + 1 in text}
