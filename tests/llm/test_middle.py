import hashlib
import random
import re

import pytest

from lithic.llm import fill_middle as f
from pyspark.sql import functions as F

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", "char": r"(?s)."}


def texts():
    rng = random.Random(4)
    for _ in range(400):
        yield "".join(rng.choice("a\nbé\n \t中🙂\r\x0b") for _ in range(rng.randint(0, 30)))
    yield from ("", "\n", "\n\n\n", "a", "a\n", "\na", " ", " a ", "é", "🙂🙂a中")


@pytest.mark.parametrize("unit", f.UNITS)
def test_runs_equal_patterns(unit):
    for text in texts():
        found = f.runs(text.encode(), unit)
        parts = re.findall(PATTERNS[unit], text)
        assert "".join(parts) == text and found.n == len(parts)
        for u in range(len(parts) + 1):
            assert found.end_of(u) == len("".join(parts[:u]).encode())


def test_runs_are_few():
    raw = ("x" * 1000 + "\n" * 1000) * 20
    assert len(f.runs(raw.encode()).begins) == 40 and f.runs(raw.encode()).n == 20_000


def expected(i, text):
    text = text or ""
    lines = re.findall(PATTERNS["line"], text)
    digest = hashlib.sha256(f"7:{i}".encode()).hexdigest()
    a, b, _, order = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if order % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_documents_and_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = f.transform(docs).withColumn("back", f.restored(F.col("form"), F.col("output"))).collect()
    assert len(rows) == docs.count() and len({r.form for r in rows}) >= 2
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text) and r.back == (r.text or "")


def test_edge_cases(spark):
    given = [(1, None), (2, ""), (3, "has <S> in it\n"), (4, "\n"), (5, "<" * 7 + "\nP>S>\n<\n"), (6, "line é\n" * 300_000), (7, "no end"), (7, "no end"), (8, "a\x00b\n"), (9, "<P\n><S\n>")]
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in given], "doc_id long, text string, form string, output string, a0 int")
    out = f.transform(docs)
    assert out.columns == ["doc_id", "text", "a0", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", f.restored(F.col("form"), F.col("output"))).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in given)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text) and r.back == (r.text or "")
    assert f.transform(docs.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, "a\nb\n")], "doc_id long, text string")
    assert f.transform(nobody).first().output == expected("null", "a\nb\n")[4]


def test_rates_and_units(spark):
    docs = spark.createDataFrame([(i, f"one two\nthree {i}\n") for i in range(300)], "doc_id long, text string")
    forms = f.transform(docs, rate=30, suffix_first=0).groupBy("form").count().collect()
    found = {r.form: r["count"] for r in forms}
    assert set(found) == {"plain", "psm"} and 50 < found["psm"] < 130
    for unit in ("word", "char"):
        rows = f.transform(docs, unit=unit).withColumn("back", f.restored(F.col("form"), F.col("output"))).collect()
        assert all(r.back == r.text for r in rows)
