import hashlib
import random
import re
import time

import pytest

from lithic.llm import pii_weak as p
from lithic.llm.common import table
from lithic.llm.queries_pii import op5_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(9)
    texts = ["".join(rng.choice("a1@.+- ()4_é") for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    texts += ["a@b.c_d@e.f", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "+1 (499) 555-6503.", "0001.2.3.255", "+12345678 +1234567890123456", "1" * 5000]
    for text in texts:
        assert [(p.KINDS[k], a, b) for k, a, b in p.base_spans(text)] == plain(text), text


def test_query_on_documents(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = op5_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        joined = ["%s:%d:%d" % s for s in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(filter(None, r.spans.split(",")))


def test_votes_decide_on_added_spans(spark):
    rng = random.Random(1)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    word = lambda n: " ".join("".join(rng.choice("etaoin") for _ in range(5)) for _ in range(n))
    docs = [(i, f'{word(9)} token = "{hexed()}" {word(9)}') for i in range(60)]
    docs += [(100 + i, f"{word(9)} commit {'0' * 21}{i}a {word(9)}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = p.fit(frame)
    found = {r.doc_id: r.spans for r in p.find(frame, model).collect()}
    assert all(found[i].startswith("secret:") for i in range(60)) and not any(found[100 + i] for i in range(60))
    clean = p.redact(frame, model).where("doc_id = 3").first().text
    assert '= "<SECRET>"' in clean


def test_em_finds_the_unreliable_labeler():
    rng = random.Random(3)
    rows = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        vote = lambda right: p.FOR if (rng.random() < right) == truth else p.AGAINST  # noqa: E731, B023
        votes = [vote(x) for x in (0.95, 0.9, 0.9, 0.85, 0.55)]
        key = (0, sum(v * 3**i for i, v in enumerate(votes)), 0)
        rows[key] = rows.get(key, 0) + 1
    model = p.train([(*k, n) for k, n in rows.items()])
    assert model.reliability[0, 4] < 0.65 and min(model.reliability[0, :4]) > 0.8


@pytest.mark.parametrize("text", [None, "", "a@", "+", "1.1.1", "@" * 3000, "1" * 40_000 + "@" + "a." * 30_000])
def test_edge_texts(spark, text):
    frame = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, "b@c.de", 2)], "doc_id long, text string, spans int")
    model = p.fit(frame)
    rows = p.find(frame, model).collect()
    assert [r.n_email for r in rows] == [0, 0, 1] or text and "a." in text
    assert rows[0] == rows[1] and p.redact(frame, model).columns == frame.columns
    assert p.find(frame.limit(0), model).count() == 0 and p.fit(frame.limit(0)).weights.any()


def test_many_spans_and_long_addresses(spark):
    """Work grows with the spans, not with their pairs; obfuscated addresses are taken whole."""
    began = time.time()
    text = " ".join(f"a{i}@b.com call 555-123-{1000 + i % 9000}" for i in range(20_000))
    assert len(p.candidates(text)) == 40_000 and time.time() - began < 20
    long = "a" * 200 + "[at]" + "b" * 100 + ".example.com"
    assert [c[1:3] for c in p.candidates("mail " + long) if c[0] == 0] == [(5, 5 + len(long))]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com", "x", "y")], "doc_id long, text string, __clean string, `a.b` string")
    got = p.redact(docs, p.train([]))
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "mail <EMAIL>", "x", "y")]
