import random
import re

from lithic.llm import license_scan as s
from lithic.llm.common import table


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in s.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), places, labels, words


def test_base_columns_equal_the_plain_scan(spark, sf):
    rng = random.Random(7)
    bits = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "é1"]
    texts = {10_000 + i: rng.choice(" -\n").join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for i in range(400)}
    texts |= {20_000: None, 20_001: "", 20_002: "CC BY cc-by Cc.By", 20_003: "general public license " * 5000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").unionByName(table(spark, sf, "documents").select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in frame.collect()}
    rows = s.scan(frame).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places, labels, _ = plain(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(places, default=None), max(places, default=None)), r
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not labels)


def test_templates_are_found_where_their_key_phrase_stands(spark):
    filler = "lorem ipsum dolor sit amet " * 6
    rows = [(i, f"{filler} {t.text.title()}. {filler}") for i, t in enumerate(s.TEMPLATES)]
    rows += [(100 + i, " ".join(reversed(t.words))) for i, t in enumerate(s.TEMPLATES)]
    rows += [(200, "licensed under the apache licence version 2.0"), (201, filler + s.TEMPLATES[7].text + " " + s.TEMPLATES[0].text), (202, s.TEMPLATES[0].text)]
    got = {r.doc_id: r for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(s.TEMPLATES):
        assert t.label in got[i].labels.split(",") and got[i].score == 1.0
        assert t.label not in got[100 + i].labels.split(",")
    assert not got[200].labels and got[201].labels == "apache-2.0,mit" and got[202].labels == "apache-2.0"


def matches(words):
    """{label: best score} of templates whose key phrase stands, from every place."""
    out = {}
    for t in s.TEMPLATES:
        key = t.key.split()
        for at in range(len(words) - len(key) + 1):
            if words[at : at + len(key)] == key:
                start = at - t.key_at
                share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)) / len(t.words)
                if share >= s.SHARE:
                    out[t.label] = max(share, out.get(t.label, 0))
    return out


def test_labels_and_scores_equal_trying_every_place(spark, sf):
    rng, texts = random.Random(11), {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    vocabulary = sorted({w for t in s.TEMPLATES for w in t.words})
    for i in range(500):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = list(rng.choice(s.TEMPLATES).words)
            for k in range(len(words)):
                if rng.random() < 0.12:
                    words[k] = rng.choice(vocabulary)
            parts.append(" ".join(words[rng.randint(0, 2) : len(words) - rng.randint(0, 2)]))
            parts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 3))))
        texts[10_000 + i] = " ".join(parts)
    rows = s.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts) and sum(bool(r.labels) for r in rows) > 200
    for r in rows:
        _, places, base, words = plain(texts[r.doc_id])
        found = matches(words)
        assert r.labels == ",".join(sorted(base | set(found))), (texts[r.doc_id], r)
        assert abs(r.score - (1.0 if base else max(found.values(), default=0.0))) < 1e-12


def test_a_file_is_labelled_alike_in_any_company(spark):
    one = (1, "released with care apache license version 2 0")
    alike = [(100 + i, "licensed under the apache license version 2 0 " + "more words " * 5) for i in range(19)]
    other = [(200 + i, f"nothing to see here {i}") for i in range(19)]
    rows = [s.scan(spark.createDataFrame([one, *more], "doc_id long, text string")).where("doc_id = 1").first() for more in ([], alike, other)]
    assert rows[0] == rows[1] == rows[2] and rows[0].labels == "apache-2.0" and rows[0].score == 0.625


def test_long_texts_and_clashing_columns(spark):
    text = "word " * 500_000 + s.TEMPLATES[0].text + " word" * 500_000
    frame = spark.createDataFrame([(1, text, "x", "y", 1.0)], "doc_id long, text string, __words string, n_words string, score double")
    row = s.scan(frame).first()
    assert (row.n_words, row.labels, row.score) == (1_000_008, "apache-2.0", 1.0)


def test_edge_cases(spark):
    frame = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "CC BY", 1)], "doc_id long, text string, labels int")
    rows = s.scan(frame).collect()
    assert [(r.n_words, r.first_word, r.labels, r.score) for r in rows] == [(0, None, "", 0.0), (0, None, "", 0.0), (2, 0, "cc-by", 1.0)]
    assert s.scan(frame.limit(0)).count() == 0


def test_plan_has_no_python(spark, sf):
    plan = s.scan(table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_changed_words_outside_the_key_phrase(spark):
    """Any third of the words beside the key phrase may be other words; places before and after stay."""
    rng, rows = random.Random(3), []
    for i, t in enumerate(s.TEMPLATES):
        words, key = t.words, t.key.split()
        free = [k for k in range(len(words)) if not t.key_at <= k < t.key_at + len(key)]
        for k in rng.sample(free, min(len(free), int(0.4 * len(words)))):
            words[k] = f"other{k}"
        rows.append((i, "some words before " + " ".join(words) + " and after"))
    rows += [(1000 + i, f"a file like most, number {i}, without a licence") for i in range(300)]
    got = {r.doc_id: r for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(s.TEMPLATES):
        assert t.label in got[i].labels.split(","), (t, got[i])
    assert not any(got[1000 + i].labels for i in range(300))
