import zlib

import numpy as np
import pytest

from lithic.llm import quality_gam as q
from lithic.llm import toxicity_fm as t
from lithic.llm.common import table
from lithic.llm.queries_quality import op9_quality
from lithic.llm.queries_toxicity import op1_toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("query", "label", "fold", "least"), [(op1_toxicity, "toxic", (5, 0), 0.93), (op9_quality, "quality", (3, 1), 0.97)])
def test_held_out_accuracy(spark, query, label, fold, least):
    labels = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1])
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    own = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    high, low = np.array([s for y, s in own if y]), np.array([s for y, s in own if not y])
    assert np.mean([(s >= 0.5) == bool(y) for y, s in own]) >= least
    assert (high[:, None] > low[None, :]).mean() > 0.95


def test_labels_of_the_held_out_fold_are_not_read(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    other = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = (t.fit(docs, x, "toxic", 5, 0) for x in (labels, other))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_factors_learn_what_single_weights_cannot():
    """Label 1 where both or neither of two terms stand, among 3,000 others of which each text has some 60: no additive
    weights do better than chance, and neither term depends on the label by itself."""
    rng = np.random.default_rng(6)

    def texts(n):
        rows, y = [], []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.4
            rows.append(np.unique(np.concatenate(([11] * a, [12] * b, 100 + rng.integers(0, 3000, 60)))).astype(np.int64))
            y.append(int(a == b))
        return rows, np.array(y)

    machine = t.train(*texts(3000))
    assert (machine.bucket_of[[11, 12]] >= 0).all()
    rows, y = texts(1000)
    assert ((machine.logits(rows) > 0) == y).mean() >= 0.85
    v = machine.factors[machine.bucket_of[[11, 12]]]
    assert v[0] @ v[1] > 0


def test_toxicity_score_is_the_plain_sum_over_pairs(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    machine, terms = t.fit(docs, labels, "toxic", 5, 0), t.Terms()
    got = {r.doc_id: r.score for r in t.score(docs, machine).collect()}
    for r in docs.limit(40).collect():
        own = sorted(int(machine.bucket_of[b]) for b in terms(r.text) if machine.bucket_of[b] >= 0)
        z = machine.bias + sum(float(machine.weights[i]) for i in own)
        z += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(own) for j in own[n + 1 :])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_score_is_the_plain_sum_of_table_entries(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = q.fit(docs, labels, "quality", 3, 1)
    got = {r.doc_id: r.score for r in q.score(docs, model).collect()}
    place = lambda edges, x: sum(x >= e for e in edges)
    for r in docs.limit(40).collect():
        x = q.features(r.text)
        z = model.base + sum(table[place(edges, v)] for edges, table, v in zip(model.edges, model.tables, x))
        z += sum(table[place(model.coarse[i], x[i]), place(model.coarse[j], x[j])] for i, j, table in model.pairs)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = q.train(x, y)
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)
    assert (((model.logits(x) > 0) == (y > 0)).mean()) > 0.9


@pytest.mark.parametrize("module", [q, t])
def test_edge_cases(spark, sf, module):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").selectExpr("*", "1 as text")
    label = "quality" if module is q else "toxic"
    odd = spark.createDataFrame([(1, None, 1, 2), (2, "", 1, 2), (3, "x " * 80_000, 1, 2), (None, "a b", 1, 2), (4, "a b", 1, 2), (4, "a b", 1, 2)], "doc_id long, text string, score int, label int")
    for model in (module.fit(docs, labels, label, 3, 1), module.fit(docs, labels.limit(0), label, 3, 1), module.fit(docs.limit(0), labels, label, 3, 1)):
        rows = module.score(odd, model).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        by = [(r.doc_id, r.score) for r in rows]
        assert by[0][1] == by[1][1] and by[4] == by[5]
        assert module.score(odd.limit(0), model).count() == 0
    if module is q:
        kept = q.keep_good(docs.withColumnRenamed("lang", "__quality"), q.fit(docs, labels, label, 3, 1))
        assert kept.columns == ["doc_id", "text", "__quality", "source", "n_chars"] and 0 < kept.count() < docs.count()
