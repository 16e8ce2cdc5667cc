import re

import corpus_pipeline
from lithic.llm import packing, pii_weak
from lithic.llm.common import table

from .test_packing import check
from .test_shingle_copies import plain_components
from .test_suffix import brute


def test_each_stage_on_what_the_one_before_kept(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality"](spark, docs, sf)
    kept = {r.doc_id: r for r in good.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert good.columns == docs.columns and all(kept[i] == rows[i] for i in kept)
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) >= 0.9 * len(right)

    single = steps["near_duplicates"](spark, good, sf)
    roots = plain_components([(i, r.text) for i, r in kept.items()])
    one = {r.doc_id: r for r in single.collect()}
    assert set(one) == {i for i, root in roots.items() if i == root} and single.columns == docs.columns

    cut = steps["repeats"](spark, single, sf)
    texts = {r.doc_id: r.text for r in cut.collect()}
    expected = brute([(i, r.text) for i, r in one.items()])
    assert set(texts) == set(one) and cut.columns == docs.columns
    for i, text in texts.items():
        lost = len(one[i].text.encode()) - len(text.encode())
        assert expected[i][1] - 6 * expected[i][2] <= lost <= expected[i][1]

    clean = steps["personal_data"](spark, cut, sf)
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and set(after) == set(texts)
    for i, r in after.items():
        assert not pii_weak.base_spans(r.text) and r.n_chars == len(r.text)
        if not re.search("[0-9@]", texts[i]):
            assert r.text == texts[i]

    packed = steps["packing"](spark, clean, sf).collect()
    check(packed, {i: r.text for i, r in after.items()}, packing.SIZE)


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(0 <= r.offset and r.offset + r.length <= packing.SIZE for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None
