import random

import pytest

from lithic.operators import hierarchy as hi
from lithic.operators import matching

SCHEMA = "file_id string, id long, parent_id long, start_line int, start_column int, end_line int, end_column int"


def rows_of(spark, rows, **more):
    return {r.id: r for r in hi.tree(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def spans(rng, n, file):
    out = []
    for i in range(n):
        a = rng.randint(1, 60)
        out.append((file, rng.choice((1, 1000)) * 1000 + i + hash(file) % 7 * 100, None, a, rng.choice((None, 0, 3, 9)), a + rng.choice((0, 0, 1, 5, 30)), rng.choice((None, 4, 50))))
    return out


def join(rows):
    """Innermost other span that holds each one, by comparing all pairs."""
    full = [(f, i, (a, b or 0), (y, 2**31 - 1 if z is None else z)) for f, i, _, a, b, y, z in rows]
    out = {}
    for f, i, s, e in full:
        inside = [(t, tuple(-x for x in u), j) for g, j, t, u in full if g == f and j != i and t <= s and u >= e and ((t, u) != (s, e) or j < i)]
        out[f, i] = max(inside)[2] if inside else None
    return out


def test_spans_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [r for f in "abcdef" for r in spans(rng, 80, f)] + [("one", 1, None, 3, None, 3, None)]
    got = {(r.file_id, r.id): r for r in hi.tree(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = join(rows)
    assert {k: r.parent_id for k, r in got.items()} == expected
    for (f, i), r in got.items():
        own = got.get((f, r.parent_id))
        assert r.depth == (own.depth + 1 if own else 0)
        below = [x for (g, _), x in got.items() if g == f and r.entry < x.entry <= r.exit]
        assert all(above(got, f, x.id, i) for x in below) and sum(above(got, f, x.id, i) for (g, _), x in got.items() if g == f) == len(below)
    for f in "abcdef":
        assert sorted(r.entry for (g, _), r in got.items() if g == f) == list(range(80))


def above(got, f, i, wanted):
    while (i := got[f, i].parent_id) is not None:
        if i == wanted:
            return True
    return False


def test_lines_alone_nest_as_parents_by_span(spark):
    rng = random.Random(7)
    rows = [(f, i, None, a, None, a + rng.choice((0, 2, 9, 40)), None) for f in "xy" for i, a in ((j + 100 * (f == "y"), rng.randint(1, 50)) for j in range(90))]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.parent_id for r in matching.parents_by_span(frame.select("id", "file_id", "start_line", "end_line")).collect()}
    assert got == {i: p for (_, i), p in join(rows).items()}


def test_given_parents_hold_below_half_orphans(spark):
    given = [("f", 1, None, 1, 0, 9, 0), ("f", 2, 1, 20, 0, 21, 0), ("f", 3, 2, 5, 0, 6, 0), ("f", 4, 1, 2, 0, 3, 0), ("f", 5, 77, 30, 0, 40, 0)]
    got = rows_of(spark, given)
    assert {i: (r.parent_id, r.depth, r.entry, r.exit) for i, r in got.items()} == {1: (None, 0, 0, 3), 4: (1, 1, 1, 1), 2: (1, 1, 2, 3), 3: (2, 2, 3, 3), 5: (None, 0, 4, 4)}
    half = given[:2] + [("f", 6, None, 2, 0, 4, 0), ("f", 7, 6, 50, 0, 51, 0)]  # two of four: spans decide
    assert {i: r.parent_id for i, r in rows_of(spark, half).items()} == {1: None, 6: 1, 2: None, 7: None}
    assert {i: r.parent_id for i, r in rows_of(spark, half, orphans=0.6).items()} == {1: None, 2: 1, 6: None, 7: 6}


def test_circles_deep_trees_and_empty_tables(spark):
    circle = [("c", 1, 2, 1, 0, 2, 0), ("c", 2, 1, 3, 0, 4, 0), ("c", 3, 3, 5, 0, 6, 0), ("c", 4, None, 7, 0, 8, 0), ("c", 5, 4, 9, 0, 9, 1)]
    got = rows_of(spark, circle)
    assert {i: (r.parent_id, r.depth) for i, r in got.items()} == {1: (2, None), 2: (1, None), 3: (3, None), 4: (None, 0), 5: (4, 1)}
    deep = [("d", i, None, i, 0, 9000 - i, 0) for i in range(1, 3000)]
    assert max(r.depth for r in rows_of(spark, deep).values()) == 2998
    chain = [("d", i, i - 1 if i > 1 else None, 1, 0, 1, 0) for i in range(1, 3000)]
    assert rows_of(spark, chain)[2999].depth == 2998
    assert rows_of(spark, []) == {} and rows_of(spark, [(None, 1, None, 1, 0, 1, 0), ("a", None, None, 1, 0, 1, 0)]) == {}


NODES = SCHEMA + ", language string, node_type string, name string, annotations array<string>, tags array<string>, signature string"


@pytest.mark.parametrize("inner, found", [("jsx_element", True), ("import", True), ("call", False)])
def test_components_hold_jsx_however_deep(spark, inner, found):
    blocks = [("f", k, None, 1 + k, 0, 100 - k, 0, "typescript", "function", "App" if k == 0 else "block", [], [], "") for k in range(6)]
    rows = blocks + [("f", 9, None, 50, 0, 51, 0, "typescript", inner, "React", [], [], ""), ("f", 10, None, 200, 0, 300, 0, "typescript", "function", "Helper", [], ["react-component"], "")]
    rows += [("f", 11, None, 400, 0, 401, 0, "javascript", "call", "createContext (0)", [], None, ""), ("f", 12, None, 500, 0, 600, 0, "typescript", "function", "Plain", [], [], ""), ("g", 13, None, 1, 0, 2, 0, "typescript", "jsx_element", "b", [], [], "")]
    got = {r.id: r.tags for r in hi.tagged_in_tree(spark.createDataFrame(rows, NODES)).collect()}
    assert (got[0] == ["react-component"]) is found and got[12] == [] and got[10] == ["react-component"] and got[11] == ["react-context"] and len(got) == len(rows)
