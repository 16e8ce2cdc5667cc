import random

import pytest
from pyspark.sql import functions as F

from lithic.operators import levels, matching
from lithic.operators.registry import Registry

CALLS = "id string, file_id string, start_line int, name string, qualified_name string, language string, file_path string"
FUNCTIONS = "id string, file_id string, name string, qualified_name string, start_line int, end_line int, annotations array<string>, tags array<string>"


@pytest.fixture
def functions(spark):
    return spark.createDataFrame([
        ("f1", "a", "greet", "m.greet", 1, 10, [], None), ("f2", "a", "sayHello", "m.Greeter.sayHello", 12, 20, [], []), ("f3", "b", "run", "m.run", 1, 5, [], []),
        ("f4", "c", "run", "m.run", 7, 9, None, []), ("f5", "d", "wired", "m.Svc.wired", 1, 30, [], ["business-service"]), ("f6", "e", "outer", "m.outer", 1, 50, [], []), ("f7", "e", "inner", "m.inner", 5, 9, [], []),
    ], FUNCTIONS)


def edges(spark, functions, calls, **more):
    found = levels.resolved(spark.createDataFrame(calls, CALLS), functions, **more).collect()
    return sorted((r.id, r.level, r.call_type, r.callee_node_id, r.caller_node_id, r.call_name) for r in found) if more.pop("sort", True) else found


def test_each_level_and_what_goes_before(spark, functions):
    got = levels.resolved(spark.createDataFrame([
        ("1", "a", 5, "greet", None, "python", None), ("2", "a", 15, "*.sayHello", "this.greeter.sayHello", "java", "A.java"), ("3", "b", 2, "x", "m.run", "python", None),
        ("4", "a", 2, "run", None, "python", None), ("5", "a", 4, "setattr", "m.greet", "python", None), ("6", "e", 6, "none", None, "python", None), ("7", "d", 3, "none", None, "java", None),
        ("8", "d", 3, "*.get", "requests.get", "python", "x.py"), ("9", "a", 1, " ", None, "python", None), ("10", "a", 1, None, None, "python", None), ("11", "a", 3, "getattr.x", None, "python", None),
    ], CALLS), functions).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add((r.level, r.callee_node_id, r.caller_node_id, r.call_name))
    assert by == {
        "1": {("name", "f1", "f1", "greet")}, "2": {("qualified name", "f2", "f2", "*.sayHello")}, "3": {("qualified name", "f4", "f3", "x")},
        "4": {("name", "f3", "f1", "run"), ("name", "f4", "f1", "run")}, "5": {("dynamic", None, "f1", "setattr")}, "6": {("unknown", None, "f7", "none")},
        "7": {("injected", None, "f5", "none")}, "8": {("external", None, "f5", "requests.get")}, "11": {("unknown", None, "f1", "getattr.x")},
    }


def test_a_level_that_is_added_or_taken_away(spark, functions):
    calls = [("1", "a", 5, "greet", None, "python", None), ("2", "a", 6, "test_it", None, "python", None)]
    mine = levels.LEVELS.copy()
    mine.add(25, "tests", lambda left, context: left.where(F.startswith("name", F.lit("test_"))).join(context.functions.where("id = 'f6'").select(F.col("id").alias("callee_node_id")), F.lit(True)).select("id", "callee_node_id"), call_type="static")
    found = {r.id: (r.level, r.callee_node_id) for r in levels.resolved(spark.createDataFrame(calls, CALLS), functions, levels=mine).collect()}
    assert found == {"1": ("name", "f1"), "2": ("tests", "f6")}
    mine.remove("name")
    found = {r.id: r.level for r in levels.resolved(spark.createDataFrame(calls, CALLS), functions, levels=mine).collect()}
    assert found == {"1": "unknown", "2": "tests"} and [n for n, _, _ in levels.LEVELS] == ["dynamic", "qualified name", "name", "external", "injected"]


def test_a_level_sees_only_what_is_left(spark, functions):
    seen = []
    mine = levels.LEVELS.copy()
    mine.add(35, "spy", lambda left, _: (seen.append({r.id for r in left.collect()}), left.where("false").select("id", F.lit("").alias("callee_node_id")))[1], call_type="static")
    levels.resolved(spark.createDataFrame([("1", "a", 5, "greet", None, "python", None), ("2", "a", 6, "none", None, "python", None)], CALLS), functions, levels=mine).collect()
    assert seen == [{"2"}]


def test_registry_keeps_order_and_names():
    one = Registry()
    one.add(20, "b", len)
    one.register(10, "a", kind=1)(max)
    one.add(20, "c", min)
    assert [(n, m) for n, _, m in one] == [("a", {"kind": 1}), ("b", {}), ("c", {})] and one["a"] is max
    with pytest.raises(ValueError):
        one.add(1, "a", len)
    with pytest.raises(KeyError):
        one.remove("z")


def plain(name, paths):
    """The file that an aliased name stands for, one candidate after the other."""
    for a in matching.ALIASES:
        if name.startswith(a):
            name = name[len(a) :]
            break
    name = name.removeprefix("./").removeprefix("../")
    tries = [name] if name.endswith(matching.ALIAS_ENDINGS) else [name + e for e in matching.ALIAS_ENDINGS]
    for t in tries:
        if t in paths:
            return paths[t]
    suffixes = {}
    for path in sorted(paths):
        parts = path.replace("\\", "/").split("/")
        for k in range(1, len(parts)):
            suffixes.setdefault("/".join(parts[k:]), paths[path])
    suffixes |= {p.replace("\\", "/"): i for p, i in paths.items()}
    for t in tries:
        for way in (t, "src/" + t):
            if way in suffixes:
                return suffixes[way]
    return None


def test_aliases_equal_trying_one_after_the_other(spark):
    rng = random.Random(4)
    pick = lambda *xs: rng.choice(xs)
    folder = lambda: "/".join(pick("src", "a", "b", "lib") for _ in range(rng.randint(0, 3)))
    join = lambda *parts: "/".join(p for p in parts if p)
    paths = {join(folder(), pick("x", "y", "z") + pick(*matching.ALIAS_ENDINGS, ".md")): i for i in range(120)} | {"w\\a\\x.ts": 500, "deep/only\\here.vue": 501}
    names = [pick("", "@/", "~/", "@app/", "./", "../", "./../", "../../", "@x/") + join(folder(), pick("x", "y", "z", "q") + pick("", "", ".ts", ".vue", "/index.js")) for _ in range(400)] + ["", "here", "only/here", None]
    files = spark.createDataFrame([(p, i) for p, i in paths.items()], "path string, file_id long")
    got = matching.resolved_aliases(spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string"), files, "name").collect()
    assert {r.k: r.imported_file_id for r in got} == {k: None if n is None else plain(n, paths) for k, n in enumerate(names)}
    assert len({r.imported_file_id for r in got}) > 20
