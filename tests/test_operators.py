import json

from pyspark.sql import functions as F

from lithic.functions import jsons, text, vectors
from lithic.operators import evaluation, frameworks, graphs, levels, matching, search, statistics, tables

CALLS = "id string, file_id string, start_line int, name string, qualified_name string, language string"
FUNCTIONS = "id string, file_id string, name string, qualified_name string, start_line int, end_line int, annotations array<string>"


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_calls_are_resolved_in_stages(spark):
    functions = spark.createDataFrame([
        ("f1", "a", "greet", "m.greet", 1, 10, []), ("f2", "a", "sayHello", "m.Greeter.sayHello", 12, 20, []), ("f3", "b", "process", "m.One.process", 1, 5, []),
        ("f4", "b", "process", "m.Two.process", 7, 9, []), ("f5", "c", "wired", "m.Svc.wired", 1, 30, ["@Autowired"]), ("f6", "a", "Greeter", "m.Greeter", 30, 40, []),
    ], FUNCTIONS)
    calls = spark.createDataFrame([
        ("1", "a", 5, "greet", None, "python"), ("2", "a", 15, "*.sayHello", None, "python"), ("3", "a", 2, "new Greeter", None, "java"), ("4", "a", 3, "process", None, "python"),
        ("5", "a", 4, "getattr", None, "python"), ("6", "z", 1, "unknownFunc", None, "python"), ("7", "b", 2, "*.process", "two.process", "java"), ("8", "a", 6, "*.array", "numpy.array", "python"),
        ("9", "c", 3, "*.charge", "billing.charge", "java"),
    ], CALLS)
    edges = levels.resolved(calls, functions)
    got = {}
    for r in edges.collect():
        got.setdefault(r.id, set()).add((r.call_type, r.callee_node_id, r.caller_node_id))
    assert got["1"] == {("static", "f1", "f1")} and got["2"] == {("static", "f2", "f2")} and got["3"] == {("static", "f6", "f1")}
    assert got["4"] == {("static", "f3", "f1"), ("static", "f4", "f1")} and got["5"] == {("dynamic", None, "f1")} and got["6"] == {("unknown", None, None)}
    assert got["7"] == {("static", "f4", "f3")} and got["8"] == {("external", None, "f1")} and got["9"] == {("injected", None, "f5")}


def test_paths_of_imports(spark):
    files = spark.createDataFrame([("1", "pkg/util.py"), ("2", "pkg/__init__.py"), ("3", "com/e/A.java"), ("4", "web/index.ts")], "file_id string, path string")
    imports = spark.createDataFrame([("pkg.util",), ("pkg",), ("com.e.A",), ("./web",), ("numpy",)], "name string").withColumn("path", text.collapsed_path(text.module_path(F.col("name"))))
    got = matching.resolved_paths(imports.withColumn("path", F.when(F.col("name") == "./web", "web").otherwise(F.col("path"))), files, "path")
    kinds = got.withColumn("kind", matching.import_kind(F.col("name"), F.col("imported_file_id")))
    assert values(kinds, "name", "imported_file_id", "kind") == sorted([("./web", "4", "relative"), ("com.e.A", "3", "absolute"), ("numpy", None, "external"), ("pkg", "2", "absolute"), ("pkg.util", "1", "absolute")])
    nodes = spark.createDataFrame([("n", "/home/x/pkg/util.py"), ("m", "/home/none.py")], "id string, at string")
    assert values(matching.files_of_paths(nodes, files, "at"), "id", "file_id") == [("m", None), ("n", "1")]


def test_prefix_join_prefers_equal_keys(spark):
    left = spark.createDataFrame([("a", "org.spring.web"), ("b", "org"), ("c", "numpy"), ("d", "orgx.spring")], "l string, lk string")
    right = spark.createDataFrame([(1, "org.spring"), (2, "org.spring.web"), (3, "numpy")], "r long, rk string")
    assert values(matching.prefix_matches(left, right, "lk", "rk", "l", "r"), "l", "r", "exact") == [("a", 2, True), ("b", 1, False), ("c", 3, True)]
    deps = spark.createDataFrame([("G", "A"), (None, "B")], "group_name string, artifact_name string")
    assert values(matching.dependency_keys(deps), "key") == [("a",), ("b",), ("g",), ("g/a",)]


def test_rows_are_checked(spark):
    nodes = spark.createDataFrame([("1", "f", "function", 1, 2, 0, 0, "x"), ("2", " ", "thing", -1, -2, -1, 0, "y")], "id string, name string, node_type string, start_line int, end_line int, start_column int, end_column int, file_id string")
    files = spark.createDataFrame([("x",)], "file_id string")
    got = {r.id: r.errors for r in tables.checked_nodes(nodes, files).collect()}
    assert got["1"] == [] and got["2"] == ["name missing", "node_type unknown", "start_line negative", "start after end", "column negative", "file unknown"]
    edges = spark.createDataFrame([("1", "2", "external", 1), ("1", None, "static", 1), ("9", "8", "odd", -1)], "caller_node_id string, callee_node_id string, call_type string, start_line int")
    assert [len(r.errors) for r in tables.checked_calls(edges, nodes).orderBy("start_line", "call_type").collect()] == [4, 0, 0]
    assert sum(len(r.errors) for r in tables.checked_calls(edges, nodes, strict=True).collect()) == 5
    imports = spark.createDataFrame([("x", None, "external", "n"), ("q", "r", "odd", " ")], "importer_file_id string, imported_file_id string, import_type string, import_name string")
    assert sorted(len(r.errors) for r in tables.checked_imports(imports, files).collect()) == [0, 4]


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at int")
    c = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (3, "z", 1)], "k long, v string, at int")
    assert values(tables.upserted(t, c, ["k"], "at"), "k", "v") == [(1, "a"), (2, "y"), (3, "z")]
    assert values(tables.only_keys(t, c, "k", "k"), "k") == [(2,)]
    assert values(tables.where_tagged(t.withColumn("tags", F.array("v")), "tags", "a"), "k") == [(1,)]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", None)], "a string, b string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert values(graphs.reached(edges, seeds, 2, both_ways=False), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert values(graphs.reached(edges, seeds, 2), "node", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert values(graphs.paths_from(edges, seeds, 3), "node", "depth") == [("b", 1), ("c", 2), ("d", 3)]
    nodes = spark.createDataFrame([("r", None), ("s", "r"), ("t", "s"), ("o", "gone")], "id string, parent_id string")
    assert values(graphs.tree_depths(nodes, 3), "id", "depth") == [("o", 0), ("r", 0), ("s", 1), ("t", 2)]
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")], "id string, file_id string")
    assert values(graphs.across(edges, files), "a", "others") == [("a", ["b"]), ("b", ["c"])]
    now = spark.createDataFrame([(f"f{i}", str(i)) for i in range(10)], "path string, h string")
    for changed, full in ((3, False), (4, True)):
        before = now.withColumn("h", F.when(F.substring("path", 2, 1).cast("int") < changed, "old").otherwise(F.col("h")))
        assert graphs.change_summary(graphs.changes(now, before, "path", "h"), now).first()["full"] == full
    points = spark.createDataFrame([("p", ["f1"], "v1"), ("q", ["f2"], "v1")], "id string, files array<string>, version string")
    assert values(graphs.preserved(points, spark.createDataFrame([("f1",)], "path string"), "files", "v2"), "id", "version") == [("q", "v2")]


def test_frameworks(spark):
    files = spark.createDataFrame([("a/package.json", '{"dependencies": {"react": "18.2", "react-dom": "18"}}'), ("go.mod", "require github.com/gin-gonic/gin v1.9.0"), ("x.txt", '"vue":')], "path string, content string")
    assert values(frameworks.by_manifest(files), "framework", "confidence", "version") == [("gin", 0.1, "1.9.0"), ("react", 0.2, "18.2")]
    nodes = spark.createDataFrame([
        ("1", "java", "class", "A", ["@RestController", "@Service"], None, None), ("2", "python", "function", "f", ["@app.route", "@lru_cache"], ["own"], None), ("3", "typescript", "function", "useX", [], None, None),
        ("4", "typescript", "function", "Panel", [], None, None), ("5", "go", "function", "H", [], None, "func H(c *gin.Context)"),
    ], "id string, language string, node_type string, name string, annotations array<string>, tags array<string>, signature string")
    tagged = frameworks.tagged(nodes)
    assert {r.id: r.tags for r in tagged.collect()} == {"1": ["http-controller", "business-service"], "2": ["own", "flask-route", "cached-function"], "3": ["react-hook"], "4": ["react-component"], "5": ["http-handler"]}
    scores = {r.framework: round(r.confidence, 6) for r in frameworks.by_nodes(tagged).collect()}
    assert scores == {"spring_boot": 0.4, "flask": 0.2, "react": 0.2, "gin": 0.1}
    merged = statistics.merged_scores(frameworks.by_nodes(tagged), frameworks.by_manifest(files))
    assert {r.framework: round(r.confidence, 6) for r in merged.collect()}["react"] == 0.4


def test_routes(spark):
    kind = "id string, node_type string, name string, file_path string, annotations array<struct<name:string,args:array<string>>>"
    nodes = spark.createDataFrame([
        ("1", "method", "get", "A.java", [("@GetMapping", ['"/x/{id}"'])]), ("2", "method", "any", "A.java", [("@RequestMapping", ['value = "/y"', "method = RequestMethod.POST"])]),
        ("3", "function", "show", "a.py", [("@app.route", ["'/u/<int:id>'", "methods=['PUT']"])]), ("4", "function", "plain", "a.py", [("@router.delete", [])]), ("5", "class", "No", "a.py", [("@app.get", ["'/n'"])]),
    ], kind)
    got = values(frameworks.annotated_routes(nodes), "http_method", "path_pattern", "handler")
    assert got == [("DELETE", "/", "plain"), ("GET", "/x/{id}", "get"), ("POST", "/y", "any"), ("PUT", "/u/{id}", "show")]
    calls = spark.createDataFrame([("*.get", "app.get('/a/:id', h)", "javascript", "s.js", 1), ("*.use", "app.use(cors())", "javascript", "s.js", 2), ("*.get", "m.get('k')", "javascript", "s.js", 3), ("*.use", "app.use(authCheck)", "javascript", "s.js", 4)], "name string, qualified_name string, language string, file_path string, start_line int")
    assert values(frameworks.express_routes(calls), "http_method", "path_pattern") == [("GET", "/a/{id}")]
    assert [(r.name, r.kind) for r in frameworks.middleware(calls).collect()] == [("cors", "cors"), ("authCheck", "authentication")]
    config = spark.createDataFrame([("r.ts", "routes = [{ path: '/h/:id', component: Home }, { path: \"/b\", component: () => import('@/B.vue') }, { path: '/h/:id', component: Twice }]")], "path string, content string")
    assert values(frameworks.configured_routes(config), "path_pattern", "handler") == [("/b", "@/B.vue"), ("/h/{id}", "Home")]


def test_json_of_models(spark):
    broken = '```json\n[{"title": "a "quoted" b", "n": 1}\n {"title": "c",}]\n```'
    assert json.loads(jsons.repaired(broken)) == [{"title": 'a "quoted" b', "n": 1}, {"title": "c"}]
    assert jsons.repaired("no json") is None and jsons.repaired(None) is None and jsons.balanced('x {"a": "}"} y') == '{"a": "}"}'
    rows = spark.createDataFrame([('```json\n[{"title": "t", "category": "DS", "prefix": "1", "confidence": 0.5}]\n```',), ('{"items": [{"title": "u"}]}',), ('{"title": "v"}',), ("{",)], "t string")
    points = rows.select(jsons.points(F.col("t")).alias("p"))
    assert [[x.title for x in r.p] if r.p else None for r in points.collect()] == [["t"], ["u"], ["v"], None]
    first = points.select(F.transform("p", jsons.normalised_point).alias("n")).collect()
    assert (first[0].n[0].category, first[0].n[0].prefix) == ("AL", "AL-1") and first[1].n == [None]
    assert [r.r for r in jsons.with_repaired(rows, "t", "r").collect()][3] is None


def test_strings_and_vectors(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first().c
    assert get(text.guessed_class(F.lit("userService.save"))) == "UserService" and get(text.guessed_class(F.lit("this.save"))) is None
    assert [get(text.call_name(F.lit(x))) for x in ("a.b.m", "new X", "f")] == ["*.m", "new X", "f"]
    assert get(text.import_name(F.lit("'./x'"))) == "./x" and get(text.import_name(F.lit("a.b as c"))) == "a.b"
    assert get(text.collapsed_path(F.lit("a/./b/../c"))) == "a/c" and get(text.abbreviated_path(F.lit("aa/bb/cc.py"), 6)) == ".../cc.py"
    assert get(text.version_tag(F.lit("2024-01-02").cast("date"), F.lit("abcdef0123"))) == "v20240102-abcdef01"
    assert get(text.appended(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a")))) == ["a", "b"]
    assert get(vectors.fitted(F.array(F.lit(1.0)), 3)) == [1.0, 0.0, 0.0] and get(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert get(vectors.hashed_embedding(F.lit("a b a"), 8)) == get(vectors.hashed_embedding(F.lit("b a a"), 8))


def test_evaluation(spark):
    pairs = spark.createDataFrame([("c", 0, 0), ("c", 0, 1), ("c", 1, 1), ("c", 1, 2), ("d", 0, 0)], "case string, expected_at int, found_at int")
    chosen = evaluation.assigned(pairs, ["case"])
    assert values(chosen, "case", "expected_at", "found_at") == [("c", 0, 0), ("c", 1, 1), ("d", 0, 0)]
    expected = spark.createDataFrame([("c",), ("c",), ("d",), ("e",)], "case string")
    found = spark.createDataFrame([("c",), ("c",), ("c",), ("d",)], "case string")
    assert values(evaluation.confusion(expected, found, chosen, ["case"]), "case", "tp", "fp", "fn") == [("c", 2, 1, 0), ("d", 1, 0, 0), ("e", 0, 0, 1)]
    titles = spark.createDataFrame([("Observer Pattern", None, "observer pattern"), ("Observer Pattern", ["Pub Sub"], "pub sub"), ("Observer Pattern", None, "Observer Patterns"), ("Observer", None, "Factory")], "e string, a array<string>, f string")
    assert [r.m for r in titles.select(evaluation.title_match(F.col("e"), F.col("a"), F.col("f")).alias("m")).collect()] == [True, True, True, False]
    ratings = spark.createDataFrame([("0.9",), ("x",), ("2",), ("-1",)], "r string")
    assert ratings.agg(evaluation.mean_rating(F.col("r")).alias("m")).first().m == (0.9 + 0.5 + 1 + 0) / 4
    match = evaluation.point_match(F.lit(True), evaluation.line_match(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))), evaluation.semantic_match(F.array(F.lit(1.0)), F.array(F.lit(-1.0))))
    assert spark.range(1).select(match.alias("m")).first().m is True
    index = search.postings(spark.createDataFrame([(1, "Red fox"), (2, "red hen")], "id long, t string"), "id", ["t"])
    assert values(search.full_text(index, ["red", "FOX"], every=True), "id") == [(1,)]
