"""Queries of the source, structure and framework operators on inputs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithic.functions import jsons
from lithic.functions import text as tx
from lithic.operators import evaluation as ev
from lithic.operators import frameworks as fw
from lithic.operators import graphs as gr
from lithic.operators import levels
from lithic.operators import matching as mt
from lithic.operators import tables as tb
from lithic.plans.queries import _PATHS, _t, query
from lithic.sources import manifests, parsers, scan


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'unknown' ELSE 'markdown' END AS language FROM part")
def detected_language(spark, sf):
    names = F.array(*(F.lit(x) for x in ("a.py", "b/c.d.TSX", "x.js.map", "Makefile", "README.md")))
    return _t(spark, sf, "part").select("p_partkey", scan.language(F.get(names, F.col("p_size") % 5)).alias("language"))


@query("""
SELECT p_partkey FROM part WHERE p_size % 6 IN (0, 3, 5)
""")
def scanned_files(spark, sf):
    paths = F.array(*(F.lit(x) for x in ("src/a.py", "node_modules/b.js", "x/build/c.py", "web/package.json", "data.json", "build.go")))
    rows = _t(spark, sf, "part").select("p_partkey", F.get(paths, F.col("p_size") % 6).alias("path"))
    return rows.where(scan.is_wanted(F.col("path"))).select("p_partkey")


@query("SELECT p_partkey, 'pip' AS ecosystem, 'part' || p_partkey AS artifact_name, p_size || '.0' AS version, '==' || p_size || '.0' AS version_range FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'pip', 'part' || p_partkey, NULL, '>=' || p_size FROM part WHERE p_size % 2 = 1")
def pip_requirements(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    spec = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("=="), size, F.lit(".0"))).otherwise(F.concat(F.lit(">="), size))
    files = _t(spark, sf, "part").select(F.concat(key, F.lit("/requirements.txt")).alias("path"), F.concat(F.lit("# parts\n-r base.txt\npart"), key, F.lit(" "), spec, F.lit("  # "), F.col("p_brand"), F.lit("\nskipped[x]==1\n")).alias("content"))
    found = manifests.requirements(files)
    return found.select(F.substring_index("path", "/", 1).cast("long").alias("p_partkey"), "ecosystem", "artifact_name", "version", "version_range")


@query("SELECT event_id, 'npm' AS ecosystem, 'k' AS artifact_name, CAST(json_extract(props, '$.k') AS VARCHAR) AS version, CASE WHEN event_type = 'click' THEN 'dev' ELSE 'compile' END AS scope FROM events")
def npm_manifests(spark, sf):
    section = F.when(F.col("event_type") == "click", "devDependencies").otherwise("dependencies")
    files = _t(spark, sf, "events").select(F.concat(F.col("event_id").cast("string"), F.lit("/package.json")).alias("path"), F.concat(F.lit('{"'), section, F.lit('": '), "props", F.lit("}")).alias("content"))
    return manifests.npm(files).select(F.substring_index("path", "/", 1).cast("long").alias("event_id"), "ecosystem", "artifact_name", "version", "scope")


@query("SELECT p_brand AS group_name, min(p_partkey) AS first_part FROM part GROUP BY p_brand")
def first_dependency(spark, sf):
    key = F.col("p_partkey").cast("string")
    files = _t(spark, sf, "part").select(F.concat(F.lpad(key, 12, "0"), F.lit("/build.gradle")).alias("path"), F.concat(F.lit("dependencies {\n implementation '"), "p_brand", F.lit(":core:1."), key, F.lit("'\n}")).alias("content"))
    found = manifests.gradle(files).withColumn("part", F.substring_index("path", "/", 1).cast("long"))
    return tb.one_per_key(found, ["ecosystem", "group_name", "artifact_name"], [F.asc("path"), F.asc("at")]).select("group_name", F.col("part").alias("first_part"))


@query("SELECT s_suppkey, 'f_' || s_suppkey AS name, 'm' || s_suppkey || '.f_' || s_suppkey AS qualified_name, 2 AS start_line FROM supplier")
def python_functions(spark, sf):
    key = F.col("s_suppkey").cast("string")
    code = F.concat(F.lit("import os\ndef f_"), key, F.lit("(a):\n    return os.path.join(a)\n"))
    files = _t(spark, sf, "supplier").select(F.concat(F.lit("m"), key, F.lit(".py")).alias("path"), F.lit("python").alias("language"), code.alias("content"))
    found = parsers.nodes(files).where("node_type = 'function'")
    return found.select(F.substring("name", 3, 20).cast("long").alias("s_suppkey"), "name", "qualified_name", "start_line")


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'dynamic' WHEN c_mktsegment = 'BUILDING' THEN 'static' WHEN c_mktsegment = 'FURNITURE' THEN 'external' ELSE 'unknown' END AS call_type,
       CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_nationkey AS VARCHAR) END AS callee, CASE WHEN c_custkey % 25 < 20 THEN CAST(c_custkey % 25 AS VARCHAR) END AS caller FROM customer
""")
def resolved_calls(spark, sf):
    nations = _t(spark, sf, "nation")
    none = F.array().cast("array<string>")
    key = F.col("n_nationkey").cast("string")
    functions = nations.select(key.alias("id"), F.when(F.col("n_nationkey") < 20, key).otherwise("none").alias("file_id"), F.col("n_name").alias("name"), F.concat(F.lit("geo."), "n_name").alias("qualified_name"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), none.alias("annotations"))
    joined = _t(spark, sf, "customer").join(F.broadcast(nations.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.col("c_mktsegment")
    name = F.when(segment == "AUTOMOBILE", "getattr").when(segment == "BUILDING", F.col("n_name")).when(segment == "FURNITURE", "*.array").otherwise("nowhere")
    calls = joined.select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 25).cast("string").alias("file_id"), F.lit(5).alias("start_line"), name.alias("name"), F.when(segment == "FURNITURE", "numpy.array").alias("qualified_name"), F.lit("python").alias("language"))
    return levels.resolved(calls, functions).select(F.col("id").cast("long").alias("c_custkey"), "call_type", F.col("callee_node_id").alias("callee"), F.col("caller_node_id").alias("caller"))


@query(_PATHS + """
, keys AS (SELECT prefix AS k, min(page_id) AS r FROM prefixes WHERE i <= 2 GROUP BY prefix),
m AS (SELECT p.page_id, keys.r, lower(p.path) = lower(k) AS exact FROM p JOIN keys ON lower(p.path) = lower(k) OR starts_with(lower(p.path), lower(k) || '/') OR starts_with(lower(k), lower(p.path) || '/'))
SELECT page_id, r, exact FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY exact DESC, r) AS n FROM m) WHERE n = 1
""")
def prefix_join(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", tx.url_path(F.col("url")).alias("path"))
    spread = pages.select("page_id", F.posexplode(tx.path_prefixes(F.col("path"))).alias("i", "k")).where("i < 2")
    keys = spread.groupBy("k").agg(F.min("page_id").alias("r"))
    return mt.prefix_matches(pages, keys, "path", "k", "page_id", "r", separator="/")


@query(_PATHS + """
, files AS (SELECT path, min(page_id) AS file_id FROM p GROUP BY path), nodes AS (SELECT page_id, '/srv/' || path AS absolute FROM p),
m AS (SELECT page_id, file_id, row_number() OVER (PARTITION BY page_id ORDER BY length(path) DESC) AS r FROM nodes JOIN files ON ends_with(absolute, '/' || path))
SELECT page_id, file_id FROM m WHERE r = 1
""")
def suffix_join(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", tx.url_path(F.col("url")).alias("path"))
    files = pages.groupBy("path").agg(F.min("page_id").alias("file_id"))
    nodes = pages.select(F.col("page_id").alias("id"), F.concat(F.lit("/srv/"), "path").alias("at"))
    return mt.files_of_paths(nodes, files, "at").select(F.col("id").alias("page_id"), "file_id")


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN p_partkey END AS file_id, CASE WHEN p_size % 4 = 3 THEN 'external' ELSE 'absolute' END AS import_type FROM part
""")
def module_paths(spark, sf):
    key = F.col("p_partkey").cast("string")
    ending = F.get(F.array(*(F.lit(x) for x in (".py", "/index.ts", ".java", "2.py"))), F.col("p_size") % 4)
    files = _t(spark, sf, "part").select(F.concat(F.lit("pkg/m"), key, F.lit("x"), ending).alias("path"), F.col("p_partkey").alias("file_id"))
    imports = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("pkg.m"), key, F.lit("x")).alias("name"))
    found = mt.resolved_paths(imports.withColumn("path", tx.module_path(F.col("name"))), files, "path")
    return found.select("p_partkey", F.col("imported_file_id").alias("file_id"), mt.import_kind(F.col("name"), F.col("imported_file_id")).alias("import_type"))


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent FROM part), w AS (
  SELECT id, 0 AS depth FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, depth + 1 FROM w JOIN n ON n.parent = w.id)
SELECT id, depth FROM w WHERE depth <= 6
""")
def tree_depths(spark, sf):
    parent = F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10))
    return gr.tree_depths(_t(spark, sf, "part").select(F.col("p_partkey").alias("id"), parent.alias("parent_id")), 6)


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'http-controller' WHEN 'MACHINERY' THEN 'flask-route' WHEN 'HOUSEHOLD' THEN 'react-hook' ELSE '' END AS tags FROM customer")
def node_tags(spark, sf):
    segment = F.col("c_mktsegment")
    pick = lambda a, b, c, other: F.when(segment == "BUILDING", a).when(segment == "MACHINERY", b).when(segment == "HOUSEHOLD", c).otherwise(other)
    nodes = _t(spark, sf, "customer").select("c_custkey", pick("java", "python", "typescript", "rust").alias("language"), F.lit("function").alias("node_type"), pick("A", "b", "useThing", "x").alias("name"), F.array(pick("@Controller", "@app.route('/x')", "", "")).alias("annotations"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("signature"))
    return fw.tagged(nodes).select("c_custkey", F.array_join("tags", ",").alias("tags"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'GET' ELSE 'PUT' END AS http_method, '/s/' || s_nationkey || '/{id}' AS path_pattern FROM supplier")
def annotated_routes(spark, sf):
    even = F.col("s_nationkey") % 2 == 0
    path = F.concat(F.lit('"/s/'), F.col("s_nationkey").cast("string"), F.when(even, '/:id"').otherwise('/<int:id>"'))
    args = F.when(even, F.array(path)).otherwise(F.array(path, F.lit("methods=['PUT']")))
    nodes = _t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.lit("method").alias("node_type"), F.col("s_suppkey").cast("string").alias("name"), F.lit("f").alias("file_path"), F.array(F.struct(F.when(even, "@GetMapping").otherwise("@bp.route").alias("name"), args.alias("args"))).alias("annotations"))
    return fw.annotated_routes(nodes).select(F.col("handler").cast("long").alias("s_suppkey"), "http_method", "path_pattern")


@query("SELECT event_id, 'POST' AS http_method, '/' || event_type || '/{id}' AS path_pattern FROM events WHERE event_id % 3 = 0")
def call_routes(spark, sf):
    path = F.concat(F.lit("app.post('/"), "event_type", F.lit("/:id', f)"))
    plain = F.concat(F.lit("map.get('"), "event_type", F.lit("')"))
    calls = _t(spark, sf, "events").select(F.col("event_id").cast("string").alias("name"), F.when(F.col("event_id") % 3 == 0, path).otherwise(plain).alias("qualified_name"), F.lit("typescript").alias("language"), F.lit("f").alias("file_path"))
    return fw.express_routes(calls).select(F.col("handler").cast("long").alias("event_id"), "http_method", "path_pattern")


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'logging' WHEN 'signup' THEN 'authentication' WHEN 'view' THEN 'cors' ELSE 'generic' END AS kind FROM events WHERE event_type <> 'click'
""")
def middleware_kinds(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "error", "errorLogger").when(kind == "signup", "authGuard").when(kind == "view", "cors").otherwise("other")
    calls = _t(spark, sf, "events").select(F.when(kind == "click", "*.get").otherwise("*.use").alias("name"), F.concat(F.lit("app.use("), name, F.lit("())")).alias("qualified_name"), F.lit("f").alias("file_path"), F.col("event_id").alias("start_line"))
    return fw.middleware(calls).select(F.col("start_line").alias("event_id"), "kind")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'AL' WHEN 'view' THEN 'DP' WHEN 'error' THEN 'ET' END AS category, event_type AS title FROM events WHERE event_type IN ('click', 'view', 'error')")
def model_json(spark, sf):
    kind = F.col("event_type")
    code = F.when(kind == "click", "DS").when(kind == "view", "DP").when(kind == "error", "SEC").otherwise("??")
    point = F.concat(F.lit('{"title": "'), kind, F.lit('", "category": "'), code, F.lit('", "prefix": "1", "confidence": 0.5}'))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n["), point, F.lit("]\n```"))).otherwise(F.concat(F.lit('{"items": ['), point, F.lit("]}")))
    found = _t(spark, sf, "events").select("event_id", F.explode(jsons.points(text)).alias("p")).select("event_id", jsons.normalised_point(F.col("p")).alias("p"))
    return found.where("p is not null").select("event_id", "p.category", "p.title")


@query("""
WITH e AS (SELECT user_id % 7 AS c, event_type AS k, count(*) FILTER (WHERE event_id % 3 = 0) AS e, count(*) FILTER (WHERE event_id % 3 <> 0) AS f FROM events GROUP BY 1, 2)
SELECT c, k, least(e, f) AS tp, f - least(e, f) AS fp, e - least(e, f) AS fn FROM e
""")
def greedy_confusion(spark, sf):
    events = _t(spark, sf, "events").select((F.col("user_id") % 7).alias("c"), F.col("event_type").alias("k"), F.col("event_id").alias("at"), (F.col("event_id") % 3 == 0).alias("is_expected"))
    expected, found = events.where("is_expected").withColumnRenamed("at", "expected_at"), events.where("not is_expected").withColumnRenamed("at", "found_at")
    # every pair of a group matches: the i-th found takes the i-th expected
    nth = lambda df, at: df.select("c", "k", at, F.row_number().over(Window.partitionBy("c", "k").orderBy(at)).alias("i"))
    return ev.confusion(expected, found, nth(expected, "expected_at").join(nth(found, "found_at"), ["c", "k", "i"]), ["c", "k"])


@query("SELECT o_custkey AS a, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 20 GROUP BY 1")
def others_across(spark, sf):
    customers = _t(spark, sf, "customer").where("c_nationkey < 20")
    edges = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("a"), F.col("o_orderpriority").alias("b"))
    nodes = customers.select(F.col("c_custkey").cast("string").alias("id"), F.lit("f").alias("file_id")).union(edges.select("b", F.lit("g")).distinct())
    return gr.across(edges, nodes).select(F.col("a").cast("long").alias("a"), F.size("others").cast("long").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE lang NOT IN ('de', 'fr')")
def preserved_rows(spark, sf):
    points = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("lang").alias("files"), F.lit("v1").alias("version"), "source")
    gone = spark.createDataFrame([("de",), ("fr",)], "path string")
    return gr.preserved(points, gone, "files", "v2").where("version = 'v2'").select(F.col("id").alias("doc_id"), "source")
