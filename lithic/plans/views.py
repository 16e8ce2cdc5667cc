"""Queries of what lists, pages and reports show."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import hierarchy as hi
from lithic.operators import tables as tb
from lithic.operators import views as vw
from lithic.plans.queries import _LINKS, _links, _t, query


@query("""
WITH e AS (SELECT l_orderkey AS caller, l_linenumber AS line, l_partkey AS callee FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM'))
SELECT caller, line, callee, p_name AS callee_name, CAST(row_number() OVER (PARTITION BY caller ORDER BY line, callee) AS INTEGER) AS at FROM e LEFT JOIN part ON p_partkey = callee AND p_size < 40
""")
def calls_shown(spark, sf):
    """Lines as calls of orders of two kinds, with the part's name where there is a node for it."""
    orders, parts = _t(spark, sf, "orders"), _t(spark, sf, "part").where("p_size < 40")
    none = F.lit(None).cast("string")
    nodes = orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("node_type"), none.alias("name"), none.alias("file_path"))
    nodes = nodes.union(parts.select(F.col("p_partkey").cast("string"), F.lit("part"), "p_name", none))
    edges = _t(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("caller_node_id"), F.col("l_partkey").cast("string").alias("callee_node_id"), F.col("l_linenumber").alias("start_line"), F.col("l_partkey").alias("start_column"))
    listed = vw.call_list(edges, nodes, ["1-URGENT", "3-MEDIUM"])
    return listed.select(F.substring("caller_node_id", 2, 20).cast("long").alias("caller"), F.col("start_line").alias("line"), F.col("callee_node_id").cast("long").alias("callee"), "callee_name", "at")


@query(_LINKS + """,
e AS (SELECT DISTINCT a.path AS a, r.path AS b FROM resolved r JOIN p a USING (page_id) WHERE r.path IS NOT NULL AND a.path <> r.path),
f AS (SELECT DISTINCT path FROM p),
o AS (SELECT a AS path, string_agg(b, ',' ORDER BY b) AS x FROM e GROUP BY 1), i AS (SELECT b AS path, string_agg(a, ',' ORDER BY a) AS x FROM e GROUP BY 1)
SELECT path, coalesce(o.x, '') AS imports, coalesce(i.x, '') AS importers FROM f LEFT JOIN o USING (path) LEFT JOIN i USING (path)
""")
def linked_files(spark, sf):
    """Pages as files, their internal links as imports."""
    from lithic.functions.text import url_path

    pages = _t(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    resolved = _links(spark, sf)[1].select("page_id", F.col("path").alias("imported_file_id"))
    imports = resolved.join(pages.select("page_id", F.col("path").alias("importer_file_id")), "page_id")
    files = pages.select("path", F.col("path").alias("file_id")).distinct()
    found = vw.file_links(imports, files)
    return found.select("path", F.array_join("imports", ",").alias("imports"), F.array_join("importers", ",").alias("importers"))


@query("""
SELECT user_id, count(*) AS n, string_agg(DISTINCT framework, ',' ORDER BY framework) AS frameworks, string_agg(DISTINCT upper(event_type), ',' ORDER BY upper(event_type)) AS methods
FROM (SELECT *, 'fw' || event_id % 4 AS framework FROM events) WHERE lower('/Api/U' || user_id) LIKE '%u1%' AND framework <> 'fw3' GROUP BY user_id
""")
def routes_shown(spark, sf):
    """Events as routes of users whose number begins with 1, of three frameworks."""
    routes = _t(spark, sf, "events").select("user_id", F.col("event_type").alias("http_method"), F.concat(F.lit("/Api/U"), F.col("user_id").cast("string")).alias("path_pattern"), F.concat(F.lit("fw"), (F.col("event_id") % 4).cast("string")).alias("framework"))
    found = vw.route_summary(vw.route_list(routes, "U1", None, ["fw0", "fw1", "fw2"]), "user_id")
    return found.select("user_id", "n", F.array_join("frameworks", ",").alias("frameworks"), F.array_join("methods", ",").alias("methods"))


@query("SELECT event_type AS framework, event_id, value AS confidence, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS at FROM events WHERE value >= 80 AND upper(event_type) = 'CLICK'")
def confident_patterns(spark, sf):
    """Clicks as patterns of one framework, surest first."""
    patterns = _t(spark, sf, "events").select(F.col("event_type").alias("framework"), F.col("event_id"), F.col("value").alias("confidence"), F.col("event_type").alias("http_method"), F.lit("").alias("path_pattern"))
    found = vw.route_list(vw.confident(patterns, 80.0), method="Click").select("framework", "event_id", "confidence")
    return vw.numbered_list(found, [F.desc("confidence"), F.asc("event_id")], within=["framework"])


@query("""
SELECT p_type AS "artifactName", p_brand AS "groupName", p_partkey AS "partKey", CAST(row_number() OVER (PARTITION BY p_size % 3 ORDER BY p_type, p_brand, p_partkey) AS INTEGER) AS at FROM part WHERE p_size % 3 = 1 AND p_retailprice > 950
""")
def dependencies_shown(spark, sf):
    """Parts as dependencies of three ecosystems and two scopes, under the interface's names."""
    deps = _t(spark, sf, "part").select((F.col("p_size") % 3).cast("string").alias("ecosystem"), F.when(F.col("p_retailprice") > 950, "compile").otherwise("dev").alias("scope"), F.col("p_type").alias("artifact_name"), F.col("p_brand").alias("group_name"), F.col("p_partkey").alias("path"))
    found = vw.dependency_list(deps, "1", "compile").withColumnRenamed("path", "part_key")
    return vw.camel(found.select("artifact_name", "group_name", "part_key", "at"))


@query("""
WITH p AS (SELECT user_id AS branch, event_type || floor(value / 10) AS title, event_id FROM events WHERE event_id % 3 > 0),
n AS (SELECT user_id AS branch, event_type || floor(value / 10) AS title, event_id FROM events WHERE event_id % 3 = 0),
fresh AS (SELECT * FROM n WHERE (branch, title) NOT IN (SELECT branch, title FROM p)),
g AS (SELECT DISTINCT branch FROM fresh)
SELECT * FROM p WHERE branch IN (FROM g) OR branch NOT IN (SELECT branch FROM n) UNION ALL SELECT * FROM fresh UNION ALL SELECT * FROM n WHERE branch NOT IN (FROM g)
""")
def points_merged(spark, sf):
    """Events as titled points of two steps, by user."""
    events = _t(spark, sf, "events").withColumn("title", F.concat("event_type", F.floor(F.col("value") / 10).cast("double").cast("string")))
    rows = events.select(F.col("user_id").alias("branch"), "title", "event_id")
    return vw.merged_points(rows.where("event_id % 3 > 0"), rows.where("event_id % 3 = 0"), "branch")


@query("""
SELECT event_id, concat_ws(',', CASE WHEN event_id % 7 > 4 THEN 'category' END, CASE WHEN event_id % 7 > 4 OR event_id % 5 = 0 THEN 'prefix' END, CASE WHEN event_id % 11 = 0 THEN 'title' END, CASE WHEN event_id % 13 = 0 THEN 'description' END, CASE WHEN value > 100 THEN 'confidence' END) AS errors FROM events
""")
def points_checked(spark, sf):
    """Events as extracted points with faults of every kind."""
    key = F.col("event_id")
    category = F.get(F.array(*(F.lit(c) for c in ("DP", "AD", "AL", "ET", "TK", "XX", "dp"))), (key % 7).cast("int"))
    rows = _t(spark, sf, "events").select("event_id", category.alias("category"), F.concat(category, F.when(key % 5 == 0, "-").otherwise("-Name")).alias("prefix"), F.when(key % 11 == 0, "").otherwise("t").alias("title"), F.when(key % 13 != 0, "d").alias("description"), (F.col("value") / 100).alias("confidence"))
    return tb.with_errors(rows, vw.point_checks()).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("""
SELECT l_returnflag AS model, round(sum(l_quantity * 3.0 / 1000000 + l_linenumber * CASE l_returnflag WHEN 'A' THEN 15.0 ELSE 6.0 END / 1000000), 6) AS cost FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1
UNION ALL SELECT 'R', 0.0
""")
def model_costs(spark, sf):
    """Lines as model calls; one model has no price."""
    calls = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("prompt_tokens"), F.col("l_linenumber").alias("completion_tokens"))
    prices = spark.createDataFrame([("A", 3.0, 15.0), ("N", 3.0, 6.0)], "model string, input double, output double")
    return vw.call_costs(calls, prices).groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'app.use(cors())' WHEN 'view' THEN 'middleware_at_line_' || user_id ELSE event_type END AS name FROM events")
def middleware_names(spark, sf):
    kind = F.col("event_type")
    return _t(spark, sf, "events").select("event_id", vw.middleware_name(F.when(kind == "view", "*.use(x)").otherwise(F.concat(kind, F.lit("(a, b)"))), F.when(kind == "click", "app.use(cors())").when(kind == "view", "*.use"), F.col("user_id")).alias("name"))


@query("""
WITH RECURSIVE n AS (SELECT o_orderkey AS id, o_custkey AS f, o_orderkey AS s, o_orderkey + CAST(floor(o_totalprice / 20) AS BIGINT) AS e, o_orderstatus AS st FROM orders),
c AS (SELECT a.id, b.id AS p, row_number() OVER (PARTITION BY a.id ORDER BY b.s DESC, b.e, b.id DESC) AS r FROM n a JOIN n b ON a.f = b.f AND b.s <= a.s AND b.e >= a.e AND b.id <> a.id),
up AS (SELECT id, p AS above FROM c WHERE r = 1 UNION ALL SELECT up.id, c.p FROM up JOIN c ON c.id = up.above AND c.r = 1)
SELECT n.f AS file_id, up.above AS ancestor, up.id FROM up JOIN n ON n.id = up.above WHERE n.st = 'P'
""")
def span_descendants(spark, sf):
    """What lies below the pending orders, orders being spans of their customers."""
    key, none = F.col("o_orderkey"), F.lit(None).cast("int")
    orders = _t(spark, sf, "orders")
    spans = orders.select(F.col("o_custkey").alias("file_id"), key.alias("id"), none.cast("long").alias("parent_id"), key.alias("start_line"), none.alias("start_column"), (key + F.floor(F.col("o_totalprice") / 20)).alias("end_line"), none.alias("end_column"))
    return vw.descendants(hi.tree(spans), orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("file_id"), key.alias("id")))


@query("""
WITH s AS (SELECT 'v' || l_linenumber AS v, CASE l_returnflag WHEN 'A' THEN 'storing' ELSE 'parsing' END AS stage, CASE WHEN l_partkey % 9 > 0 THEN l_partkey END AS file_id, l_orderkey AS content_hash FROM lineitem)
SELECT v AS version, file_id, content_hash FROM s WHERE stage = 'storing' AND file_id IS NOT NULL AND v = (SELECT max(v) FROM s WHERE stage = 'storing')
""")
def newest_snapshot(spark, sf):
    rows = _t(spark, sf, "lineitem")
    part = F.col("l_partkey")
    snapshots = rows.select(F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("analysis_version"), F.when(F.col("l_returnflag") == "A", "storing").otherwise("parsing").alias("stage"), F.when(part % 9 > 0, part).alias("file_id"), F.col("l_orderkey").alias("content_hash"))
    return vw.latest_snapshot(snapshots, "storing")


@query("""
WITH g AS (SELECT user_id, event_type AS version, max(ts) AS last_at FROM events GROUP BY 1, 2)
SELECT * FROM (SELECT user_id, version, last_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, version DESC) AS INTEGER) AS "at" FROM g) WHERE "at" <= 3
""")
def versions_shown(spark, sf):
    return vw.version_list(_t(spark, sf, "events").withColumnRenamed("event_type", "version"), ["user_id"], "version", "ts", 3)


@query("SELECT user_id, event_id, status FROM (SELECT user_id, event_id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('purchase', 'signup')) WHERE r = 1")
def latest_by_status(spark, sf):
    rows = _t(spark, sf, "events").withColumnRenamed("event_type", "status")
    return vw.latest_of_status(rows, ["user_id"], "ts", "event_id", ["purchase", "signup"]).select("user_id", "event_id", "status")


@query("""
WITH d AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 'deleted' WHEN 'F' THEN 'modified' ELSE 'added' END AS change FROM orders WHERE o_totalprice > 400000)
SELECT k FROM d WHERE change <> 'deleted' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50
""")
def files_to_analyse(spark, sf):
    """Dear orders changed, those with large lines are reached."""
    status = F.col("o_orderstatus")
    changed = _t(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("k"), F.when(status == "P", "deleted").when(status == "F", "modified").otherwise("added").alias("change"))
    return vw.to_analyse(changed, _t(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("k")), "k")
