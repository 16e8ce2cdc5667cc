"""Queries of what is kept and brought up to date: change propagation, node tables, indexes, streams, matching in rounds, calls in levels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lithic.operators import evaluation as ev
from lithic.operators import graphs as gr
from lithic.operators import hierarchy as hi
from lithic.operators import incremental as inc
from lithic.operators import levels
from lithic.operators import matching as mt
from lithic.operators import search as se
from lithic.operators.stored_index import StoredIndex
from lithic.operators.versions import Versions
from lithic.plans.queries import ORACLES, _t, query
from lithic.sources.staging import scratch
from lithic.streaming import guards

_REACH = """
WITH f AS (SELECT o_orderkey AS id FROM orders UNION ALL SELECT -page_id FROM pages),
n AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS file_id FROM lineitem),
calls AS (SELECT DISTINCT a.file_id AS a, b.file_id AS b FROM lineitem JOIN n a ON a.id = l_orderkey * 10 + l_linenumber JOIN n b ON b.id = l_partkey * 10 + 1 WHERE a.file_id <> b.file_id),
imports AS (SELECT DISTINCT * FROM (SELECT o_orderkey AS a, o_custkey AS b FROM orders UNION ALL SELECT -page_id, page_id * 40 FROM pages) WHERE a <> b),
s AS (SELECT a, b, 'callee' AS kind FROM calls UNION ALL SELECT b, a, 'caller' FROM calls UNION ALL SELECT a, b, 'importee' FROM imports UNION ALL SELECT b, a, 'importer' FROM imports),
zero AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 499900 AND o_orderstatus <> 'P'),
one AS (SELECT b AS id, list_sort(list(DISTINCT kind)) AS kinds FROM zero JOIN s ON a = zero.id WHERE b NOT IN (FROM zero) GROUP BY b),
two AS (SELECT b AS id, list_sort(list(DISTINCT kind)) AS kinds FROM one JOIN f USING (id) JOIN s ON a = id WHERE kind <> 'importer' AND b NOT IN (FROM zero) AND b NOT IN (SELECT id FROM one) GROUP BY b)
SELECT id AS file_id, 1 AS depth, array_to_string(kinds, ',') AS kinds FROM one UNION ALL SELECT id, 2, array_to_string(kinds, ',') FROM two
"""


@query(_REACH)
def propagated_changes(spark, sf):
    """Orders and pages as files, lines as nodes; a line calls the first line of the order numbered as its part."""
    orders, lines, pages = _t(spark, sf, "orders"), _t(spark, sf, "lineitem"), _t(spark, sf, "pages")
    files = orders.select(F.col("o_orderkey").alias("file_id")).union(pages.select(-F.col("page_id")))
    node = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    nodes = lines.select(node.alias("id"), F.col("l_orderkey").alias("file_id")).distinct()
    calls = lines.select(node.alias("caller_node_id"), (F.col("l_partkey") * 10 + 1).alias("callee_node_id"))
    imports = orders.select(F.col("o_orderkey").alias("importer_file_id"), F.col("o_custkey").alias("imported_file_id")).union(pages.select(-F.col("page_id"), F.col("page_id") * 40))
    changed = orders.where("o_totalprice > 499900").select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("modified").alias("change"))
    found = inc.propagated(files, nodes, calls, imports, changed, 2, {"importer": 1})
    return found.withColumn("kinds", F.array_join("kinds", ","))


def _code(spark, sf, size):
    """A Python file per part, with a function whose default is its size."""
    key = F.col("p_partkey").cast("string")
    code = F.concat(F.lit("import os\n\ndef f_"), key, F.lit("(a="), size.cast("string"), F.lit("):\n    return os.path.join(a)\n"))
    return _t(spark, sf, "part").select("p_brand", "p_size", F.concat(F.lit("pkg/m"), key, F.lit(".py")).alias("path"), F.lit("python").alias("language"), code.alias("content"))


@query("""
SELECT 'pkg/m' || p_partkey || '.py' AS file_path, kind, CASE kind WHEN 'function' THEN 'f_' || p_partkey || '(a=' || p_size || ')' ELSE 'os.path.join' END AS text
FROM part, (VALUES ('function'), ('call')) k(kind) WHERE p_size <> 7
""")
def incremental_parse(spark, sf):
    """Parsed before an edit, then brought up to date: parts of size 3 were smaller, size 5 is new, size 7 went."""
    before = _code(spark, sf, F.when(F.col("p_size") == 3, 0).otherwise(F.col("p_size"))).where("p_size <> 5")
    now = _code(spark, sf, F.col("p_size")).where("p_size <> 7")
    table = inc.NodeTable(spark, scratch(spark), 32)
    table.update(before.drop("p_brand", "p_size"))
    table.update(now.drop("p_brand", "p_size"))
    found = table.nodes().where("node_type in ('function', 'call')")
    text = F.when(F.col("node_type") == "function", F.substring("signature", 5, 100)).otherwise(F.col("qualified_name"))
    return found.select("file_path", F.col("node_type").alias("kind"), text.alias("text"))


def _streamed(spark, sf, made, speed, failed):
    """The events table as a stream of calls per user, run to its end; time runs 1 / speed times as fast."""
    stored = _t(spark, sf, "events").schema
    events = guards.with_state_store(spark).readStream.schema(stored).parquet(f"{sf}/event[s].parquet")  # a pattern, since a stream takes a single file only so
    calls = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 * speed).alias("at"), failed.alias("failed"))
    return guards.run_to_end(made(calls), scratch(spark), scratch(spark))


@query(ORACLES["token_bucket"])
def streamed_token_bucket(spark, sf):
    return _streamed(spark, sf, guards.limited_stream, 1e-5, F.lit(False))


@query(ORACLES["circuit_breaker"])
def streamed_circuit_breaker(spark, sf):
    return _streamed(spark, sf, guards.broken_stream, 1e-3, F.col("event_type") != "purchase").where("id is not null")


_STORED = """
WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 100 = 7 THEN 'the rewritten text of ' || lang ELSE text END AS t, n_chars FROM documents WHERE doc_id % 100 <> 3),
p AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(t), '[^a-z0-9_]+')) AS word FROM d)
"""


def _index(spark, sf):
    """All documents, then an update in which one in a hundred is rewritten and one goes."""
    docs = _t(spark, sf, "documents")
    index = StoredIndex(spark, scratch(spark), 32)
    index.update(docs, None, "doc_id", ["text"])
    rewritten = docs.where("doc_id % 100 = 7").select("doc_id", F.concat(F.lit("the rewritten text of "), "lang").alias("text"))
    index.update(rewritten, docs.where("doc_id % 100 = 3").select("doc_id"), "doc_id", ["text"])
    return index


@query(_STORED + "SELECT id AS doc_id, count(*) AS hits, any_value(n_chars) AS n_chars FROM p JOIN d USING (id) WHERE word IN ('the', 'text', 'tion') GROUP BY id ORDER BY hits DESC, n_chars DESC, doc_id LIMIT 20")
def stored_search(spark, sf):
    found = _index(spark, sf).search(["The", "text", "tion"])
    return se.result_page(_t(spark, sf, "documents").select("doc_id", "n_chars").join(found, F.col("id") == F.col("doc_id")), "n_chars", "doc_id").select("doc_id", "hits", "n_chars")


@query(_STORED + "SELECT word, count(*) AS n FROM p WHERE word IN ('the', 'rewritten', 'of', 'and', 'nowhere') GROUP BY word")
def stored_frequencies(spark, sf):
    return _index(spark, sf).frequency(["the", "rewritten", "of", "and", "nowhere"])


@query("""
WITH e AS (SELECT event_type AS k, user_id, count(*) FILTER (WHERE event_id % 3 = 0) AS e, count(*) FILTER (WHERE event_id % 3 <> 0) AS f FROM events GROUP BY 1, 2)
SELECT k, CAST(sum(least(e, f)) AS BIGINT) AS tp, CAST(sum(f - least(e, f)) AS BIGINT) AS fp, CAST(sum(e - least(e, f)) AS BIGINT) AS fn FROM e GROUP BY k
""")
def matched_points(spark, sf):
    """Events of a type are one group; an expected and a found one match if they are of one user."""
    events = _t(spark, sf, "events").select(F.col("event_type").alias("k"), "user_id", F.col("event_id").alias("at"), (F.col("event_id") % 3 == 0).alias("is_expected"))
    expected, found = events.where("is_expected").withColumnRenamed("at", "expected_at"), events.where("not is_expected").withColumnRenamed("at", "found_at")
    chosen = ev.assigned(expected.join(found, ["k", "user_id"]).select("k", "expected_at", "found_at"), ["k"])
    return ev.confusion(expected, found, chosen, ["k"])


@query("""
WITH RECURSIVE n AS (SELECT o_orderkey AS id, o_custkey AS f, o_orderkey AS s, o_orderkey + CAST(floor(o_totalprice / 20) AS BIGINT) AS e FROM orders),
c AS (SELECT a.id, b.id AS p, row_number() OVER (PARTITION BY a.id ORDER BY b.s DESC, b.e, b.id DESC) AS r FROM n a JOIN n b ON a.f = b.f AND b.s <= a.s AND b.e >= a.e AND b.id <> a.id),
t AS (SELECT n.id, n.f, n.s, n.e, c.p FROM n LEFT JOIN c ON c.id = n.id AND c.r = 1),
up AS (SELECT id, p AS above FROM t WHERE p IS NOT NULL UNION ALL SELECT up.id, t.p FROM up JOIN t ON t.id = up.above WHERE t.p IS NOT NULL),
down AS (SELECT above AS id, count(*) AS n FROM up GROUP BY 1), high AS (SELECT id, count(*) AS n FROM up GROUP BY 1)
SELECT f AS file_id, id, p AS parent_id, CAST(coalesce(high.n, 0) AS INTEGER) AS depth, row_number() OVER (PARTITION BY f ORDER BY s, e DESC, id) - 1 AS entry,
       row_number() OVER (PARTITION BY f ORDER BY s, e DESC, id) - 1 + coalesce(down.n, 0) AS exit
FROM t LEFT JOIN high USING (id) LEFT JOIN down USING (id)
""")
def span_hierarchy(spark, sf):
    """Orders as spans of their customers, as long as they are dear."""
    key, none = F.col("o_orderkey"), F.lit(None).cast("int")
    spans = _t(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"), key.alias("id"), none.cast("long").alias("parent_id"), key.alias("start_line"), none.alias("start_column"), (key + F.floor(F.col("o_totalprice") / 20)).alias("end_line"), none.alias("end_column"))
    return hi.tree(spans)


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'react-component' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '|react-context' ELSE '|' END AS tags FROM part
""")
def components_by_descendants(spark, sf):
    """A function per part with blocks five deep; in the innermost one a JSX element, an import of React or a call."""
    part = _t(spark, sf, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    k, size = F.col("k"), F.col("p_size")
    inner = F.when(size % 3 == 0, "jsx_element").when(size % 3 == 1, "import").otherwise("call")
    kind = F.when(k < 6, "function").when(k == 6, inner).otherwise("call")
    name = F.when(k == 0, "Panel").when(k < 6, "block").when(k == 6, F.when(size % 3 == 1, "react-dom").otherwise("div")).otherwise(F.when(size % 2 == 0, "createContext(null)").otherwise("other"))
    none, tags = F.lit(None).cast("int"), F.array().cast("array<string>")
    nodes = part.select(
        F.col("p_partkey").alias("file_id"), (F.col("p_partkey") * 8 + k).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.when(k == 7, 200).otherwise(1 + k).alias("start_line"), none.alias("start_column"),
        F.when(k == 7, 200).otherwise(100 - k).alias("end_line"), none.alias("end_column"), F.lit("typescript").alias("language"), kind.alias("node_type"), name.alias("name"), tags.alias("annotations"), tags.alias("tags"), F.lit("").alias("signature"),
    )
    found = hi.tagged_in_tree(nodes).where("id % 8 in (0, 7)").withColumn("at", F.col("id") % 8)
    of = lambda at: F.array_join(F.max(F.when(F.col("at") == at, F.col("tags"))), ",")
    return found.groupBy(F.col("file_id").alias("p_partkey")).agg(F.concat(of(0), F.lit("|"), of(7)).alias("tags"))


@query("""
WITH c AS (SELECT event_id, event_id % 8 AS k, lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS n, user_id % 50 AS f FROM events),
e AS (
  SELECT event_id, f, 'dynamic' AS level, 'dynamic' AS call_type, NULL AS callee, 'getattr' AS call_name FROM c WHERE k = 0
  UNION ALL SELECT event_id, f, 'qualified name', 'static', 'c' || n, 'x' FROM c WHERE k = 1
  UNION ALL SELECT event_id, f, 'qualified name', 'static', 'v' || n, '*.visit' FROM c WHERE k = 2
  UNION ALL SELECT event_id, f, 'name', 'static', 'c' || n, 'Nation' || n FROM c WHERE k = 3
  UNION ALL SELECT event_id, f, 'name', 'static', a, 'new Atlas' FROM c, (VALUES ('a1'), ('a2')) o(a) WHERE k = 4
  UNION ALL SELECT event_id, f, 'external', 'external', NULL, 'numpy.array' FROM c WHERE k = 5
  UNION ALL SELECT event_id, f, 'external', 'external', NULL, 'org.n' || n || '.array' FROM c WHERE k = 6
  UNION ALL SELECT event_id, f, CASE f WHEN 7 THEN 'injected' ELSE 'unknown' END, CASE f WHEN 7 THEN 'injected' ELSE 'unknown' END, NULL, 'nowhere' FROM c WHERE k = 7)
SELECT event_id, level, call_type, callee, CASE WHEN f < 20 THEN CASE f WHEN 7 THEN 'wired' ELSE 'around' || f END END AS caller, call_name FROM e
""")
def resolved_levels(spark, sf):
    """Events as calls of eight kinds; every level finds some."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    n, none = F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.array().cast("array<string>")
    function = lambda df, ident, file, name, qualified, marks=none: df.select(ident.alias("id"), file.alias("file_id"), name.alias("name"), qualified.alias("qualified_name"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), marks.alias("annotations"))
    nations, away = _t(spark, sf, "nation"), F.lit("elsewhere")
    files = spark.range(20)
    functions = (
        function(nations, text("c", n), away, text("Nation", n), text("geo.Nation", n))
        .union(function(nations, text("v", n), away, F.lit("visit"), text("geo.N", n, ".visit")))
        .union(function(spark.range(1, 3), text("a", F.col("id")), away, F.lit("Atlas"), text("geo.Atlas", F.col("id"))))
        .union(function(files, F.when(F.col("id") == 7, "wired").otherwise(text("around", F.col("id"))), F.col("id").cast("string"), text("around", F.col("id")), F.lit(None).cast("string"), F.when(F.col("id") == 7, F.array(F.lit("@Autowired"))).otherwise(none)))
    )
    deps = nations.select(F.col("n_nationkey").cast("long").alias("number"), F.lit(None).cast("string").alias("group_name"), text("org.n", n).alias("artifact_name"))
    imports = files.sparkSession.range(50).crossJoin(F.broadcast(nations)).select(F.col("id").cast("string").alias("file_id"), text("org.n", n, ".pkg.Obj", n).alias("name"), F.col("n_nationkey").cast("long").alias("number"))
    kind, own = F.col("event_id") % 8, F.lpad((F.col("user_id") % 25).cast("string"), 2, "0")
    pick = lambda *values: F.coalesce(*(F.when(kind == k, v) for k, v in enumerate(values) if v is not None), F.lit(None).cast("string"))
    calls = _t(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), (F.col("user_id") % 50).cast("string").alias("file_id"), F.lit(5).alias("start_line"),
        pick(F.lit("getattr"), F.lit("x"), F.lit("*.visit"), text("Nation", own), F.lit("new Atlas"), F.lit("*.array"), F.lit("*.array"), F.lit("nowhere")).alias("name"),
        pick(None, text("geo.Nation", own), text("n", own, ".visit"), None, None, F.lit("numpy.array"), text("obj", own, ".array")).alias("qualified_name"), F.lit("python").alias("language"),
    )
    found = levels.resolved(calls, functions, imports, deps)
    return found.select(F.col("id").cast("long").alias("event_id"), "level", "call_type", F.col("callee_node_id").alias("callee"), F.col("caller_node_id").alias("caller"), "call_name")


@query("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '^/+|/+$', '', 'g') AS path FROM pages),
k AS (SELECT DISTINCT page_id, path, v FROM p, (VALUES (0), (1), (2), (3), (4)) k(v))
SELECT page_id, v, CASE WHEN v < 4 THEN page_id END AS file_id FROM k
""")
def aliased_imports(spark, sf):
    """A file per page, under src/ or web/, imported by alias, by whole path, by its ending, by a path of its own folder, and amiss."""
    from lithic.functions.text import url_path

    page, key = F.col("page_id"), F.col("page_id").cast("string")
    pages = _t(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    ending = F.get(F.array(*(F.lit(e) for e in (".ts", ".vue", "/index.tsx", ".cjs"))), page % 4)
    stem = F.concat_ws("/", "path", F.concat(F.lit("p"), key))
    root = F.when(page % 2 == 0, "src/").otherwise("web/")
    files = pages.select(F.concat(root, stem, ending).alias("path"), page.alias("file_id"))
    names = F.array(F.concat(F.lit("@/"), stem), F.concat(root, stem, ending), F.concat(F.lit("~/p"), key, ending), F.concat(F.lit("./../p"), key), F.concat(F.lit("@src/none/p"), key, F.lit("x")))
    imports = pages.select("page_id", F.posexplode(names).alias("v", "name"))
    return mt.resolved_aliases(imports, files, "name").select("page_id", "v", F.col("imported_file_id").alias("file_id"))


@query("""
SELECT CASE WHEN lang = 'de' AND doc_id % 20 = 3 THEN 'v1-retry-de new ' || doc_id ELSE 'v1 ' || doc_id END AS title, lang AS category, doc_id AS id, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS attempts, 'success' AS status
FROM documents
""")
def category_retry(spark, sf):
    """Documents as files with a point each; German failed in the first version and one file in twenty has changed when it is analysed again."""
    docs = _t(spark, sf, "documents").select("doc_id", "lang", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("content_hash"))
    made = lambda df, label: df.select(F.lit("").alias("version"), F.col("lang").alias("category"), F.col("doc_id").alias("id"), F.concat(F.lit(label), F.col("doc_id").cast("string")).alias("title"), F.array("path").alias("files"))
    versions = Versions(spark, scratch(spark))
    versions.create("v1", datetime(2024, 1, 1))
    versions.complete("v1", made(docs, "v1 "), docs, datetime(2024, 1, 2))
    versions.mark("v1", "de", "failed")
    now = docs.withColumn("content_hash", F.when(F.col("doc_id") % 20 == 3, F.concat("content_hash", F.lit("!"))).otherwise(F.col("content_hash")))
    done = versions.retry("de", now, lambda asked: made(asked.where("lang = 'de'"), "v1-retry-de new "), datetime(2024, 1, 3))
    agents = versions.records().where(F.col("version") == done["version"]).select(F.explode("agent_status").alias("category", "s"))
    return versions.points(done["version"]).join(agents, "category").select("title", "category", "id", "s.attempts", "s.status")


@query("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '^/+|/+$', '', 'g') || '/P' || page_id AS path FROM pages),
x AS (SELECT path, string_split(path, '/') AS s FROM p),
t AS (SELECT array_to_string(s[1:n], '/') AS path, array_to_string(s[1:n - 1], '/') AS parent, s[n] AS name, max(n < len(s)) AS is_folder, count(*) AS n_files FROM (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM x) GROUP BY 1, 2, 3)
SELECT parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY is_folder DESC, lower(name), name) AS INTEGER) AS at, path, name, is_folder, n_files FROM t
""")
def folder_listing(spark, sf):
    from lithic.functions.text import url_path

    files = _t(spark, sf, "pages").select(F.concat(url_path(F.col("url")), F.lit("/P"), F.col("page_id").cast("string")).alias("path"))
    return gr.listing(gr.folder_tree(files, "path"))


@query("""
WITH r AS (SELECT event_type AS category, value / 100 AS f1, value / 200 AS precision, value / 300 AS recall, value / 400 AS confidence, event_id % 5 AS extracted, event_id % 3 AS expected FROM events),
c AS (SELECT category, avg(f1) AS f1, avg(precision) AS precision, avg(recall) AS recall, avg(confidence) AS confidence, CAST(sum(extracted) AS BIGINT) AS extracted, CAST(sum(expected) AS BIGINT) AS expected, count(*) AS cases FROM r GROUP BY 1)
SELECT category, round(f1, 4) AS f1, round(precision, 4) AS precision, round(recall, 4) AS recall, round(confidence, 4) AS confidence, extracted, expected, cases FROM c
UNION ALL SELECT NULL, round(avg(f1), 4), NULL, NULL, NULL, CAST(sum(extracted) AS BIGINT), CAST(sum(expected) AS BIGINT), CAST(sum(cases) AS BIGINT) FROM c
""")
def summary_by_category(spark, sf):
    e = _t(spark, sf, "events")
    part = lambda n, name: (F.col("value") / n).alias(name)
    return ev.category_summary(e.select(F.col("event_type").alias("category"), part(100, "f1"), part(200, "precision"), part(300, "recall"), part(400, "confidence"), (F.col("event_id") % 5).alias("extracted"), (F.col("event_id") % 3).alias("expected")))
