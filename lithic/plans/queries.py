"""The engine's operators applied to the driver's tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.functions import text as tx
from lithic.functions import vectors as vc
from lithic.operators import evaluation as ev
from lithic.operators import frameworks as fw
from lithic.operators import graphs as gr
from lithic.operators import matching as mt
from lithic.operators import search as se
from lithic.operators import statistics as st
from lithic.operators import tables as tb
from lithic.sources import scan
from lithic.streaming import progress as pg

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with SQL for the same rows (None: not expressible)."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_distribution(spark, sf):
    return st.distribution(_t(spark, sf, "documents"), "lang")


@query("""
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT coalesce(sum(n_chars), 0) FROM documents) AS chars,
       (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS edges, (SELECT count(DISTINCT event_type) FROM events) AS event_types,
       (SELECT round(sum(o_totalprice), 2) FROM orders) AS total_price
""")
def repo_stats(spark, sf):
    docs = _t(spark, sf, "documents").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    orders = _t(spark, sf, "orders").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total_price"))
    edges, events = _t(spark, sf, "lineitem").agg(F.count("*").alias("edges")), _t(spark, sf, "events").agg(F.count_distinct("event_type").alias("event_types"))
    return st.side_by_side(docs, orders, edges, events)


@query("SELECT count(*) FILTER (WHERE value >= 80) AS high, count(*) FILTER (WHERE value >= 50 AND value < 80) AS medium, count(*) FILTER (WHERE value < 50) AS low FROM events")
def confidence_buckets(spark, sf):
    return st.buckets(_t(spark, sf, "events"), "value", 50.0, 80.0)


@query("SELECT c.category, coalesce(n, 0) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('refund')) c(category) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e ON e.event_type = c.category")
def category_counts(spark, sf):
    return st.by_category(_t(spark, sf, "events").withColumnRenamed("event_type", "category"), ("click", "error", "purchase", "refund"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ar%' ORDER BY p_name, p_partkey LIMIT 20")
def ilike_search(spark, sf):
    return se.named(_t(spark, sf, "part"), "p_name", "AR", 20, "p_partkey").select("p_partkey", "p_name")


@query("SELECT p_type, p_brand, count(*) AS n FROM part WHERE p_type ILIKE 's%' GROUP BY 1, 2 ORDER BY n DESC, p_type, p_brand LIMIT 15")
def suggest(spark, sf):
    return se.suggestions(_t(spark, sf, "part"), "p_type", "p_brand", "S", 15)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def paginate(spark, sf):
    order = tb.sort_columns({"date": "o_orderdate", "price": "o_totalprice"}, None, True, "o_orderkey")
    return tb.page(_t(spark, sf, "orders"), order, 3, 25).select("o_orderkey", "o_orderdate")


@query("SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def filtered_page_count(spark, sf):
    rows = tb.where_equal(_t(spark, sf, "orders"), {"o_orderstatus": "F", "o_custkey": None})
    return tb.page_count(tb.where_like(rows, "o_orderpriority", "1", prefix=True), 20)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf):
    return tb.latest_per_key(_t(spark, sf, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def argmax_dedup(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("h", tx.content_hash(F.col("text")))
    return tb.one_per_key(docs, ["h"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "n_chars")


@query("""
SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS size_bytes,
       length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS line_count
FROM documents WHERE strlen(text) <= 10485760
  AND length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END <= 10000
""")
def content_hash_profile(spark, sf):
    files = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return scan.profiled(files).select("doc_id", "content_hash", F.col("size_bytes").cast("long").alias("size_bytes"), F.col("line_count").cast("long").alias("line_count"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def hash_duplicates(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("content_hash", tx.content_hash(F.col("text")))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def _snapshots(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("digest"))
    edited = F.when(F.col("doc_id") % 10 == 1, F.concat("digest", F.lit("!"))).otherwise(F.col("digest"))
    before = docs.where("doc_id % 10 <> 0").select("doc_id", edited.alias("digest"))
    return docs.where("doc_id % 10 <> 2"), before


_DIFF = """
WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents), now AS (SELECT * FROM d WHERE doc_id % 10 <> 2),
before AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN digest || '!' ELSE digest END AS digest FROM d WHERE doc_id % 10 <> 0),
diff AS (SELECT coalesce(now.doc_id, before.doc_id) AS doc_id, before.digest AS old, now.digest AS new,
  CASE WHEN before.digest IS NULL THEN 'added' WHEN now.digest IS NULL THEN 'deleted' WHEN now.digest <> before.digest THEN 'modified' END AS change
  FROM now FULL JOIN before ON now.doc_id = before.doc_id)
"""


@query(_DIFF + "SELECT doc_id, change, old, new FROM diff WHERE change IS NOT NULL")
def snapshot_diff(spark, sf):
    return gr.changes(*_snapshots(spark, sf), "doc_id", "digest")


@query(_DIFF + """
, c AS (SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'deleted') AS deleted FROM diff),
t AS (SELECT count(*) AS total FROM now)
SELECT added, modified, deleted, total, added + modified + deleted AS affected, total - added - modified AS skipped,
       (added + modified + deleted) / CAST(greatest(total, 1) AS DOUBLE) > 0.3 AS "full" FROM c, t
""")
def diff_summary(spark, sf):
    now, before = _snapshots(spark, sf)
    return gr.change_summary(gr.changes(now, before, "doc_id", "digest"), now)


@query("""
WITH spans AS (SELECT o_custkey AS k, o_orderkey AS span, epoch(o_orderdate) // 86400 AS s, epoch(o_orderdate) // 86400 + 30 + o_orderkey % 60 AS e FROM orders),
points AS (SELECT o_custkey AS k, o_orderkey AS point, epoch(o_orderdate) // 86400 + 15 AS at FROM orders)
SELECT point, span FROM (SELECT p.point, x.span, row_number() OVER (PARTITION BY p.point ORDER BY x.e NULLS LAST, x.s, x.span) AS r
  FROM points p LEFT JOIN spans x ON p.k = x.k AND x.s <= p.at AND p.at <= x.e) WHERE r = 1
""")
def enclosing_interval(spark, sf):
    day = F.unix_date(F.to_date("o_orderdate"))
    orders = _t(spark, sf, "orders")
    spans = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("span"), day.alias("s"), (day + 30 + F.col("o_orderkey") % 60).alias("e"))
    points = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("point"), (day + 15).alias("at"))
    return mt.innermost(points, spans, ["point"], "k", "at", "s", "e", "span").select("point", "span")


@query("""
WITH c AS (
  SELECT l_orderkey, l_linenumber, 0 AS priority, 'supplier' AS kind FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 5000
  UNION ALL SELECT l_orderkey, l_linenumber, 1, 'part' FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 25
  UNION ALL SELECT l_orderkey, l_linenumber, 2, 'order' FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'
  UNION ALL SELECT l_orderkey, l_linenumber, 3, 'unknown' FROM lineitem)
SELECT kind, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY priority) AS r FROM c) WHERE r = 1 GROUP BY kind
""")
def fallback_join(spark, sf):
    lines = _t(spark, sf, "lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    level = lambda df, n, kind: df.select("id", F.lit(n).alias("priority"), F.lit(kind).alias("kind"))
    suppliers, parts, orders = _t(spark, sf, "supplier").where("s_acctbal > 5000"), _t(spark, sf, "part").where("p_size > 25"), _t(spark, sf, "orders").where("o_orderstatus = 'F'")
    candidates = level(lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")), 0, "supplier").union(level(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), 1, "part"))
    candidates = candidates.union(level(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), 2, "order")).union(level(lines, 3, "unknown"))
    return mt.by_priority(candidates, "id").groupBy("kind").agg(F.count("*").alias("n"))


_PATHS = """
WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/') AS path FROM pages),
parts AS (SELECT page_id, path, string_split(path, '/') AS parts FROM p),
prefixes AS (SELECT page_id, path, list_aggregate(parts[1:i], 'string_agg', '/') AS prefix, i FROM parts, generate_series(1, 20) g(i) WHERE i <= len(parts))
"""


@query(_PATHS + "SELECT prefix AS path, max(i) AS depth, max(CASE WHEN prefix <> path THEN 1 ELSE 0 END) = 1 AS is_folder, count(*) AS n_files FROM prefixes GROUP BY prefix")
def path_prefixes(spark, sf):
    pages = _t(spark, sf, "pages").select(tx.url_path(F.col("url")).alias("whole"))
    return gr.folder_tree(pages, "whole").withColumn("depth", F.col("depth").cast("long"))


@query(_PATHS + "SELECT page_id, path FROM p")
def url_normalise(spark, sf):
    return _t(spark, sf, "pages").select("page_id", tx.url_path(F.col("url")).alias("path"))


_LINKS = _PATHS + """
, links AS (SELECT page_id, trim(unnest(regexp_extract_all(html, 'href="(/[^"#?]*)', 1)), '/') AS target FROM pages),
known AS (SELECT path, min(page_id) AS target_id FROM p GROUP BY path),
resolved AS (SELECT l.page_id, l.target, max(k.path) AS path FROM (SELECT DISTINCT * FROM links) l LEFT JOIN (SELECT DISTINCT path, prefix FROM prefixes) k ON k.prefix = l.target GROUP BY 1, 2)
"""


def _links(spark, sf):
    pages = _t(spark, sf, "pages").withColumn("path", tx.url_path(F.col("url")))
    targets = F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)'), F.lit(1))
    links = pages.select("page_id", F.explode(targets).alias("t")).select("page_id", F.btrim("t", F.lit("/")).alias("target"))
    # one path per prefix before the join: a link to a folder would else meet every path below it
    last = pages.select("path", F.explode(tx.path_prefixes(F.col("path"))).alias("target")).groupBy("target").agg(F.max("path").alias("path"))
    return links, links.distinct().join(last, "target", "left").select("page_id", "target", "path")


@query(_LINKS + "SELECT page_id, target, path, CASE WHEN path IS NULL THEN 'external' WHEN starts_with(target, '.') THEN 'relative' ELSE 'absolute' END AS import_type FROM resolved")
def import_edges(spark, sf):
    resolved = _links(spark, sf)[1]
    return resolved.withColumn("import_type", mt.import_kind(F.col("target"), F.col("path"))).select("page_id", "target", "path", "import_type")


@query(_LINKS + "SELECT count(*) AS total, count(path) AS internal, count(*) - count(path) AS external FROM resolved")
def import_stats(spark, sf):
    return _links(spark, sf)[1].agg(F.count("*").alias("total"), F.count("path").alias("internal"), F.count_if(F.col("path").isNull()).alias("external"))


@query(_LINKS + "SELECT target, count(*) AS n FROM links GROUP BY target ORDER BY n DESC, target LIMIT 10")
def hot_nodes(spark, sf):
    return st.distribution(_links(spark, sf)[0], "target").limit(10)


@query("SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def edge_multiplicity(spark, sf):
    return st.edge_counts(_t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")), "a", "b")


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT a AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT b, 0, 1 FROM e) GROUP BY node
""")
def degree(spark, sf):
    return st.degrees(_t(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


_GRAPH = "e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)"


def _graph(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()


@query(f"""
WITH {_GRAPH},
one AS (SELECT a AS start, b AS node FROM e WHERE a <> b),
two AS (SELECT w.start, w.node AS via, e.b AS node FROM one w JOIN e ON e.a = w.node WHERE e.b NOT IN (w.start, w.node)),
three AS (SELECT w.start, e.b AS node FROM two w JOIN e ON e.a = w.node WHERE e.b NOT IN (w.start, w.via, w.node))
SELECT start, node, 1 AS depth, count(*) AS n FROM one GROUP BY 1, 2
UNION ALL SELECT start, node, 2, count(*) FROM two GROUP BY 1, 2
UNION ALL SELECT start, node, 3, count(*) FROM three GROUP BY 1, 2
""")
def call_chain(spark, sf):
    edges = _graph(spark, sf)
    starts = edges.select(F.col("a").alias("node")).distinct()
    return gr.path_counts(edges, starts, 3)


@query(f"""
WITH RECURSIVE {_GRAPH}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (
  SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT s.b, w.depth + 1 FROM walk w JOIN s ON s.a = w.node WHERE w.depth < 3)
SELECT node, min(depth) AS depth FROM walk GROUP BY node
""")
def impact_bfs(spark, sf):
    return gr.reached(_graph(spark, sf), spark.createDataFrame([(1,)], "node long"), 3)


@query(f"WITH {_GRAPH}, g AS (SELECT p_partkey FROM part WHERE p_size = 7) SELECT a, b FROM e WHERE a NOT IN (SELECT p_partkey FROM g) AND b NOT IN (SELECT p_partkey FROM g)")
def or_endpoint_delete(spark, sf):
    return tb.without_touched(_graph(spark, sf), _t(spark, sf, "part").where("p_size = 7"), ("a", "b"), "p_partkey")


@query(f"WITH {_GRAPH}, g AS (SELECT p_partkey FROM part WHERE p_size = 7) SELECT a, b FROM e WHERE a IN (SELECT p_partkey FROM g) OR b IN (SELECT p_partkey FROM g)")
def touching_edges(spark, sf):
    return gr.touching(_graph(spark, sf), _t(spark, sf, "part").where("p_size = 7"), "p_partkey")


@query(f"WITH {_GRAPH} SELECT a, b, 'out' AS direction FROM e WHERE a BETWEEN 1 AND 3 UNION SELECT a, b, 'in' FROM e WHERE b BETWEEN 1 AND 3")
def ego_network(spark, sf):
    return gr.neighbours(_graph(spark, sf), spark.range(1, 4).select(F.col("id").alias("node")))


@query("""
SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def upsert_latest(spark, sf):
    events = _t(spark, sf, "events").withColumn("at", F.struct("ts", "event_id")).select("user_id", "event_type", "value", "at")
    even = F.hash("at") % 2 == 0
    first = tb.latest_per_key(events.where(even), ["user_id", "event_type"], "at", "value")
    later = tb.one_per_key(events, ["user_id", "event_type"], [F.desc("at")])
    return tb.upserted(first, later, ["user_id", "event_type"], "at").select("user_id", "event_type", "value")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def manifest_like_json(spark, sf):
    parsed = _t(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return parsed.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '<(?:\\w+:)?(\\w+)>', '{\\1}', 'g'), '/[0-9]+', '/{n}', 'g') AS route FROM pages")
def route_normalise(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.regexp_replace(tx.route_pattern(F.col("url")), "/[0-9]+", "/{n}").alias("route"))


@query("""
SELECT page_id, CAST(least(round(0.1 * (CAST(contains(html, '<script') AS INT) + CAST(contains(html, '<table') AS INT) + CAST(contains(html, '<nav') AS INT)
  + CAST(contains(html, 'href=') AS INT) + CAST(contains(html, '<footer') AS INT)), 6), 0.3) AS DOUBLE) AS score FROM pages
""")
def capped_score(spark, sf):
    hits = sum((F.col("html").contains(x).cast("int") for x in ("<script", "<table", "<nav", "href=", "<footer")), F.lit(0))
    return _t(spark, sf, "pages").select("page_id", st.capped(F.round(hits * 0.1, 6), 0.3).alias("score"))


@query("""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'brass') THEN 'alloy'
  WHEN contains(lower(p_name), 'green') THEN 'green' ELSE 'generic' END AS kind FROM part) GROUP BY kind
""")
def classify_first_match(spark, sf):
    kind = tx.first_match(F.concat_ws(" ", "p_type"), {"steel": "metal", "brass": "alloy"}, "")
    second = tx.first_match(F.col("p_name"), {"green": "green"}, "generic")
    return _t(spark, sf, "part").select(F.when(kind != "", kind).otherwise(second).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_WORDS = "SELECT DISTINCT item_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS word FROM benchmark"


@query(f"WITH p AS ({_WORDS}) SELECT id, count(*) AS hits FROM p WHERE word IN ('the', 'of', 'that') GROUP BY id ORDER BY hits DESC, id LIMIT 20")
def fulltext_topk(spark, sf):
    index = se.postings(_t(spark, sf, "benchmark"), "item_id", ["text"])
    return se.full_text(index, ["the", "of", "That"]).orderBy(F.desc("hits"), "id").limit(20)


@query(f"WITH p AS ({_WORDS}) SELECT id, count(*) AS hits FROM p WHERE word IN ('the', 'of') GROUP BY id HAVING count(*) = 2")
def fulltext_all_words(spark, sf):
    return se.full_text(se.postings(_t(spark, sf, "benchmark"), "item_id", ["text"]), ["the", "of"], every=True)


@query("""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.v, v.v), 6) AS score FROM v q JOIN v ON q.id <> v.id WHERE q.id % 50 = 0)
SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 5
""")
def vector_topk(spark, sf):
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return se.nearest(vectors.where("id % 50 = 0"), vectors, 5)


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.label = b.label AND b.vec_id <> a.vec_id)
SELECT vec_id, count(*) AS pairs, count(*) FILTER (WHERE c >= 0.85) AS matches, round(max(c), 6) AS closest FROM p GROUP BY vec_id
""")
def semantic_match(spark, sf):
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    found = se.alike_counts(v, v, ev.COSINE)
    return found.select(F.col("id").alias("vec_id"), "pairs", "matches", F.round("closest", 6).alias("closest"))


@query("""
WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS w FROM benchmark),
j AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM w a JOIN w b ON b.item_id = a.item_id + 1)
SELECT a, b, round(CASE WHEN na + nb - i = 0 THEN 1.0 ELSE i / CAST(na + nb - i AS DOUBLE) END, 6) AS iou FROM j
""")
def line_iou(spark, sf):
    w = _t(spark, sf, "benchmark").select("item_id", F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_]+")), lambda x: x != "").alias("w"))
    pairs = w.select(F.col("item_id").alias("a"), F.col("w").alias("wa")).join(w.select(F.col("item_id").alias("b"), F.col("w").alias("wb")), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(vc.overlap(F.col("wa"), F.col("wb")), 6).alias("iou"))


_COUNTS = """
c AS (SELECT lang, source, CAST(quality = 1 AND n_chars > 800 AS INT) AS tp, CAST(quality = 0 AND n_chars > 800 AS INT) AS fp, CAST(quality = 1 AND n_chars <= 800 AS INT) AS fn
      FROM documents JOIN labels USING (doc_id))
"""
_RATE = """
CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1
"""
_SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn"


def _counts(spark, sf):
    joined = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    good, found = F.col("quality") == 1, F.col("n_chars") > 800
    return joined.select("lang", "source", (good & found).cast("int").alias("tp"), (~good & found).cast("int").alias("fp"), (good & ~found).cast("int").alias("fn"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1") if c in df.columns})


@query(f"WITH {_COUNTS}, s AS (SELECT lang, source, {_SUMS} FROM c GROUP BY 1, 2), r AS (SELECT *, {_RATE} FROM s) SELECT lang, source, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def prf_by_group(spark, sf):
    return _rounded(st.scores(_counts(spark, sf), ["lang", "source"]))


@query(f"""
WITH {_COUNTS}, s AS (SELECT CASE WHEN grouping(lang) = 1 AND grouping(source) = 1 THEN 'all' WHEN grouping(lang) = 1 THEN 'source' WHEN grouping(source) = 1 THEN 'lang' ELSE 'lang and source' END AS level,
  lang, source, {_SUMS} FROM c GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())), r AS (SELECT *, {_RATE} FROM s)
SELECT level, lang, source, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r
""")
def rollup_report(spark, sf):
    return _rounded(st.rolled_up(_counts(spark, sf), "lang", "source"))


@query(f"""
WITH {_COUNTS}, s AS (SELECT lang, source, {_SUMS} FROM c GROUP BY 1, 2), r AS (SELECT *, {_RATE} FROM s)
SELECT lang, round(CASE WHEN sum(tp + fp) > 0 THEN sum(f1 * (tp + fp)) / sum(tp + fp) ELSE avg(f1) END, 6) AS f1 FROM r GROUP BY lang
""")
def weighted_f1(spark, sf):
    scored = st.scores(_counts(spark, sf), ["lang", "source"]).withColumn("w", F.col("tp") + F.col("fp"))
    return _rounded(st.weighted_mean(scored, "f1", "w", ["lang"]))


@query(f"WITH {_COUNTS}, s AS (SELECT lang, {_SUMS} FROM c GROUP BY 1), r AS (SELECT *, {_RATE} FROM s) SELECT round(stddev_pop(f1), 4) AS std, round(min(f1), 4) AS least, round(max(f1), 4) AS greatest FROM r")
def cross_group_std(spark, sf):
    return st.spread(st.scores(_counts(spark, sf), ["lang"]), "f1")


_MONTHS = "m AS (SELECT o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) AS m, round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS v FROM orders GROUP BY 1, 2)"


@query(f"""
WITH {_MONTHS}, d AS (SELECT *, lag(v) OVER (PARTITION BY o_orderpriority ORDER BY m) AS before FROM m)
SELECT o_orderpriority, m, v, before, round(before - v, 6) AS "drop", CASE WHEN round(before - v, 6) >= 0.1 THEN 'critical' WHEN round(before - v, 6) >= 0.05 THEN 'warning' ELSE 'ok' END AS level FROM d
""")
def regression_detect(spark, sf):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("m")
    runs = _t(spark, sf, "orders").groupBy("o_orderpriority", month).agg(F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 6).alias("v"))
    return ev.regressions(runs, ["o_orderpriority"], "m", "v")


@query(f"""
WITH {_COUNTS}, s AS (SELECT lang, {_SUMS} FROM c GROUP BY 1), r AS (SELECT *, {_RATE} FROM s)
SELECT round(a.f1, 6) AS f1_a, round(b.f1, 6) AS f1_b, round(b.f1 - a.f1, 6) AS f1_diff, round(b.f1 - a.f1, 6) > 0 AS is_improvement FROM r a, r b WHERE a.lang = 'en' AND b.lang = 'de'
""")
def ab_comparison(spark, sf):
    scored = st.scores(_counts(spark, sf), ["lang"])
    out = ev.compared(scored.where("lang = 'en'"), scored.where("lang = 'de'"))
    return out.withColumns({"f1_a": F.round("f1_a", 6), "f1_b": F.round("f1_b", 6)})


@query("SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY event_type")
def cost_window(spark, sf):
    out = pg.costs(pg.recent(_t(spark, sf, "events"), "ts", "7 DAYS"), ["event_type"], "value")
    return out.withColumn("total", F.round("total", 4))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM b")
def progress_changes(spark, sf):
    return pg.changed(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_max(spark, sf):
    return pg.running_max(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", "best").select("event_id", "best")


@query("SELECT event_id, round(coalesce(sum(value) OVER w, 0), 4) AS spent, round(coalesce(sum(value) OVER w, 0) + value, 4) > 500 AS denied FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def budget_check(spark, sf):
    out = pg.over_budget(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 500.0)
    return out.select("event_id", F.round("spent", 4).alias("spent"), (F.round(F.col("spent") + F.col("value"), 4) > 500).alias("denied"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def bounded_log(spark, sf):
    return pg.newest(_t(spark, sf, "events"), ["ts", "event_id"], 100).select("event_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS r FROM conversations) WHERE r = 1")
def message_dedup(spark, sf):
    return pg.deduplicated(_t(spark, sf, "conversations"), ["role", "text"], ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query("SELECT conv_id, substr(sha256(string_agg(text, chr(10) ORDER BY turn)), 1, 32) AS fingerprint, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def fingerprint(spark, sf):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    out = _t(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"), F.sum(tx.estimated_tokens(F.col("text"))).alias("tokens"))
    return out.select("conv_id", tx.fingerprint(F.array_join("t", "\n")).alias("fingerprint"), "tokens")


@query("""
WITH c AS (SELECT doc_id, text, substr(text, 1, 400) AS c FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 400 OR NOT contains(c, chr(10)) THEN c ELSE substr(c, 1, length(c) - strpos(reverse(c), chr(10))) END AS cut FROM c
""")
def truncate_newline(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.truncated_at_line(F.col("text"), 400).alias("cut"))


@query("""
WITH k AS (SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS list FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id)
SELECT c_custkey, coalesce(list, '') AS list FROM customer LEFT JOIN k ON k.user_id = c_custkey
""")
def middleware_attach(spark, sf):
    events = _t(spark, sf, "events").where("event_type in ('signup', 'error')").withColumnRenamed("user_id", "c_custkey")
    out = tb.attached(_t(spark, sf, "customer"), events, "c_custkey", F.col("event_type"), F.struct("ts", "event_id"), "list")
    return out.select("c_custkey", F.array_join("list", ",").alias("list"))


@query("""
SELECT s_suppkey, list_aggregate(list_filter([CASE WHEN s_acctbal < 0 THEN 'negative balance' END, CASE WHEN s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) THEN 'nation unknown' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS errors FROM supplier
""")
def row_validation(spark, sf):
    nations = _t(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("__n"))
    joined = _t(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("__n"), "left")
    checked = tb.with_errors(joined, {"negative balance": F.col("s_acctbal") < 0, "nation unknown": F.col("__n").isNull()})
    return checked.select("s_suppkey", F.nullif(F.array_join("errors", ","), F.lit("")).alias("errors"))


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN o_custkey END AS o_custkey FROM orders")
def null_dangling(spark, sf):
    keep = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return tb.without_dangling(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", keep, "c_custkey")


@query("WITH k AS (SELECT source, max(doc_id) AS last FROM documents GROUP BY source ORDER BY last DESC, source DESC LIMIT 3) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM k)")
def newest_versions(spark, sf):
    return tb.newest_groups(_t(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@query("SELECT p_brand, list_aggregate(list_sort(list_distinct(list(p_type)))[1:3], 'string_agg', ';') AS items FROM part GROUP BY p_brand")
def top_per_group(spark, sf):
    return st.top_per_group(_t(spark, sf, "part"), "p_brand", "p_type", 3).withColumn("items", F.array_join("items", ";"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def remaining_work(spark, sf):
    progress = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return tb.remaining(_t(spark, sf, "customer").select("c_custkey"), progress, "c_custkey")


@query("SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS window_start FROM events) GROUP BY 1, 2")
def daily_costs(spark, sf):
    out = pg.windowed_costs(_t(spark, sf, "events"), "ts", "event_type", "value", "1 day", "1 day")
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_value, arg_max(event_type, (ts, event_id)) AS last_value, max(value) AS progress,
       array_to_string(list_sort(list_distinct(list(event_type))), ',') AS titles, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id
""")
def state_reducers(spark, sf):
    events = _t(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("value"), F.col("value").alias("progress"), F.col("event_type").alias("title"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    out = pg.reduced(events, "user_id", "at")
    return out.select("user_id", "first_value", "last_value", "progress", F.array_join("titles", ",").alias("titles"), (F.col("status") == "failed").alias("failed"))


@query("""
WITH t AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS tries, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'success' WHEN 'view' THEN NULL ELSE 'failed' END AS last_status FROM events GROUP BY user_id)
SELECT user_id, tries, last_status, CASE WHEN tries >= 3 THEN 'limit reached' WHEN last_status IS NULL THEN 'no history' WHEN last_status = 'success' THEN 'already done' ELSE 'accept' END AS decision FROM t
""")
def retry_decisions(spark, sf):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    status = F.when(last == "purchase", "success").when(last != "view", "failed")
    return pg.retry_decision(_t(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("tries"), status.alias("last_status")))


def _calls(spark, sf, speed, failed):
    """Events as calls per user, with time running 1 / speed times as fast, so that calls of a user compete."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 * speed
    return _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), seconds.alias("at"), failed.alias("failed"))


_CALLS = """
WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 * {} AS t, event_type <> 'purchase' AS failed,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
"""


@query(_CALLS.format("1e-5") + """
f AS (SELECT key, id, t, n, 4.0::DOUBLE AS tokens, true AS granted FROM e WHERE n = 1
  UNION ALL SELECT key, id, t, n, CASE WHEN gained >= 1 THEN gained - 1 ELSE gained END, gained >= 1
  FROM (SELECT e.key, e.id, e.t, e.n, least(5.0::DOUBLE, f.tokens + greatest(0.0::DOUBLE, e.t - f.t) * 3.0::DOUBLE) AS gained
    FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1))
SELECT key, id, t AS "at", granted, printf('%.3f', tokens) AS state FROM f
""")
def token_bucket(spark, sf):
    return pg.limited(_calls(spark, sf, 1e-5, F.lit(False)))


@query(_CALLS.format("1e-3") + """
f AS (SELECT key, id, t, n, 'closed' AS state, CAST(failed AS INTEGER) AS failures, 0.0::DOUBLE AS opened, true AS granted FROM e WHERE n = 1
  UNION ALL SELECT key, id, t, n, CASE WHEN shut THEN 'open' WHEN NOT failed THEN 'closed' WHEN was = 'open' OR failures >= 4 THEN 'open' ELSE 'closed' END,
    CASE WHEN shut THEN failures WHEN NOT failed THEN 0 ELSE failures + 1 END,
    CASE WHEN shut THEN opened WHEN failed AND (was = 'open' OR failures >= 4) THEN t ELSE 0 END, NOT shut
  FROM (SELECT e.key, e.id, e.t, e.n, e.failed, f.state AS was, f.failures, f.opened, f.state = 'open' AND e.t - f.opened < 30 AS shut
    FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1))
SELECT key, id, t AS "at", granted, state FROM f
""")
def circuit_breaker(spark, sf):
    return pg.broken(_calls(spark, sf, 1e-3, F.col("event_type") != "purchase"))


@query(None)
def title_likeness(spark, sf):
    w = _t(spark, sf, "benchmark").select("item_id", F.col("text").alias("t"))
    pairs = w.select(F.col("item_id").alias("a"), F.col("t").alias("ta")).join(w.select(F.col("item_id").alias("b"), F.col("t").alias("tb")), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(ev.title_ratio("ta", "tb"), 6).alias("ratio"))


@query("""
SELECT framework, CAST(least(round(n * 0.05, 6), 0.2) AS DOUBLE) AS confidence FROM (SELECT CASE WHEN lang = 'en' THEN 'python' WHEN lang = 'de' THEN 'java' WHEN lang = 'fr' THEN 'vue' END AS framework, count(*) AS n FROM documents GROUP BY 1) WHERE framework IS NOT NULL
""")
def frameworks_by_ending(spark, sf):
    ending = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".java").when(F.col("lang") == "fr", ".vue").otherwise(".none")
    files = _t(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), ending).alias("path"))
    return fw.by_ending(files).withColumn("confidence", F.round("confidence", 6))


@query("""
WITH n AS (SELECT n_nationkey AS id, n_regionkey AS f, n_nationkey AS s, n_nationkey + 3 * (25 - n_nationkey) AS e FROM nation),
c AS (SELECT a.id, b.id AS p, row_number() OVER (PARTITION BY a.id ORDER BY b.s DESC, b.e, b.id DESC) AS r FROM n a JOIN n b ON a.f = b.f AND b.s <= a.s AND b.e >= a.e AND b.id <> a.id)
SELECT n.id, c.p AS parent_id FROM n LEFT JOIN c ON c.id = n.id AND c.r = 1
""")
def parents_by_span(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("file_id"), F.col("n_nationkey").alias("start_line"), (F.col("n_nationkey") + 3 * (25 - F.col("n_nationkey"))).alias("end_line"))
    return mt.parents_by_span(n)


@query("SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_by_keys(spark, sf):
    customers = _t(spark, sf, "customer")
    return tb.without_keys(customers, customers.where("c_nationkey = 3"), "c_custkey", "c_custkey").select("c_custkey", "c_acctbal", "c_nationkey")


@query("SELECT c_custkey, CASE WHEN n > 12 THEN 'busy' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def keyed_update(spark, sf):
    busy = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    changes = busy.select("c_custkey", F.when(F.col("n") > 12, "busy").alias("c_mktsegment"), F.lit("x").alias("c_name"))
    return tb.updated(_t(spark, sf, "customer"), changes, ["c_custkey"], ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


FLAGSHIP = prf_by_group
