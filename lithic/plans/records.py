"""Queries of small operations on versions, metrics, imports and evaluation cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import records as rc
from lithic.plans.queries import _t, query


@query("SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY 1, 2")
def merged_metrics(spark, sf):
    merged = rc.merged_metrics(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax"], ["l_linenumber"])
    return merged.withColumns({c: F.round(c, 6) for c in ("l_discount", "l_tax")})


@query("""
SELECT o_orderpriority, round(count(*) / CAST(greatest(count(DISTINCT o_custkey), 1) AS DOUBLE), 1) AS ratio FROM orders GROUP BY 1
""")
def deps_per_file(spark, sf):
    counted = _t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("m"))
    return counted.select("o_orderpriority", rc.per_file(F.col("n"), F.col("m")).alias("ratio"))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def shared_keys(spark, sf):
    rows = _t(spark, sf, "lineitem")
    return rc.shared_keys(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), "l_partkey")


@query("SELECT page_id FROM pages WHERE regexp_extract(html, '<h1>([^<]*)</h1>', 1) = ''")
def missing_expansion(spark, sf):
    return rc.lacking(_t(spark, sf, "pages"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).select("page_id")


@query("SELECT o_orderkey, coalesce(o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey), false) AS is_current FROM orders")
def current_versions(spark, sf):
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return rc.marked_current(orders, newest, "o_custkey", "o_orderkey").select("o_orderkey", "is_current")


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN json_extract_string(props, '$.k') END AS k FROM events
""")
def status_maps(spark, sf):
    kind = F.col("event_type")
    whole = F.concat(F.lit('{"stage": '), F.col("props"), F.lit("}"))
    text = F.when(kind.isin("click", "view"), whole).when(kind == "error", "[1, 2]").when(kind == "signup", "no json")
    return _t(spark, sf, "events").select("event_id", rc.status_map(text)["stage"]["k"].alias("k"))


@query("""
SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1), lambda x: starts_with(x, './') OR starts_with(x, '../') OR starts_with(x, '@/') OR starts_with(x, '~/'))) AS INTEGER) AS n FROM pages
""")
def internal_imports(spark, sf):
    links = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))
    return _t(spark, sf, "pages").select("page_id", F.size(F.filter(links, rc.is_internal)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src0'")
def without_version(spark, sf):
    return rc.without_version(_t(spark, sf, "documents"), "source", "src0").select("doc_id", "source")


@query("""
WITH f AS (SELECT conv_id, count(*) AS cases, min(role) AS first, max(role) AS last FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_filter([CASE WHEN first IS NULL THEN 'missing language' END, CASE WHEN first <> last THEN 'wrong language' END,
  CASE WHEN cases <> 8 THEN 'number of cases' END], lambda x: x IS NOT NULL), ',') AS problems FROM f
""")
def case_problems(spark, sf):
    files = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("cases"), F.min("role").alias("first"), F.max("role").alias("last"))
    return rc.case_problems(files, F.col("first"), F.col("last"), F.col("cases")).select("conv_id", F.array_join("problems", ",").alias("problems"))


@query("SELECT p_partkey, max(p_partkey) OVER (PARTITION BY p_name) AS target_id FROM part")
def qualified_calls(spark, sf):
    part = _t(spark, sf, "part")
    functions = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("qualified_name"), F.col("p_partkey").alias("at"))
    calls = part.select("p_partkey", F.col("p_name").alias("qualified_name"))
    return rc.by_qualified_name(calls, functions, "at").select("p_partkey", "target_id")
