"""Queries of runs, dependencies of calls and imports, search pages, and records that models wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.functions import jsons
from lithic.operators import dependencies as dp
from lithic.operators import runs as rn
from lithic.operators import search as se
from lithic.operators import statistics as st
from lithic.plans.queries import _t, query
from lithic.streaming import progress as pg

_NOW = 1_704_931_200.0


def _records(spark, sf):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _t(spark, sf, "events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("category"), seconds.alias("at"), "event_id")


_ALIVE = """
WITH r AS (SELECT user_id AS repo, event_type AS category, epoch_us(ts) / 1e6 AS t, event_id FROM events),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY repo ORDER BY t) AS gap FROM r WHERE event_id % 2 = 0 AND t <= 1704931200),
s AS (SELECT *, max(t) FILTER (WHERE gap IS NULL OR gap > 86400) OVER (PARTITION BY repo) AS start, max(t) OVER (PARTITION BY repo) AS last FROM g),
alive AS (SELECT * FROM s WHERE t >= start AND 1704931200 <= last + 86400)
"""


@query(_ALIVE + """
, f AS (SELECT repo, category, max((t, event_id)) AS m FROM alive GROUP BY 1, 2),
c AS (SELECT repo, category, max((t, event_id)) AS gone FROM r WHERE event_id % 5 = 1 AND t <= 1704931200 GROUP BY 1, 2)
SELECT f.repo, f.category, m[2] AS event_id FROM f LEFT JOIN c USING (repo, category) WHERE gone IS NULL OR gone <= m
""")
def failed_nodes(spark, sf):
    known = _records(spark, sf).where(F.col("at") <= _NOW)
    failed = rn.failed_nodes(known.where("event_id % 2 = 0"), known.where("event_id % 5 = 1"), "repo", "category", "at", "event_id", F.lit(_NOW))
    return failed.select("repo", "category", "event_id")


@query(_ALIVE + "SELECT repo, category, count(*) AS tries, count(*) < 3 AS can_retry FROM alive GROUP BY 1, 2")
def retry_counts(spark, sf):
    tries = _records(spark, sf).where("event_id % 2 = 0").where(F.col("at") <= _NOW)
    return rn.retries(tries, "repo", "category", "at", F.lit(_NOW))


@query("""
WITH e AS (SELECT event_id, ['PENDING', 'SCANNING', 'PARSING', 'ANALYZING_STRUCTURES', 'ANALYZING_MODULES', 'STORING', 'ODD'][event_id % 7 + 1] AS status FROM events)
SELECT event_id, CASE status WHEN 'SCANNING' THEN 'scan' WHEN 'PARSING' THEN 'ast' WHEN 'ANALYZING_STRUCTURES' THEN 'frameworks' WHEN 'ANALYZING_MODULES' THEN 'ai'
  WHEN 'STORING' THEN 'store' END AS step FROM e
""")
def resume_points(spark, sf):
    listed = F.array(*map(F.lit, ("PENDING", "SCANNING", "PARSING", "ANALYZING_STRUCTURES", "ANALYZING_MODULES", "STORING", "ODD")))
    status = F.get(listed, (F.col("event_id") % 7).cast("int"))
    return _t(spark, sf, "events").select("event_id", rn.resume_step(status).alias("step"))


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS version, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'CANCELLED' END AS how FROM orders)
SELECT o_orderkey, CASE WHEN how IS NOT NULL AND version IS NOT NULL THEN how ELSE 'SCANNING' END AS version_status,
  CASE WHEN how = 'FAILED' OR version IS NOT NULL THEN coalesce(how, 'ANALYZING') ELSE 'ANALYZING' END AS repo_status FROM r
""")
def ended_runs(spark, sf):
    version = F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("version_id")
    how = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "CANCELLED")
    runs = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", version, F.lit("SCANNING").alias("version_status"), F.lit("ANALYZING").alias("repo_status"))
    return rn.ended(runs, how).select("o_orderkey", "version_status", "repo_status")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' AND value > 60 THEN 'COMPLETED' WHEN event_type = 'error' AND value > 90 THEN 'FAILED' WHEN event_id % 3 = 0 THEN 'PARSING' ELSE 'SCANNING' END AS step,
    floor(value / 50) AS percent, event_id % 4 AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
z AS (SELECT user_id, min(n) AS stop FROM e WHERE step IN ('COMPLETED', 'FAILED') GROUP BY 1),
c AS (SELECT *, n = 1 OR step <> lag(step) OVER w OR percent <> lag(percent) OVER w AS changed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n)),
k AS (SELECT user_id, min(n) AS go FROM c WHERE changed AND total > 0 GROUP BY 1),
a AS (SELECT c.*, go FROM c LEFT JOIN z USING (user_id) LEFT JOIN k USING (user_id) WHERE stop IS NULL OR n <= stop)
SELECT event_id, 'progress' AS event FROM a WHERE changed AND n >= go
UNION ALL SELECT event_id, CASE step WHEN 'COMPLETED' THEN 'complete' ELSE 'error' END FROM a WHERE step IN ('COMPLETED', 'FAILED')
""")
def progress_reports(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    step = F.when((kind == "purchase") & (value > 60), "COMPLETED").when((kind == "error") & (value > 90), "FAILED").when(F.col("event_id") % 3 == 0, "PARSING").otherwise("SCANNING")
    events = _t(spark, sf, "events").withColumns({"step": step, "percent": F.floor(value / 50), "total": F.col("event_id") % 4})
    return pg.reported(events, ["user_id"], ["ts", "event_id"], "step", "percent", "total").select("event_id", "event")


_IMPORTS = (
    "org.springframework.web.client", "org.springframework", "LOMBOK.Data", "javax.persistence.Entity", "org.mybatis.spring", "com.acme.Thing", "react", "react-dom/client", "reactive",
    "next/router", "nextjs", "'@angular/core'", "axios", "numpy.linalg", "numpyro", "flask", "uvicorn.workers", "redis", "os.path", '"pandas"',
)
_ENDINGS = (".java", ".tsx", ".py", ".go", ".vue", ".kt")


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""
WITH i AS (SELECT event_id, ({_sql(_IMPORTS)})[event_id % 20 + 1] AS raw, ({_sql(_ENDINGS)})[CAST(floor(event_id / 20) AS BIGINT) % 6 + 1] AS e FROM events),
n AS (SELECT event_id, e, lower(trim(raw, '''"')) AS m FROM i),
l AS (SELECT event_id, m, CASE WHEN e IN ('.java', '.kt') THEN 'java' WHEN e IN ('.tsx', '.vue') THEN 'ts' WHEN e = '.py' THEN 'py' END AS l FROM n)
SELECT event_id, CASE l
  WHEN 'java' THEN CASE WHEN starts_with(m, 'org.springframework') THEN 'spring-boot-starter' WHEN starts_with(m, 'javax.persistence') THEN 'spring-boot-starter-data-jpa'
    WHEN starts_with(m, 'lombok') THEN 'lombok' WHEN starts_with(m, 'org.mybatis') THEN 'mybatis' END
  WHEN 'ts' THEN CASE WHEN split_part(m, '/', 1) IN ('react', 'react-dom', 'next', 'axios') THEN split_part(m, '/', 1) WHEN m = '@angular/core' THEN m END
  WHEN 'py' THEN CASE WHEN split_part(m, '.', 1) IN ('numpy', 'flask', 'uvicorn', 'redis', 'pandas') THEN split_part(m, '.', 1) END END AS dep FROM l
""")
def seeded_imports(spark, sf):
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    path = F.concat(F.lit("src/a"), pick(_ENDINGS, F.floor(F.col("event_id") / 20)))
    return _t(spark, sf, "events").select("event_id", dp.seeded_import(pick(_IMPORTS, F.col("event_id")), path).alias("dep"))


@query("""
WITH d AS (SELECT s_suppkey AS number, 'org.n' || s_nationkey AS artifact FROM supplier),
i AS (SELECT c_custkey % 50 AS file_id, c_custkey AS number, 'org.n' || c_nationkey || '.pkg.Obj' || (c_custkey % 7) AS name FROM customer),
x AS (SELECT i.file_id, 'obj' || (i.number % 7) AS object, arg_min('org.n' || split_part(replace(i.name, 'org.n', ''), '.', 1), i.number) AS dep
  FROM i WHERE EXISTS (SELECT 1 FROM d WHERE starts_with(i.name, d.artifact || '.')) GROUP BY 1, 2),
c AS (SELECT event_id, user_id % 50 AS file_id, CASE WHEN event_type = 'view' THEN 'numpy' WHEN event_type = 'error' THEN NULL ELSE 'obj' || (event_id % 9) END AS object FROM events)
SELECT event_id AS id, coalesce(dep, CASE WHEN c.object = 'numpy' THEN 'numpy' END) || '.m' || event_id % 3 AS external
FROM c LEFT JOIN x USING (file_id, object) WHERE coalesce(dep, CASE WHEN c.object = 'numpy' THEN 'numpy' END) IS NOT NULL
""")
def external_calls(spark, sf):
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    deps = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("number"), F.lit(None).cast("string").alias("group_name"), text("org.n", F.col("s_nationkey")).alias("artifact_name"))
    key = F.col("c_custkey")
    imports = _t(spark, sf, "customer").select((key % 50).alias("file_id"), key.alias("number"), text('"org.n', F.col("c_nationkey"), ".pkg.Obj", key % 7, '"').alias("name"))
    kind, method = F.col("event_type"), text("m", F.col("event_id") % 3)
    name = F.when(kind == "view", F.concat(F.lit("numpy."), method)).when(kind == "error", method).otherwise(F.concat(text("OBJ", F.col("event_id") % 9, "."), method))
    calls = _t(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("file_id"), F.lit("a.py").alias("file_path"), name.alias("qualified_name"), method.alias("method"))
    return dp.external_calls(calls, imports, deps)


@query("""
WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS word FROM documents WHERE lang = 'en'),
h AS (SELECT doc_id, count(*) AS hits FROM p WHERE word IN ('the', 'of', 'tion') GROUP BY 1)
SELECT doc_id, hits, n_chars FROM h JOIN documents USING (doc_id) WHERE source = 'src1' ORDER BY hits DESC, n_chars DESC, doc_id LIMIT 20 OFFSET 10
""")
def search_page(spark, sf):
    docs = _t(spark, sf, "documents").where("lang = 'en'")
    found = se.matches(docs, se.postings(docs, "doc_id", ["text"]), "The of-tion", "doc_id", {"lang": "en", "source": "src1"})
    return se.result_page(found, "n_chars", "doc_id", 20, 10).select("doc_id", "hits", "n_chars")


@query("""
WITH d AS (SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'rewritten ' || item_id ELSE text END AS t FROM benchmark WHERE item_id % 5 > 0 OR item_id % 3 = 0)
SELECT * FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(t), '[^a-z0-9_]+')) AS word, id FROM d) WHERE word <> ''
""")
def synced_postings(spark, sf):
    items = _t(spark, sf, "benchmark")
    changed = items.where("item_id % 3 = 0").select("item_id", F.concat(F.lit("rewritten "), F.col("item_id").cast("string")).alias("text"))
    return se.synced(se.postings(items, "item_id", ["text"]), changed, items.where("item_id % 5 = 0").select("item_id"), "item_id", ["text"])


@query("""
WITH o AS (SELECT o_orderkey, [x.l_partkey FOR x IN l] AS n FROM (SELECT l_orderkey AS o_orderkey, list(struct_pack(l_linenumber, l_partkey) ORDER BY l_linenumber, l_partkey) AS l FROM lineitem GROUP BY 1) RIGHT JOIN orders USING (o_orderkey))
SELECT o_orderkey, coalesce(n[1], 0) AS first, coalesce(n[2], n[1], 0) AS last FROM o
""")
def line_pairs(spark, sf):
    listed = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("n"))
    pair = jsons.line_pair(F.col("n"))
    return _t(spark, sf, "orders").join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", pair[0].alias("first"), pair[1].alias("last"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'f' || user_id ELSE '' END AS path, CASE event_id % 4 WHEN 0 THEN 's' WHEN 1 THEN event_type ELSE '' END AS signature,
  CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'book' ELSE 'article' END AS kind FROM events
""")
def record_coercions(spark, sf):
    of, kind, none = lambda n, k, v: F.when(F.col("event_id") % n == k, v), F.col("event_type"), F.lit(None).cast("string")
    snippet = F.struct(of(3, 0, kind).alias("file_path"), F.when(F.col("event_id") % 3 < 2, F.concat(F.lit("f"), F.col("user_id").cast("string"))).alias("file"))
    node = F.struct(of(4, 0, F.lit("s")).alias("signature"), F.when(F.col("event_id") % 4 < 2, kind).otherwise(none).alias("name"))
    resource = F.when(kind == "view", "Video").when(kind == "click", "BOOK").when(kind == "error", none).otherwise("podcast")
    return _t(spark, sf, "events").select("event_id", jsons.file_path(snippet).alias("path"), jsons.signature(node).alias("signature"), jsons.resource_type(resource).alias("kind"))


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 1 ELSE 2 END AS n, CASE event_type WHEN 'click' THEN 'DK-Unknown' WHEN 'error' THEN 'AL-1' ELSE 'AL-1,ET-2' END AS prefixes FROM events
""")
def salvaged_points(spark, sf):
    kind = F.col("event_type")
    item = '{"title": "%s", "category": "%s", "prefix": "%s", "confidence": 0.5}'
    good, second, bad = item % ("a", "DS", "1"), item % ("b", "SEC", "ET-2"), item % (" ", "DP", "3")
    text = F.when(kind == "click", f"[{bad}]").when(kind == "error", f'{{"items": [{bad}, {good}]}}').otherwise(f"```json\n[{good}, {second}, {bad}]\n```")
    points = jsons.salvaged(jsons.points(text), F.lit("DK"), text)
    return _t(spark, sf, "events").select("event_id", F.size(points).alias("n"), F.array_join(points["prefix"], ",").alias("prefixes"))


@query("""
WITH m AS (SELECT (SELECT count(*) FROM documents) AS files, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS total_lines, (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM lineitem) AS edges,
  (SELECT count(*) FROM orders) AS module_dependencies, (SELECT count(*) FROM supplier) AS external_dependencies, (SELECT count(*) FROM region) AS frameworks, (SELECT count(*) FROM pages) AS routes)
SELECT *, (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT lang AS k, count(*) AS n FROM documents GROUP BY 1)) AS languages,
  (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT p_brand AS k, count(*) AS n FROM part GROUP BY 1)) AS node_types,
  (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1)) AS call_types,
  (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT CAST(s_nationkey AS VARCHAR) AS k, count(*) AS n FROM supplier GROUP BY 1)) AS ecosystems FROM m
""")
def repository_overview(spark, sf):
    t = lambda name: _t(spark, sf, name)
    row = st.overview(
        t("documents").select(F.col("lang").alias("language"), F.col("n_chars").alias("line_count")), t("part").select(F.col("p_brand").alias("node_type")),
        t("lineitem").select(F.col("l_returnflag").alias("call_type")), t("orders"), t("supplier").select(F.col("s_nationkey").cast("string").alias("ecosystem")), t("region"), t("pages"),
    )
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return row.withColumns({c: shown(F.col(c)) for c in ("languages", "node_types", "call_types", "ecosystems")})
