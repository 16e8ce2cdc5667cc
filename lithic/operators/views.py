"""What lists, pages and reports show: rows joined with what they name, filtered, ordered and renamed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories of extracted points.
POINT_CATEGORIES = ("DP", "AD", "AL", "ET", "DK", "TT", "TK")


def call_list(edges: DataFrame, nodes: DataFrame, caller_types: list[str] | None = None) -> DataFrame:
    """Call edges (caller_node_id, callee_node_id, start_line, ...) with callee_name, callee_path and `at`, numbered per caller.

    Only calls of callers (id, node_type, name, file_path) of the given types, if any are given: one semi-join rather
    than a look-up per call. A callee that is null or not there has a null name. The number follows the lines, then the
    columns of the call, then the callee's id.
    """
    if caller_types is not None:
        callers = nodes.where(F.col("node_type").isin(caller_types)).select(F.col("id").alias("caller_node_id"))
        edges = edges.join(callers, "caller_node_id", "left_semi")
    callees = nodes.select(F.col("id").alias("callee_node_id"), F.col("name").alias("callee_name"), F.col("file_path").alias("callee_path"))
    order = Window.partitionBy("caller_node_id").orderBy("start_line", "start_column", F.col("callee_node_id").asc_nulls_last())
    return edges.join(callees, "callee_node_id", "left").withColumn("at", F.row_number().over(order))


def file_links(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, imports, importers) of files (file_id, path): paths of both ends of import edges, each once and in order; empty arrays without any.

    Edges whose other end is null or not among the files do not count, and a file is no link of its own.
    """
    a, b = files.select(F.col("file_id").alias("importer_file_id"), F.col("path").alias("a")), files.select(F.col("file_id").alias("imported_file_id"), F.col("path").alias("b"))
    edges = imports.select("importer_file_id", "imported_file_id").distinct().join(a, "importer_file_id").join(b, "imported_file_id").where("a <> b")
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("path"), F.col("b").alias("to"), F.lit(None).cast("string").alias("by")), F.struct(F.col("b").alias("path"), F.lit(None).cast("string").alias("to"), F.col("a").alias("by")))).alias("e")).select("e.*")
    gathered = ends.groupBy("path").agg(F.array_sort(F.collect_set("to")).alias("imports"), F.array_sort(F.collect_set("by")).alias("importers"))
    none = F.array().cast("array<string>")
    return files.select("path").join(gathered, "path", "left").select("path", F.coalesce("imports", none).alias("imports"), F.coalesce("importers", none).alias("importers"))


def route_list(routes: DataFrame, path: str | None = None, method: str | None = None, frameworks: list[str] | None = None) -> DataFrame:
    """Routes (http_method, path_pattern, framework, ...) whose pattern contains `path` and whose method is `method`, in either case."""
    if path is not None:
        routes = routes.where(F.contains(F.lower("path_pattern"), F.lit(path.lower())))
    if method is not None:
        routes = routes.where(F.upper("http_method") == method.upper())
    return routes.where(F.col("framework").isin(frameworks)) if frameworks else routes


def route_summary(routes: DataFrame, key: str) -> DataFrame:
    """(key, n, frameworks, methods): routes per key with their distinct frameworks and methods, in order."""
    return routes.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("framework")).alias("frameworks"), F.array_sort(F.collect_set(F.upper("http_method"))).alias("methods"))


def numbered_list(rows: DataFrame, order: list[Column], out: str = "at", within: list[str] | None = None) -> DataFrame:
    """Rows numbered from 1 in the order given, within groups if any are named; the order must end with a unique key.

    Without groups, only for lists that are shown whole: all rows are in one order.
    """
    return rows.withColumn(out, F.row_number().over((Window.partitionBy(*within) if within else Window.partitionBy()).orderBy(*order)))


def confident(patterns: DataFrame, least: float | None = None) -> DataFrame:
    """Framework patterns (framework, confidence, ...) of at least the given confidence; one without confidence only where none is asked for."""
    return patterns if least is None else patterns.where(F.col("confidence") >= least)


def dependency_list(deps: DataFrame, ecosystem: str | None = None, scope: str | None = None) -> DataFrame:
    """Dependencies of an ecosystem and a scope, where given, each with `at`: its place within the ecosystem by name, then group."""
    for column, wanted in (("ecosystem", ecosystem), ("scope", scope)):
        if wanted is not None:
            deps = deps.where(F.col(column) == wanted)
    return numbered_list(deps, [F.asc("artifact_name"), F.asc_nulls_first("group_name"), F.asc("path")], within=["ecosystem"])


def camel(rows: DataFrame) -> DataFrame:
    """`rows` with columns of the form a_b renamed to aB, as the interface has them."""
    return rows.toDF(*(re.sub(r"(?<=[a-z0-9])_([a-z0-9])", lambda m: m[1].upper(), c) for c in rows.columns))


def exists(rows: DataFrame) -> bool:
    """Whether there is a row: one is looked for, none is counted."""
    return not rows.limit(1).isEmpty()


def to_analyse(changed: DataFrame, reached: DataFrame, key: str) -> DataFrame:
    """Keys that changed (key, change), but for deleted ones, and those that a change reached (key), each once."""
    return changed.where("change <> 'deleted'").select(key).union(reached.select(key)).distinct()


def merged_points(previous: DataFrame, new: DataFrame, branch: str) -> DataFrame:
    """Points (branch, title, ...) after a step: the earlier ones and those whose title is new, per branch.

    Where a branch has no new title, its step was an update, and its new points stand for the earlier ones; where it has
    no points at all, the earlier ones stay. A point without a title is new. Titles are compared within the branch.
    """
    titles = previous.where("title <> ''").select(branch, "title").distinct()
    fresh = new.join(titles, [branch, "title"], "left_anti").select(new.columns)
    grown, given = fresh.select(branch).distinct(), new.select(branch).distinct()
    keep = previous.join(grown, branch, "left_semi").unionByName(previous.join(given, branch, "left_anti"))
    return keep.select(new.columns).unionByName(fresh).unionByName(new.join(grown, branch, "left_anti").select(new.columns))


def point_checks() -> dict[str, Column]:
    """What makes an extracted point (category, prefix, title, description, confidence) unfit; a null confidence is its default."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    either = "|".join(POINT_CATEGORIES)
    fits = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return {
        "category": ~fits("category", f"^({either})$"), "prefix": ~fits("prefix", f"^({either})-.+$"), "title": missing("title"), "description": missing("description"),
        "confidence": F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1),
    }


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Model calls (model, prompt_tokens, completion_tokens) with `cost`, from prices (model, input, output) per million tokens; a model without a price costs nothing."""
    once = prices.select("model", F.col("input").alias("__input"), F.col("output").alias("__output")).dropDuplicates(["model"])
    priced = calls.join(once, "model", "left")
    part = lambda n, price: F.coalesce(F.col(n), F.lit(0)) * (F.coalesce(F.col(price), F.lit(0.0)) / 1_000_000)
    return priced.withColumn("cost", part("prompt_tokens", "__input") + part("completion_tokens", "__output")).drop("__input", "__output")


def middleware_name(name: Column, qualified: Column, line: Column) -> Column:
    """A middleware's name: the qualified one if it says more than `*.use`, else the call's without its arguments, else where it stands."""
    bare = F.trim(F.substring_index(name, "(", 1))
    return F.when((F.coalesce(qualified, F.lit("")) != "") & (qualified != "*.use"), qualified).when(bare == "*.use", F.concat(F.lit("middleware_at_line_"), line.cast("string"))).otherwise(bare)


def descendants(numbered: DataFrame, of: DataFrame) -> DataFrame:
    """(file_id, ancestor, id): nodes below each node asked for (file_id, id), from trees (file_id, id, entry, exit).

    The entries of what lies below a node are the numbers after its own up to its exit. Only those of the nodes asked for
    are listed, and they meet the nodes in an equi-join.
    """
    roots = of.select("file_id", "id").distinct().join(numbered.where("exit > entry"), ["file_id", "id"])
    ranges = roots.select("file_id", F.col("id").alias("ancestor"), F.explode(F.sequence(F.col("entry") + 1, F.col("exit"))).alias("entry"))
    return ranges.join(numbered.select("file_id", "entry", "id"), ["file_id", "entry"]).select("file_id", "ancestor", "id")


def latest_snapshot(snapshots: DataFrame, stage: str) -> DataFrame:
    """(version, file_id, content_hash) of a stage's snapshot of the last version, by its name; rows without a file are left out."""
    own = snapshots.where(F.col("stage") == stage)
    last = own.agg(F.max("analysis_version").alias("analysis_version"))
    found = own.join(F.broadcast(last), "analysis_version").where("file_id is not null")  # one row
    return found.select(F.col("analysis_version").alias("version"), "file_id", "content_hash")


def version_list(snapshots: DataFrame, by: list[str], version: str, at: str, most: int | None = None) -> DataFrame:
    """(by, version, last_at, at): distinct versions of each group, newest first and numbered from 1, the first `most` of them."""
    once = snapshots.groupBy(*by, version).agg(F.max(at).alias("last_at"))
    listed = numbered_list(once, [F.desc("last_at"), F.desc(version)], within=by)
    return listed.where(F.col("at") <= most) if most else listed


def latest_of_status(versions: DataFrame, by: list[str], at: str, tie: str, statuses: list[str] | None = None) -> DataFrame:
    """The last row of each group by `at`, then `tie`, among those of the statuses given, or of any."""
    rows = versions if statuses is None else versions.where(F.col("status").isin(statuses))
    return numbered_list(rows, [F.desc(at), F.desc(tie)], "__at", by).where("__at = 1").drop("__at")
