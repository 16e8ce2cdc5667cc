"""Calls resolved level by level: each level is a join of its own and sees only the calls that those before it left."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions.text import guessed_class
from lithic.operators.dependencies import external_calls
from lithic.operators.matching import DYNAMIC_CALLS, INJECTION, INJECTION_TAGS, innermost, narrowed, suffix_matches
from lithic.operators.records import by_qualified_name
from lithic.operators.registry import Registry
from lithic.sources.staging import staged

#: Ending that stands for a language where calls have no path.
_ENDINGS = {"java": ".java", "typescript": ".ts", "javascript": ".js", "vue": ".vue", "python": ".py"}
_FOUND = "id string, callee_node_id string, call_name string"


@dataclass
class Context:
    """What levels may join: functions, who makes a call (id, caller_node_id, marks), imports and declared dependencies."""

    functions: DataFrame
    callers: DataFrame
    imports: DataFrame
    deps: DataFrame


#: Levels by priority: find(open calls, context) gives (id, callee_node_id[, call_name]) for the calls it knows; call_type is what they are.
#: Calls have is_method, whether the name is `*.method`, and method, the name without `*.` or `new `.
LEVELS = Registry()


@LEVELS.register(10, "dynamic", call_type="dynamic")
def _dynamic(calls: DataFrame, _: Context) -> DataFrame:
    return calls.where(F.col("name").isin(*DYNAMIC_CALLS)).select("id", F.lit(None).cast("string").alias("callee_node_id"))


@LEVELS.register(20, "qualified name", call_type="static")
def _qualified(calls: DataFrame, context: Context) -> DataFrame:
    """Plain calls by their whole qualified name, the last function of several; method calls by its ending and the class that the object suggests."""
    named = context.functions.where("qualified_name <> ''").withColumn("place", F.struct("file_id", "start_line"))
    plain = by_qualified_name(calls.where("not is_method and qualified_name <> ''").select("id", "qualified_name"), named.select("id", "qualified_name", "place"), "place")
    owned = suffix_matches(calls.where("is_method").select("id", "qualified_name"), context.functions)
    return plain.where("target_id is not null").select("id", F.col("target_id").alias("callee_node_id")).union(owned.select("id", "callee_node_id"))


@LEVELS.register(30, "name", call_type="static")
def _named(calls: DataFrame, context: Context) -> DataFrame:
    """Functions of the call's name, all of them; for method calls those of the class that the object suggests, if any is."""
    targets = context.functions.select(F.col("name").alias("method"), F.col("id").alias("callee_node_id"), F.col("qualified_name").alias("__target"))
    found = calls.join(targets, "method")
    fits = F.col("is_method") & F.coalesce(F.col("__target").contains(guessed_class(F.col("qualified_name"))), F.lit(False))
    return narrowed(found, "id", fits).select("id", "callee_node_id")


@LEVELS.register(40, "external", call_type="external")
def _external(calls: DataFrame, context: Context) -> DataFrame:
    """Method calls on an object that an import of the file or a seed rule knows, under the dependency's name."""
    found = external_calls(calls.where("is_method"), context.imports, context.deps)
    return found.select("id", F.lit(None).cast("string").alias("callee_node_id"), F.col("external").alias("call_name"))


@LEVELS.register(50, "injected", call_type="injected")
def _injected(calls: DataFrame, context: Context) -> DataFrame:
    """Calls in functions whose annotations or tags mark injected parts."""
    marked = context.callers.where(F.exists("marks", lambda a: a.isin(*INJECTION, *INJECTION_TAGS)))
    return calls.join(marked, "id", "left_semi").select("id", F.lit(None).cast("string").alias("callee_node_id"))


def _with_name(found: DataFrame) -> DataFrame:
    name = F.col("call_name") if "call_name" in found.columns else F.lit(None)
    return found.select(F.col("id").cast("string").alias("id"), F.col("callee_node_id").cast("string").alias("callee_node_id"), name.cast("string").alias("call_name"))


def resolved(calls: DataFrame, functions: DataFrame, imports: DataFrame | None = None, deps: DataFrame | None = None, levels: Registry = LEVELS) -> DataFrame:
    """Call edges (id, call_type, callee_node_id, caller_node_id, file_id, start_line, call_name, level).

    calls: (id, file_id, start_line, name, qualified_name, language[, file_path]); functions: (id, file_id, name,
    qualified_name, start_line, end_line, annotations[, tags]); imports: (file_id, name, number); deps: (number,
    group_name, artifact_name). A level's finds are staged, and the next one gets the calls without any, so a call costs
    the joins up to the level that knows it. Several functions give a row each. What no level knows is unknown. Calls
    with a blank name are left out; the caller is the innermost function around the call, null outside of all.
    """
    spark = calls.sparkSession
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    path = F.col("file_path") if "file_path" in calls.columns else F.lit("").cast("string")
    ending = F.coalesce(*(F.when(F.col("language") == k, v) for k, v in _ENDINGS.items()), F.lit(""))
    name = F.trim("name")
    prepared = calls.where(~blank).select(
        F.col("id").cast("string").alias("id"), "file_id", "start_line", name.alias("name"), "qualified_name", "language", F.when(F.coalesce(path, F.lit("")) == "", ending).otherwise(path).alias("file_path"),
        F.startswith(name, F.lit("*.")).alias("is_method"), F.regexp_replace(name, r"^(\*\.|new )", "").alias("method"),
    )
    marks = F.coalesce("annotations", F.array().cast("array<string>"))
    if "tags" in functions.columns:
        marks = F.concat(marks, F.coalesce("tags", F.array().cast("array<string>")))
    around = functions.select("file_id", F.col("id").alias("caller_node_id"), F.col("start_line").alias("__s"), F.col("end_line").alias("__e"), marks.alias("marks"))
    base = staged(innermost(prepared, around, ["id"], "file_id", "start_line", "__s", "__e", "caller_node_id").drop("__s", "__e"))
    callers = base.select("id", "caller_node_id", "marks").where("caller_node_id is not null")
    imports = imports if imports is not None else spark.createDataFrame([], "file_id string, name string, number long")
    deps = deps if deps is not None else spark.createDataFrame([], "number long, group_name string, artifact_name string")
    context = Context(functions, callers, imports, deps)
    every, found = base.drop("caller_node_id", "marks"), []
    left = every
    for title, find, more in levels:
        here = _with_name(find(left, context)).distinct().withColumns({"call_type": F.lit(more["call_type"]), "level": F.lit(title)})
        found.append(staged(here))
        known = reduce(DataFrame.union, [f.select("id") for f in found])
        left = every.join(known, "id", "left_anti")
    none = F.lit(None).cast("string")
    unknown = left.select("id", none.alias("callee_node_id"), none.alias("call_name"), F.lit("unknown").alias("call_type"), F.lit("unknown").alias("level"))
    edges = reduce(DataFrame.unionByName, [*found, unknown]).withColumnRenamed("call_name", "__as")
    out = edges.join(base.select("id", "caller_node_id", "file_id", "start_line", "name"), "id")
    return out.select("id", "call_type", "callee_node_id", "caller_node_id", "file_id", "start_line", F.coalesce("__as", "name").alias("call_name"), "level")
