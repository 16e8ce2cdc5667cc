"""Small operations on rows of versions, metrics, imports and evaluation cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How imports of a project's own files begin.
INTERNAL = ("./", "../", "@/", "~/")
#: Fixed value: cases that a file of expected points holds.
CASES = 8


def merged_metrics(rows: DataFrame, keys: list[str], ratios: list[str], counts: list[str]) -> DataFrame:
    """One row per key: means of the ratios, sums of the counts."""
    return rows.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ratios), *(F.sum(c).alias(c) for c in counts))


def per_file(n: Column, files: Column) -> Column:
    """How many come on a file, to one decimal; no files count as one."""
    return F.round(n / F.greatest(files, F.lit(1)), 1)


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have, once each."""
    return a.select(key).intersect(b.select(key))


def lacking(rows: DataFrame, value: Column) -> DataFrame:
    """Rows whose value is null or empty."""
    return rows.where(F.coalesce(value, F.lit("")) == "")


def marked_current(versions: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Versions with is_current: whether it is the one that `current` (key, version) names; false where none is named."""
    named = current.select(F.col(key), F.col(version).alias("__named"))
    return versions.join(named, key, "left").withColumn("is_current", F.coalesce(F.col(version) == F.col("__named"), F.lit(False))).drop("__named")


def status_map(text: Column) -> Column:
    """JSON text as a map of maps; null where it is no object of objects."""
    return F.from_json(text, "map<string, map<string, string>>")


def is_internal(name: Column) -> Column:
    """Whether an import is of the project's own files."""
    return reduce(Column.__or__, (F.startswith(name, F.lit(p)) for p in INTERNAL))


def without_version(rows: DataFrame, column: str, version) -> DataFrame:
    """Rows of all other versions and of none."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(version)))


def case_problems(files: DataFrame, language: Column, expected: Column, cases: Column) -> DataFrame:
    """`files` with problems, an array: no language, another than expected, another number of cases than CASES."""
    found = (
        F.when(language.isNull(), "missing language"), F.when(language != expected, "wrong language"), F.when(cases != CASES, "number of cases"),
    )
    return files.withColumn("problems", F.array_compact(F.array(*found)))


def by_qualified_name(calls: DataFrame, functions: DataFrame, order: str) -> DataFrame:
    """Calls with target_id: the function of the equal qualified name, the last by `order` of several; null without one.

    Functions are (id, qualified_name, order); names are made unique before the join, so a name of many is one row.
    """
    last = Window.partitionBy("qualified_name").orderBy(F.desc(order), F.desc("id"))
    unique = functions.where("qualified_name IS NOT NULL").withColumn("__r", F.row_number().over(last)).where("__r = 1")
    return calls.join(unique.select("qualified_name", F.col("id").alias("target_id")), "qualified_name", "left")
