"""Matching of extracted points with expected ones, and what changes between runs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lithic.functions.vectors import cosine, overlap
from lithic.operators.registry import Registry
from lithic.sources.staging import staged, unstage

TITLE_RATIO, COSINE, LINES = 0.8, 0.85, 0.5
WARN, CRITICAL = 0.05, 0.1
#: Rounds of matching at most, and pairs from which on they are worth a shuffle.
ROUNDS, FEW = 12, 200_000


@F.pandas_udf(DoubleType())
def title_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp likeness of lower-cased titles, 0 to 1."""
    for a, b in parts:
        yield pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)])


def title_match(expected: Column, aliases: Column, found: Column) -> Column:
    """Equal, an alias, or alike enough."""
    exact = F.lower(F.trim(expected)) == F.lower(F.trim(found))
    alias = F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.lower(a) == F.lower(found))
    return exact | alias | (title_ratio(expected, found) >= TITLE_RATIO)


def line_match(expected: Column, found: Column) -> Column:
    return overlap(expected, found) >= LINES


def alike(near: Column) -> Column:
    """Whether a cosine is that of points with one meaning."""
    return near >= COSINE


def semantic_match(expected: Column, found: Column) -> Column:
    return alike(cosine(expected, found))


#: Ways in which an expected point matches a found one, as expressions of the columns expected and found (structs of title, aliases, lines, vector). Others may be added.
MATCHERS = Registry()
MATCHERS.add(10, "title", lambda: title_match(F.col("expected.title"), F.col("expected.aliases"), F.col("found.title")))
MATCHERS.add(20, "lines", lambda: line_match(F.col("expected.lines"), F.col("found.lines")))
MATCHERS.add(30, "semantic", lambda: semantic_match(F.col("expected.vector"), F.col("found.vector")))


def matched(pairs: DataFrame, names: list[str], matchers: Registry = MATCHERS) -> DataFrame:
    """Pairs (expected, found: structs with a category too) that the matchers named hold for: of one category, and any of them."""
    same = F.col("expected.category") == F.col("found.category")
    return pairs.where(point_match(F.coalesce(same, F.lit(False)), *(matchers[n]() for n in names)))


def synthetic_nodes(cases: DataFrame) -> DataFrame:
    """(case_id, id, node_type, name, file_id, start_line, end_line, qualified_name, language): a node per snippet of cases (id, language, code_snippets)."""
    each = cases.select(F.col("id").alias("case_id"), "language", F.posexplode("code_snippets").alias("at", "s"))
    number, name = F.col("at").cast("string"), F.translate("s.file", "/\\", "__")
    kind = F.when(F.col("language").isin("python", "java", "go"), "file").otherwise("script")
    return each.select("case_id", number.alias("id"), kind.alias("node_type"), name.alias("name"), number.alias("file_id"), F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"), name.alias("qualified_name"), "language")


def category_summary(results: DataFrame) -> DataFrame:
    """One row per category of case results (category, f1, precision, recall, extracted, expected, confidence), and one with a null category over all.

    Means are plain ones over cases, rounded to 4 places; over all the F1 is the mean of the categories' unrounded ones,
    and precision, recall and confidence are null.
    """
    mean = lambda c: F.avg(c).alias(c)
    by = results.groupBy("category").agg(mean("f1"), mean("precision"), mean("recall"), mean("confidence"), F.sum("extracted").alias("extracted"), F.sum("expected").alias("expected"), F.count("*").alias("cases"))
    none = F.lit(None).cast("double")
    whole = by.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"), F.coalesce(F.sum("extracted"), F.lit(0)).alias("extracted"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"))
    whole = whole.withColumns({"category": F.lit(None).cast("string"), "precision": none, "recall": none, "confidence": none})
    order = ["category", "f1", "precision", "recall", "confidence", "extracted", "expected", "cases"]
    return by.select(order).union(whole.select(order)).withColumns({c: F.round(c, 4) for c in order[1:5]})


def point_match(same_category: Column, *strategies: Column) -> Column:
    """Same category and any strategy; one that is null does not match."""
    out = F.lit(False)
    for one in strategies:
        out = out | F.coalesce(one, F.lit(False))
    return same_category & out


def assigned(pairs: DataFrame, group: list[str], rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """One-to-one choice from matching pairs (group, expected_at, found_at): found points in order each take the first expected one that is free.

    That choice is made in rounds over all groups and tasks at once: a pair that is first for both its ends is in it,
    whatever else is, and takes the other pairs of its ends away. Rounds end when at most `few` pairs are left, after
    `rounds` of them, or when one takes away less than a twentieth (where all match all, each taking waits for the one
    before). What is left passes in order, a group in one task that keeps only the expected points taken, so groups may
    have any number of pairs. Pairs with a null end are left out; of repeated pairs one counts; null is a group like
    others. The result does not depend on `rounds` and `few`.
    """
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    left = staged(pairs.where("expected_at is not null and found_at is not null").select(key.alias("g"), F.col("expected_at").alias("e"), F.col("found_at").alias("f")).distinct())
    taken, n = [], left.count()
    for _ in range(rounds):
        if n <= few:
            break
        first = left.groupBy("g", "e").agg(F.min("f").alias("f"))
        now = staged(first.join(left.groupBy("g", "f").agg(F.min("e").alias("e")), ["g", "e", "f"]).select("g", "e", "f"))
        rest = staged(left.join(now.select("g", "e"), ["g", "e"], "left_anti").join(now.select("g", "f"), ["g", "f"], "left_anti").select("g", "e", "f"))
        unstage(left)
        left = rest
        taken.append(now)
        before, n = n, left.count()
        if n > 0.95 * before:
            break
    chosen = reduce(DataFrame.unionByName, [*taken, _taken_in_order(left)])
    named = pairs.withColumns({"__g": key})
    kept = named.join(chosen.withColumnsRenamed({"g": "__g", "e": "expected_at", "f": "found_at"}), ["__g", "expected_at", "found_at"], "left_semi")
    return kept.dropDuplicates(["__g", "expected_at", "found_at"]).select(pairs.columns)


def _taken_in_order(left: DataFrame) -> DataFrame:
    """The same choice, made pair by pair in order of found and expected point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, taken, done = None, set(), None
        for batch in batches:
            keep = []
            for i, (g, e, f) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "e", "f")))):
                if g != of:
                    of, taken, done = g, set(), None
                if f != done and e not in taken:
                    done = f
                    taken.add(e)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return left.repartition("g").sortWithinPartitions("g", "f", "e").mapInArrow(run, left.schema)


def confusion(expected: DataFrame, found: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, fn) from expected and found points and the chosen pairs."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    joined = n(expected, "e").join(n(found, "x"), keys, "full_outer").join(n(chosen, "tp"), keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(*keys, zero("tp").alias("tp"), (zero("x") - zero("tp")).alias("fp"), (zero("e") - zero("tp")).alias("fn"))


def regressions(runs: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each run's change against the one before, and its level: critical from CRITICAL down, warning from WARN, else ok."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    drop = F.round(before - F.col(value), 6)
    level = F.when(drop >= CRITICAL, "critical").when(drop >= WARN, "warning").otherwise("ok")
    return runs.withColumns({"before": before, "drop": drop}).withColumn("level", level)


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row from two of one row with f1: the difference and whether b is better."""
    joined = a.select(F.col("f1").alias("f1_a")).crossJoin(b.select(F.col("f1").alias("f1_b")))
    return joined.withColumn("f1_diff", F.round(F.col("f1_b") - F.col("f1_a"), 6)).withColumn("is_improvement", F.col("f1_diff") > 0)


def mean_rating(raw: Column) -> Column:
    """Mean of ratings held to 0..1; what is no number counts 0.5."""
    return F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw.try_cast("double"), F.lit(0.5)))))
