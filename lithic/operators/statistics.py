"""Counts, distributions, capped scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories of knowledge points that statistics list.
CATEGORIES = ("DP", "AD", "AL", "ET", "DK")
#: Order in which ecosystems are listed before others.
ECOSYSTEMS = ("maven", "npm", "pip", "go", "cargo")


def distribution(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Rows per value, most first, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias(out)).orderBy(F.desc(out), F.asc(column))


def as_map(counts: DataFrame, column: str, out: str) -> DataFrame:
    """One row with a map of a distribution, which has few values."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(out))


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row with the columns of frames of one row each."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.crossJoin(frame)
    return out


def overview(
    files: DataFrame, nodes: DataFrame, edges: DataFrame, modules: DataFrame, dependencies: DataFrame, frameworks: DataFrame, routes: DataFrame
) -> DataFrame:
    """One row of twelve figures: counts of seven tables, lines of files, and four distributions as maps.

    files (language, line_count), nodes (node_type), edges (call_type) and dependencies (ecosystem) are read once each: a
    table's figures all come from its counts by value. A value of null is left out of its map but not of its count.
    """

    def counted(df: DataFrame, name: str, column: str, spread: str, *more: Column) -> DataFrame:
        by_value = df.groupBy(column).agg(F.count("*").alias("n"), *more)
        listed = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(column, "n"))))
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in by_value.columns[2:]]
        return by_value.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name), F.map_from_entries(listed).alias(spread), *sums)

    alone = [df.agg(F.count("*").alias(name)) for df, name in ((modules, "module_dependencies"), (frameworks, "frameworks"), (routes, "routes"))]
    return side_by_side(
        counted(files, "files", "language", "languages", F.sum("line_count").alias("total_lines")),
        counted(nodes, "nodes", "node_type", "node_types"),
        counted(edges, "edges", "call_type", "call_types"),
        counted(dependencies, "external_dependencies", "ecosystem", "ecosystems"),
        *alone,
    )


def buckets(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row: rows at `high` or more, between, and below `low`."""
    c = F.col(column)
    return df.agg(F.count_if(c >= high).alias("high"), F.count_if((c >= low) & (c < high)).alias("medium"), F.count_if(c < low).alias("low"))


def by_category(points: DataFrame, categories=CATEGORIES) -> DataFrame:
    """(category, n) for each listed category, those without rows too."""
    listed = points.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return listed.join(points.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def capped(score: Column, cap: float) -> Column:
    return F.least(score, F.lit(cap))


def merged_scores(*levels: DataFrame) -> DataFrame:
    """(framework, confidence) summed over levels and capped at 1."""
    every = levels[0].select("framework", "confidence")
    for one in levels[1:]:
        every = every.unionByName(one.select("framework", "confidence"))
    return every.groupBy("framework").agg(F.least(F.sum("confidence"), F.lit(1.0)).alias("confidence"))


def ratio(part: Column, whole: Column) -> Column:
    """0.0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def scores(df: DataFrame, keys: list[str], tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Sums of counts per key with precision, recall and F1."""
    summed = df.groupBy(*keys).agg(*(F.sum(c).alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"))))
    return with_scores(summed)


def with_scores(summed: DataFrame) -> DataFrame:
    t = F.col("tp")
    rated = summed.withColumns({"precision": ratio(t, t + F.col("fp")), "recall": ratio(t, t + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", ratio(2 * p * r, p + r))


def rolled_up(df: DataFrame, first: str, second: str) -> DataFrame:
    """Scores by the first key, the second, both, and over all; `level` names which."""
    sets = df.groupingSets([[first], [second], [first, second], []], first, second)
    summed = sets.agg(F.grouping_id(first, second).alias("g"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 2, second).when(F.col("g") == 1, first).otherwise(f"{first} and {second}")
    return with_scores(summed).select(level.alias("level"), first, second, "tp", "fp", "fn", "precision", "recall", "f1")


def weighted_mean(df: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """Mean weighted by `weight`; plain where all weights are 0."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.avg(value)).alias(value))


def spread(df: DataFrame, value: str) -> DataFrame:
    """Population deviation, least and greatest, rounded to 4 places."""
    return df.agg(*(F.round(f(value), 4).alias(n) for f, n in ((F.stddev_pop, "std"), (F.min, "least"), (F.max, "greatest"))))


def edge_counts(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.groupBy(a, b).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, out_degree, in_degree) over distinct edges."""
    once = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    ends = once.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(once.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def top_per_group(df: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """The first `most` distinct items of each group in order, as one array."""
    return df.groupBy(group).agg(F.slice(F.array_sort(F.collect_set(item)), 1, most).alias("items"))


def ecosystem_order(column: str) -> list[Column]:
    known = F.array(*(F.lit(e) for e in ECOSYSTEMS))
    at = F.array_position(known, F.col(column))
    return [F.when(at == 0, len(ECOSYSTEMS) + 1).otherwise(at).asc(), F.asc(column)]
