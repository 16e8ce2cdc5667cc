"""Row filters, validation, table changes without MERGE, ordering and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed kinds of nodes, calls and imports.
NODE_TYPES = ("function", "class", "method", "import", "call", "interface", "type", "constructor", "protocol", "enum", "struct", "variable")
CALL_TYPES = ("static", "dynamic", "unknown", "external", "injected")
STRICT_CALL_TYPES = ("static", "dynamic", "unknown")
IMPORT_TYPES = ("relative", "absolute", "external")


def where_equal(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that equal every wanted value; a wanted None sets no condition."""
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def where_tagged(df: DataFrame, column: str, tag: str) -> DataFrame:
    return df.where(F.array_contains(column, tag))


def where_like(df: DataFrame, column: str, query: str, prefix: bool = False) -> DataFrame:
    """Case-insensitive containment or prefix; `%` and `_` of the query are wildcards."""
    return df.where(F.col(column).ilike(f"{query}%" if prefix else f"%{query}%"))


def with_errors(df: DataFrame, checks: dict[str, Column], out: str = "errors") -> DataFrame:
    """`df` with the array of the names of the checks that hold; a check that is null does not hold."""
    return df.withColumn(out, F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()))))


def node_checks() -> dict[str, Column]:
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return {
        "name missing": blank("name"),
        "node_type unknown": ~F.col("node_type").isin(*NODE_TYPES),
        "start_line negative": F.col("start_line") < 0,
        "start after end": F.col("start_line") > F.col("end_line"),
        "column negative": (F.col("start_column") < 0) | (F.col("end_column") < 0),
    }


def checked_nodes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with errors, a file that is not in `files` (file_id) being one."""
    known = files.select(F.col("file_id").alias("__file")).distinct()
    joined = nodes.join(known, nodes.file_id == F.col("__file"), "left")
    return with_errors(joined, node_checks() | {"file unknown": F.col("__file").isNull()}).drop("__file")


def checked_calls(edges: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """Call edges with errors: unknown ends (a null callee is allowed) and kinds of call."""
    ids = nodes.select("id").distinct()
    joined = edges.join(ids.withColumnRenamed("id", "__caller"), F.col("caller_node_id") == F.col("__caller"), "left")
    joined = joined.join(ids.withColumnRenamed("id", "__callee"), F.col("callee_node_id") == F.col("__callee"), "left")
    checks = {
        "caller unknown": F.col("__caller").isNull(),
        "callee unknown": F.col("callee_node_id").isNotNull() & F.col("__callee").isNull(),
        "call_type unknown": ~F.col("call_type").isin(*(STRICT_CALL_TYPES if strict else CALL_TYPES)),
        "start_line negative": F.col("start_line") < 0,
    }
    return with_errors(joined, checks).drop("__caller", "__callee")


def checked_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    ids = files.select("file_id").distinct()
    joined = edges.join(ids.withColumnRenamed("file_id", "__from"), F.col("importer_file_id") == F.col("__from"), "left")
    joined = joined.join(ids.withColumnRenamed("file_id", "__to"), F.col("imported_file_id") == F.col("__to"), "left")
    checks = {
        "importer unknown": F.col("__from").isNull(),
        "imported unknown": F.col("imported_file_id").isNotNull() & F.col("__to").isNull(),
        "import_type unknown": ~F.col("import_type").isin(*IMPORT_TYPES),
        "import_name blank": F.coalesce(F.trim("import_name"), F.lit("")) == "",
    }
    return with_errors(joined, checks).drop("__from", "__to")


def without_dangling(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """`df` with `column` null where it names no row of `keys`."""
    known = keys.select(F.col(key).alias("__key")).distinct()
    return df.join(known, df[column] == F.col("__key"), "left").withColumn(column, F.col("__key")).drop("__key").select(df.columns)


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; rows with equal null keys are one key."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def latest_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    return one_per_key(df, keys, [F.desc(at), F.desc(tie)])


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """`table` with `changes` put in: rows of a key give way to its change; of several changes the latest stays."""
    newest = one_per_key(changes, keys, [F.desc(at)])
    return table.join(newest.select(keys).distinct(), keys, "left_anti").select(table.columns).unionByName(newest.select(table.columns))


def updated(table: DataFrame, changes: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """`table` with non-null values of the allowed columns taken over from `changes` (one row per key)."""
    taken = [c for c in allowed if c in changes.columns and c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in taken))
    joined = table.join(new, keys, "left")
    return joined.select(*((F.coalesce(f"__{c}", c).alias(c) if c in taken else F.col(c)) for c in table.columns))


def without_keys(df: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    return df.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(df.columns)


def without_touched(edges: DataFrame, gone: DataFrame, ends: tuple[str, str], key: str) -> DataFrame:
    """Edges neither of whose ends is among `gone`; edges with a null end are judged by the other."""
    return without_keys(without_keys(edges, gone, ends[0], key), gone, ends[1], key)


def only_keys(df: DataFrame, keep: DataFrame, column: str, key: str) -> DataFrame:
    return df.join(keep.select(F.col(key).alias(column)).distinct(), column, "left_semi").select(df.columns)


def attached(df: DataFrame, rows: DataFrame, key: str, item: Column, order: Column, out: str) -> DataFrame:
    """`df` with the key's items of `rows` in order as one array (empty if none)."""
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i")))).alias("__items"))
    listed = df.join(gathered, key, "left")
    return listed.withColumn(out, F.coalesce(F.transform("__items", lambda x: x["i"]), F.array().cast("array<string>"))).drop("__items")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of page `number`, from 1. The order must end with a unique key."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """One row: total and pages (at least 1)."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def sort_columns(allowed: dict[str, str], asked: str | None, descending: bool, tie: str) -> list[Column]:
    """Order by an allowed field; others fall back to the first allowed one, newest first."""
    if asked not in allowed:
        return [F.desc(next(iter(allowed.values()))), F.asc(tie)]
    column = allowed[asked]
    return [F.desc(column) if descending else F.asc(column), F.asc(tie)]


def newest_groups(df: DataFrame, group: str, at: str, most: int) -> DataFrame:
    """Rows of the `most` groups whose last row is newest; groups that tie count one after the other, by name."""
    last = df.groupBy(group).agg(F.max(at).alias("__last"))
    keep = last.orderBy(F.desc("__last"), F.desc(group)).limit(most)
    return df.join(keep.select(group), group, "left_semi").select(df.columns)


def remaining(work: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Work without a completed row in `progress` (key, status)."""
    return work.join(progress.where("status = 'completed'").select(key).distinct(), key, "left_anti")
