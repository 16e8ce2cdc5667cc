"""Places where a caller's Python function takes part: embedders, extractors, context for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lithic.functions.text import truncated_at_line
from lithic.functions.vectors import fitted, hashed_embedding

POINTS = "case_id string, at int, category string, title string, description string, confidence double"


def embedded(rows: DataFrame, columns: list[str], dimension: int, embed: Callable[[list[str]], list[list[float]]] | None = None, out: str = "embedding") -> DataFrame:
    """Rows with a vector of their text columns, cut or padded to `dimension`; a batch that `embed` fails on has zeros.

    Without `embed`, words are hashed to components.
    """
    text = F.concat_ws("\n", *columns)
    if embed is None:
        return rows.withColumn(out, hashed_embedding(text, dimension))

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            try:
                yield pd.Series([list(map(float, v)) for v in embed(part.tolist())], index=part.index)
            except Exception:  # a caller's function: whatever it raises, its batch has no vectors
                yield pd.Series([[0.0] * dimension] * len(part), index=part.index)

    return rows.withColumn(out, fitted(run(text), dimension))


def extracted(cases: DataFrame, extract: Callable[[list[dict], str], list[dict]]) -> DataFrame:
    """Points that `extract` finds in each case (id, category, code_snippets), numbered in its order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (i, at, p.get("category", category), p.get("title"), p.get("description"), p.get("confidence"))
                for i, category, snippets in zip(part["id"], part["category"], part["code_snippets"])
                for at, p in enumerate(extract([dict(s) for s in snippets], category))
            ]
            yield pd.DataFrame(rows, columns=["case_id", "at", "category", "title", "description", "confidence"])

    return cases.select("id", "category", "code_snippets").mapInPandas(run, POINTS)


def expanded(points: DataFrame, expand: Callable[[dict], str | None], least: float = 0.0, columns: tuple[str, ...] = ("title", "description", "category")) -> DataFrame:
    """Points with `expansion` from `expand` (a dict of the named columns) in place of theirs, and `expansion_failed`.

    Points below `least` confidence (null counts 0.5) are passed on as they are; with 0 all are asked for. Where `expand`
    gives nothing or raises, the expansion stays as it was and the point counts as failed. Points of a partition are
    asked for one after the other, partitions at once.
    """
    asked = F.coalesce("confidence", F.lit(0.5)) >= least
    given = F.when(asked, F.struct(*columns))

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        def one(row: dict) -> str | None:
            try:
                return expand(row) or None
            except Exception:  # a caller's function: whatever it raises, its point has no new expansion
                return None

        for part in parts:
            yield pd.Series([None if all(v is None for v in row.values()) else one(row) for row in part.to_dict("records")], index=part.index, dtype="object")

    new = points.withColumn("__new", run(F.struct(*(given.getField(c).alias(c) for c in columns))))
    old = F.col("expansion") if "expansion" in points.columns else F.lit(None).cast("string")
    return new.withColumns({"expansion": F.coalesce("__new", old), "expansion_failed": asked & F.col("__new").isNull()}).drop("__new")


def context(files: DataFrame, group: str, most: int = 50, chars: int = 5000) -> DataFrame:
    """(group, path, content): of each group's files the first `most` by path, each cut to `chars` at a line's end."""
    order = Window.partitionBy(group).orderBy("path")
    first = files.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most)
    return first.select(group, "path", truncated_at_line(F.col("content"), chars).alias("content"))
