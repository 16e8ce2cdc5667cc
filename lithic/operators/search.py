"""Full-text, name and vector search over tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.text import words


def postings(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(word, id): distinct words of the text columns."""
    text = F.concat_ws(" ", *columns)
    return rows.select(F.explode(words(text)).alias("word"), F.col(id_col).alias("id"))


def full_text(index: DataFrame, query: list[str], every: bool = False) -> DataFrame:
    """(id, hits): rows of a postings table with any of the query's words, or with every one; hits counts them."""
    asked = sorted({w.lower() for w in query})
    found = index.where(F.col("word").isin(asked)).groupBy("id").agg(F.count("*").alias("hits"))
    return found.where(F.col("hits") == len(asked)) if every else found


def synced(index: DataFrame, changed: DataFrame, deleted: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """The postings after documents `changed` (new or rewritten) and ids `deleted`; an id in both is deleted first, then added."""
    stale = changed.select(F.col(id_col).alias("id")).union(deleted.select(F.col(id_col).alias("id"))).distinct()
    return index.join(stale, "id", "left_anti").select("word", "id").union(postings(changed, id_col, columns))


def matches(rows: DataFrame, index: DataFrame, query: str, id_col: str, filters: dict | None = None) -> DataFrame:
    """Rows with any word of the query, with hits; filters are equal values of columns. A query without words finds none."""
    asked = [w for w in re.split(r"\W+", query.lower()) if w]
    found = full_text(index, asked).withColumnRenamed("id", id_col) if asked else None
    kept = rows.where(reduce(Column.__and__, (F.col(c) == F.lit(v) for c, v in (filters or {}).items()), F.lit(True)))
    return kept.join(found, id_col) if found is not None else kept.withColumn("hits", F.lit(0).cast("long")).where("false")


def result_page(found: DataFrame, confidence: str, id_col: str, most: int = 20, skip: int = 0) -> DataFrame:
    """One page of matches: most hits first, then confidence, then id."""
    return found.orderBy(F.desc("hits"), F.desc_nulls_last(confidence), id_col).offset(skip).limit(most)


def named(rows: DataFrame, name: str, query: str, most: int, tie: str) -> DataFrame:
    """The first rows, by name, whose name contains the query, upper or lower case."""
    return rows.where(F.col(name).ilike(f"%{query}%")).orderBy(name, tie).limit(most)


def suggestions(rows: DataFrame, name: str, kind: str, query: str, most: int) -> DataFrame:
    """Names that begin with the query, by kind, most frequent first."""
    found = rows.where(F.col(name).ilike(f"{query}%")).groupBy(name, kind).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), name, kind).limit(most)


#: Bytes of a block of queries, which `nearest` broadcasts, and queries and rows multiplied at a time, there and in a cell.
BLOCK_BYTES, _ROWS, _COLUMNS, _TILE = 32 << 20, 1024, 4096, 512


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, score, rank): exact nearest vectors by cosine, rounded to 6 places, ties by id.

    queries and vectors hold (id, v) of one dimension, without nulls. Queries are taken in blocks of about `block_bytes`
    by hash, each with one read of `vectors`; a task keeps k rows per query over all that it reads. Empty tables: no rows.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = [_block_nearest(block.toPandas(), vectors.select("id", "v"), k) for block in _blocks(queries.select("id", "v"), block_bytes)]
    scored = reduce(DataFrame.union, found)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Queries (id, v, ...) in parts of about `block_bytes` of doubles, by hash."""
    width, n = queries.agg(F.max(F.size("v")), F.count("*")).first()
    blocks = max(1, -(-n // max(1, block_bytes // (8 * max(1, width or 1)))))
    number = F.pmod(F.xxhash64("id"), F.lit(blocks))
    return [queries.where(number == b) for b in range(blocks)]


def _unit(column: pd.Series) -> np.ndarray:
    made = np.stack(column.to_numpy())
    return made / np.sqrt((made * made).sum(axis=1, keepdims=True))


def _block_nearest(asked: pd.DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    schema = "query_id long, id long, score double"
    if not len(asked):
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), _unit(asked["v"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, units = shared.value
        kept_id, kept = np.full((len(own), k), np.iinfo(np.int64).max), np.full((len(own), k), -np.inf)
        for batch in batches:
            for start in range(0, len(batch), _COLUMNS):
                part = batch.iloc[start : start + _COLUMNS].sort_values("id", kind="stable")
                ids, rows = part["id"].to_numpy(), _unit(part["v"])
                for at in range(0, len(own), _ROWS):
                    some = slice(at, min(len(own), at + _ROWS))
                    score = np.round(units[some] @ rows.T, 6) + 0.0
                    score[own[some, None] == ids[None, :]] = -np.inf
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    both, names = np.hstack([kept[some], np.take_along_axis(score, top, 1)]), np.hstack([kept_id[some], ids[top]])
                    order = np.lexsort((names, -both), axis=1)[:, :k]
                    kept[some], kept_id[some] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        row, at = np.nonzero(np.isfinite(kept))
        yield pd.DataFrame({"query_id": own[row], "id": kept_id[row, at], "score": kept[row, at]})

    return vectors.mapInPandas(run, schema)


def alike_counts(queries: DataFrame, vectors: DataFrame, least: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, pairs, matches, closest) of queries (id, label, v): all other rows of `vectors` with the label, those whose cosine is `least` or more, and the largest cosine.

    As in `vectors.cosine`, pairs of null, empty or zero vectors, vectors with null components or of unequal lengths have
    0.0. Rows without id or label take no part. A label's rows are dealt by hash into blocks of about `block_bytes`, and
    each two blocks meet in one cell, so a row is shuffled once per block of its label and a task holds two blocks; the
    driver gets no more than the labels of more than one block. Given the same frame twice, a pair is computed once.
    """
    same = queries is vectors
    whole = lambda df: df.where("id is not null and label is not null").select("id", "label", F.when(F.forall("v", lambda x: x.isNotNull()), F.col("v")).otherwise(F.array().cast("array<double>")).alias("v"))
    rows = whole(vectors).withColumn("asked", F.lit(same))
    rows = rows if same else rows.union(whole(queries).withColumn("asked", F.lit(True)))
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    most = max(1, block_bytes // (8 * width))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    n_labels, large = counts.agg(F.count("*"), F.collect_list(F.when(F.col("n") > most, F.struct("label", "n")))).first()
    blocks = {label: -(-n // most) for label, n in large}
    of = F.coalesce(F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair))[F.col("label")], F.lit(1)) if blocks else F.lit(1)
    dealt = rows.withColumn("n", of).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("met"))
    first = F.col("own") <= F.col("met") if same else F.col("asked")
    place = {"i": F.when(first, F.col("own")).otherwise(F.col("met")), "j": F.when(first, F.col("met")).otherwise(F.col("own"))}
    cells = dealt.select("label", *(x.cast("int").alias(k) for k, x in place.items()), (~first).cast("int").alias("side"), F.col("id").cast("long").alias("id"), "v")
    n_cells = n_labels - len(blocks) + sum(k * (k + 1) // 2 if same else k * k for k in blocks.values())
    tasks = min(8 * n_cells, max(200, n_cells)) or 1  # more than cells, so that few share a task
    sorted_cells = cells.repartition(tasks, "label", "i", "j").sortWithinPartitions("label", "i", "j", "side", "id")
    parts = sorted_cells.mapInArrow(partial(_alike_cells, least, same, _TILE), "id long, pairs long, matches long, closest double")
    return parts.groupBy("id").agg(F.sum("pairs").alias("pairs"), F.sum("matches").alias("matches"), F.max("closest").alias("closest"))


def _alike_cells(least: float, same: bool, tile: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each cell of successive rows (label, i, j, side, id, v): side 0 meets side 1, or itself in a cell of one block."""
    cell, held = None, []
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        cuts = [0, *(x for x in range(1, len(names)) if not _equal(names[x - 1], names[x])), len(names)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                if held and not _equal(cell, names[x]):
                    yield from _alike_cell(held, same, cell[1] == cell[2], least, tile)
                    held = []
                cell = names[x]
                held.append(batch.slice(x, y - x))
    if held:
        yield from _alike_cell(held, same, cell[1] == cell[2], least, tile)


def _equal(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))  # NaN is a label like any other


def _alike_cell(held: list[pa.RecordBatch], same: bool, diagonal: bool, least: float, tile: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
    v = table.column("v").combine_chunks()
    sizes, values = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), v.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    groups: tuple = ([], [])
    for at, found in enumerate(groups):
        for size in np.unique(sizes[side == at]):
            rows = np.flatnonzero((side == at) & (sizes == size))
            made = values[begin[rows][:, None] + np.arange(size)]
            found.append((rows, made, np.sqrt((made * made).sum(axis=1))))
    pairs, matches, closest = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
    alone = same and diagonal
    for rows, a, a_norms in groups[0]:
        for others, b, b_norms in groups[0] if alone else groups[1]:
            once = alone and others is rows  # what is right of the diagonal counts for both
            for x in range(0, len(rows), tile):
                for y in range(x if once else 0, len(others), tile):
                    p, q = rows[x : x + tile], others[y : y + tile]
                    near = _cosines(a[x : x + tile], a_norms[x : x + tile], b[y : y + tile], b_norms[y : y + tile])
                    hits, rivals = ~(near < least), None  # NaN is above all, as in Spark
                    if ids[p[0]] <= ids[q[-1]] and ids[q[0]] <= ids[p[-1]]:  # rows are in the order of their ids
                        rivals = ids[p][:, None] != ids[q][None, :]
                        hits &= rivals
                        near = np.where(rivals, near, -np.inf)
                    for own, axis in ((p, 1), (q, 0)) if y > x and once or same and not diagonal else ((p, 1),):
                        pairs[own] += near.shape[axis] if rivals is None else rivals.sum(axis=axis)
                        matches[own] += np.count_nonzero(hits, axis=axis)
                        closest[own] = np.maximum(closest[own], near.max(axis=axis))
    met = pairs > 0
    if met.any():
        yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in (ids, pairs, matches, closest)], ["id", "pairs", "matches", "closest"])


def _cosines(a: np.ndarray, a_norms: np.ndarray, b: np.ndarray, b_norms: np.ndarray) -> np.ndarray:
    if not a.shape[1] or a.shape[1] != b.shape[1]:
        return np.zeros((len(a), len(b)))
    size = a_norms[:, None] * b_norms[None, :]
    with np.errstate(invalid="ignore"):
        if a_norms.min() * b_norms.min() > 0:  # none is 0 or NaN
            return np.divide(a @ b.T, size, out=size)
        return np.where(size == 0, 0.0, a @ b.T / np.where(size == 0, 1.0, size))
