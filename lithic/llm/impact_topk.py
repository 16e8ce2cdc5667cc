"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

A vector's components are quantised to integers; component d of a vector is a posting (vector, impact) in list d. A
shard of vectors keeps its postings in segments: by impact level (halving bounds of the absolute impact, highest
first), then dimension. A query processes level after level, adding each posting's contribution to an accumulator per
vector; lists of dimensions where no query of the block has a weight are left out. What a vector can still gain or
lose is at most the norm of its postings below the level times the query's norm (Cauchy-Schwarz). A query stops a
shard only when that bound proves which vectors can still be among its k best; lower segments are not read for it.
These possible members are rescored exactly from their components, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import ship, shuffle_width

ship(__name__)

#: Vectors in a shard and queries in a block, which meet in one task; queries that have accumulators at a time.
SHARD, BLOCK, GO = 65_536, 65_536, 64
SCALE = 256
#: Integers up to here are exact as doubles, and share of the product of norms that rounding of accumulators stays below.
_WHOLE, _ROUNDING = 1 << 53, 1e-12


def products(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers with one row; an error where one does not fit a long."""
    top = int(np.abs(vectors).max(initial=0)) * int(np.abs(weights).max(initial=0)) * len(weights)
    if top < _WHOLE:
        return (vectors.astype(np.float64) @ weights.astype(np.float64)).astype(np.int64)
    exact = vectors.astype(object) @ weights.astype(object)
    if any(abs(x) >= 1 << 63 for x in exact):
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


class ImpactIndex:
    """Posting segments of one shard: `vectors` is an array of integers, rows by dimensions."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.int64)
        size = np.abs(self.vectors)
        self.norms = np.sqrt((size.astype(np.float64) ** 2).sum(axis=1))
        top = int(size.max(initial=0))
        bounds = [1 << b for b in range(max(top, 1).bit_length() - 1, -1, -1)]
        level = np.frexp(size.astype(np.float64))[1]  # 0 for no impact
        dim, row = np.nonzero(level.T)
        order = np.argsort(-level[row, dim], kind="stable")
        dim, row = dim[order], row[order]
        many = np.bincount(level.ravel(), minlength=bounds[0].bit_length() + 1)[:0:-1]
        ends = np.cumsum(many)
        #: Per level: dimensions in order, rows, impacts; and the norm of what each vector keeps below it.
        self.segments, self.rest = [], []
        below = self.norms**2
        for a, b in zip(ends - many, ends):
            if a < b:
                impact = self.vectors[row[a:b], dim[a:b]].astype(np.float64)
                below = below - np.bincount(row[a:b], impact**2, len(vectors))
                self.segments.append((dim[a:b], row[a:b], impact))
                self.rest.append(np.sqrt(np.maximum(below, 0) + _ROUNDING * self.norms**2))
        if self.rest:
            self.rest[-1] = np.zeros(len(vectors))

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores): the rows that can be among its k best, with exact scores. skip: own row of a query or -1."""
        for at in range(0, len(queries), GO):
            for q, rows in self._possible(queries[at : at + GO].astype(np.float64), k, skip[at : at + GO]):
                rows = rows[rows != skip[at + q]]
                yield at + q, rows, products(self.vectors[rows], queries[at + q])

    def _possible(self, weights: np.ndarray, k: int, skip: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        n, used = len(self.vectors), np.flatnonzero(weights.any(axis=0))
        norms = np.sqrt((weights**2).sum(axis=1)) * (1 + _ROUNDING)
        place = np.full(weights.shape[1], -1)
        place[used] = np.arange(len(used))
        active, sums = np.arange(len(weights)), np.zeros((len(weights), n))
        slab = np.zeros((len(used), n))
        for (dim, row, impact), rest in zip(self.segments, self.rest):
            begins = np.flatnonzero(np.concatenate(([True], dim[1:] != dim[:-1])))
            for a, b in zip(begins.tolist(), np.append(begins[1:], len(dim)).tolist()):
                if place[dim[a]] >= 0:
                    slab[place[dim[a]], row[a:b]] = impact[a:b]
            sums += weights[active][:, used] @ slab
            slab[:] = 0
            last = rest is self.rest[-1]
            # no proof can be had where the typical room is wider than what tells the best from nothing
            if not last and n > k and (sums.max(axis=1) < 2 * norms[active] * np.median(rest)).all():
                continue
            room = rest[None, :] * norms[active, None] + _ROUNDING * self.norms[None, :] * norms[active, None]
            low = sums - room
            own = np.flatnonzero(skip[active] >= 0)
            low[own, skip[active][own]] = -np.inf
            enough = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), -np.inf)
            possible = sums + room >= enough[:, None]
            going = (possible.sum(axis=1) > 4 * k) & (not last and n > k)
            for i in np.flatnonzero(~going).tolist():
                yield int(active[i]), np.flatnonzero(possible[i])
            active, sums = active[going], sums[going]
            if not len(active):
                return
        for q in active.tolist():  # no postings at all
            yield q, np.arange(n)


def _usable(column: str):
    """Vectors without null and non-finite components, of one component or more."""
    good = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & good


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>): components x become floor(scale * x); vectors that take no part are left out.

    A component must stay below 2^63 after scaling.
    """
    as_double = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return as_double.where(F.col("id").isNotNull() & _usable("v")).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def top_k(index: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The k rows of `index` with the highest inner product for each row of `queries`: (query_id, rank, vec_id, score).

    Both hold (id long, v array<int or long>). Vectors of the dimension that most rows of `index` have take part and
    others are left out. A query's own id is no candidate. Ties go to the smaller id; repeated ids in `index` are
    candidates each; of queries that share an id the one with the smallest vector counts. Fewer candidates than k: all
    of them. Empty tables: no rows. A score that does not fit a long is an error.

    Every row goes to one shard, where its index is built once for a block of queries; more than `block` queries meet
    the shard in several blocks. A shard gives at most k rows per query.
    """
    spark = index.sparkSession
    size = index.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(shuffle_width(spark), -(-size["count"] // shard))
    asked = queries.where(F.size("v") == size["d"]).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = index.where(F.size("v") == size["d"]).select("id", "v", of("id", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("id", "v", of("id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def cell(_, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(rows) and len(asked):
            rows = rows.sort_values("id", kind="stable", ignore_index=True)
            ids, own = rows["id"].to_numpy(), asked["id"].to_numpy()
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            # a repeated id has more than one own row: those are left out below
            skip = np.where(ids[at] == own, at, -1)
            most = k + len(ids) - len(np.unique(ids))
            for q, found, score in ImpactIndex(np.stack(rows["v"].to_numpy())).search(np.stack(asked["v"].to_numpy()), most, skip):
                keep = ids[found] != own[q]
                found, score = ids[found][keep], score[keep]
                best = np.lexsort((found, -score))[:k]
                out.append(pd.DataFrame({"query_id": own[q], "vec_id": found[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    per_cell = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return per_cell.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
