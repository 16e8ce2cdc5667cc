"""Approximate nearest neighbours by multiprobe p-stable hashing, for cosine.

Vectors are scaled to length one, where the largest cosine is the smallest Euclidean distance. A table's key is K
numbers floor((a . x + b) / w) with Gaussian a. Each vector is filed in one bucket per table. A query visits perturbed
buckets in the order of their estimated success: for a neighbour at distance r, a . (x - q) is normal with deviation
r, so each neighbouring slot has a known chance and a bucket the product of K chances. It stops in a table when the
chances add up to what lets all tables together reach the wanted recall, however many buckets that takes; K is small
enough that it takes MOST or fewer for a sample of places. r is the distance that most of a bounded sample of queries
have to their k-th neighbour among all rows. Candidates of all tables are merged and ranked by exact cosine.

Queries that do not find k neighbours within reach of r are compared with all rows, in blocks.

Buckets are dealt over cells by hash, large ones in parts. A query goes once to each cell it visits, with the list of
its buckets there. Cells that very many queries visit are repeated for blocks of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import ship, shuffle_width, staged, unstage

ship(__name__)

TABLES = 3
RECALL = 0.96
#: Slot width in units of r.
WIDTH = 1.8
#: Slots to either side that a probe may move (farther ones hold one part in 3,000), and buckets that K is chosen for.
REACH, MOST = 2, 4096
#: Queries whose k-th neighbour is looked up to set r, and the share of them that r covers.
SAMPLE, COVER = 64, 0.9
#: Rows of a cell, and queries that meet a cell at a time.
CELL, ASKED = 32_768, 8_192
SEED = 11
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    out = x * _MIX
    return out ^ (out >> np.uint64(29))


@dataclass
class Hashing:
    """a, b, width: of the tables; radius, share: the distance and the success that probing in one table aims at.

    cells: how many; parts: of the keys that are split, in how many.
    """

    a: np.ndarray
    b: np.ndarray
    width: float
    radius: float
    share: float
    cells: int = 1
    parts: dict[int, int] = field(default_factory=dict)

    def slots(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Slot numbers and the places inside the slots."""
        at = unit @ self.a[table] + self.b[table]
        slot = np.floor(at / self.width).astype(np.int64)
        return slot, at - slot * self.width

    def key(self, slots: np.ndarray, table: int) -> np.ndarray:
        """One 64-bit number for the slots; unequal slots share one about never, which would only add candidates."""
        out = np.full(slots.shape[0], table + 1, dtype=np.uint64)
        for column in slots.T:
            out = _mixed(out ^ column.astype(np.uint64))
        return out.view(np.int64)

    def probes(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        """Keys of the buckets that each query visits, likeliest first."""
        slots, inside = self.slots(unit, table)
        moves = (_best_moves(self._chances(place), self.share) for place in inside)
        return [self.key(own + move, table) for own, move in zip(slots, moves)]

    def _chances(self, inside: np.ndarray) -> np.ndarray:
        """Chance of each step (columns) for a neighbour at the radius, per slot number (rows)."""
        steps = np.arange(-REACH, REACH + 1)
        ends = (self.width * (steps[:, None] + np.array([0, 1])) - inside[:, None, None]) / self.radius
        return np.diff(_normal(ends), axis=2)[:, :, 0]

    def buckets(self, keys: np.ndarray, ids: np.ndarray | None = None) -> np.ndarray:
        """Bucket numbers of rows, or of all parts of the keys if no ids are given."""
        many = np.array([self.parts.get(k, 1) for k in keys.tolist()], dtype=np.uint64) if self.parts else np.ones(len(keys), dtype=np.uint64)
        if ids is None:
            keys = np.repeat(keys, many.astype(np.int64))
            part = np.concatenate([np.arange(m, dtype=np.uint64) for m in many]) if len(many) else many
        else:
            part = _mixed(_mixed(ids.astype(np.int64).view(np.uint64)) ^ np.uint64(SEED)) % many
        return _mixed(keys.view(np.uint64) + part).view(np.int64)

    def cell(self, buckets: np.ndarray) -> np.ndarray:
        return (_mixed(buckets.view(np.uint64)) % np.uint64(self.cells)).astype(np.int64)


def _best_moves(chances: np.ndarray, share: float, last: bool = False) -> np.ndarray | None:
    """Steps per slot number of the likeliest buckets, as many as it takes for their chances to add up to `share`.

    last: give up where MOST buckets do not reach it.
    """
    steps, most = np.arange(-REACH, REACH + 1), MOST
    while True:
        odds, moves = np.ones(1), np.zeros((1, 0), dtype=np.int64)
        for one in chances:
            odds = (odds[:, None] * one[None, :]).ravel()
            moves = np.concatenate((np.repeat(moves, len(steps), axis=0), np.tile(steps, len(moves))[:, None]), axis=1)
            best = np.argsort(-odds, kind="stable")[:most]
            odds, moves = odds[best], moves[best]
        reached = np.cumsum(odds)
        if reached[-1] >= share or most >= len(steps) ** len(chances):
            return moves[: int(np.searchsorted(reached, share)) + 1]
        if last:
            return None
        most *= 4


def functions_of(n: int, share: float) -> int:
    """K: enough that buckets hold about 1,000 rows if slots split in three, few enough that `share` takes MOST buckets or fewer."""
    rng = np.random.default_rng(SEED)
    for k in range(max(4, round(math.log(max(n, 1) / 1000) / math.log(3))), 1, -1):
        sample = Hashing(np.zeros((1, 1, k)), np.zeros((1, k)), WIDTH, 1.0, share)
        if all(_best_moves(sample._chances(rng.random(k) * WIDTH), share, last=True) is not None for _ in range(8)):
            return k
    return 1


def _normal(x: np.ndarray) -> np.ndarray:
    """Distribution function of the standard normal, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part: not null, not zero, all components finite."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)


def radius(rows: DataFrame, queries: DataFrame, k: int) -> float:
    """Distance that covers COVER of the k-th neighbours of SAMPLE queries among all rows; the sample goes to every task."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(sample):
        return 1.0
    ids, unit = sample["id"].to_numpy(), _unit(_stack(sample["v"]))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full((len(unit), k), -2.0)
        for batch in batches:
            if len(batch):
                cosine = np.where(batch["id"].to_numpy()[None, :] == ids[:, None], -2.0, unit @ _unit(_stack(batch["v"])).T)
                best = -np.sort(-np.concatenate((best, cosine), axis=1), axis=1)[:, :k]
        yield pd.DataFrame({"q": np.repeat(np.arange(len(unit)), k), "cosine": best.ravel()})

    found = rows.mapInPandas(near, "q int, cosine double").where("cosine > -2")
    last = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine")))).where(F.col("rank") <= k)
    each = [r["c"] for r in last.groupBy("q").agg(F.min("cosine").alias("c")).collect()]
    return math.sqrt(max(1e-4, 2 - 2 * float(np.quantile(each, 1 - COVER)))) if each else 1.0


def _exact(k: int):
    """Per cell (_, rows (bucket, id, v), queries (id, v, buckets)) the k nearest rows of each query in its buckets."""

    def rank(_, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": np.int64, "vec_id": np.int64})
        rows = rows.sort_values(["bucket", "id"], kind="stable", ignore_index=True)
        ids, bucket, x = rows["id"].to_numpy(), rows["bucket"].to_numpy(), _stack(rows["v"])
        own, q = asked["id"].to_numpy(), _stack(asked["v"])
        visits = asked["buckets"].to_numpy()
        who, what = np.repeat(np.arange(len(own)), [len(v) for v in visits]), np.concatenate(visits)
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        x_unit, q_unit = _unit(x), _unit(q)
        begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(begins[1:], len(bucket))
        first, last = np.searchsorted(what, bucket[begins], "left"), np.searchsorted(what, bucket[begins], "right")
        row, at, near = [], [], []
        for a, b, f, z in zip(begins.tolist(), ends.tolist(), first.tolist(), last.tolist()):
            most = k + (b - a) - len(np.unique(ids[a:b]))
            step = max(1, (1 << 22) // (b - a))
            for s in range(f, z, step):
                part = who[s : min(z, s + step)]
                cosine = q_unit[part] @ x_unit[a:b].T
                cosine[own[part][:, None] == ids[None, a:b]] = -2
                enough = np.partition(cosine, b - a - most, axis=1)[:, b - a - most] - 1e-12 if b - a > most else np.full(len(part), -1.5)
                i, j = np.nonzero(cosine >= np.maximum(enough, -1.5)[:, None])
                row.append(part[i])
                at.append(j + a)
                near.append(cosine[i, j])
        return _best_exact(k, own, q, ids, x, *(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (row, at, near)))

    return rank


def _best_exact(k, own, q, ids, x, row, at, near) -> pd.DataFrame:
    """The k best of candidates (query row, vector row, cosine within rounding) by exactly rounded sums, ties to smaller ids."""
    order = np.lexsort((ids[at], -near, row))
    row, at, near = row[order], at[order], near[order]
    _, same = np.unique(x, axis=0, return_inverse=True)
    begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    norm = lambda v: math.sqrt(math.fsum(v * v))
    lengths: dict[int, float] = {}
    out: list[tuple[int, int, float]] = []
    for a, b in zip(begins.tolist(), np.append(begins[1:], len(row)).tolist()):
        w, known, best = q[row[a]], {}, {}
        length, enough = norm(w), -2.0
        for j, score in zip(at[a:b].tolist(), near[a:b].tolist()):
            if len(best) >= k and score < enough:
                break
            kind = int(same[j])
            if kind not in known:
                if kind not in lengths:
                    lengths[kind] = norm(x[j])
                known[kind] = math.fsum(w * x[j]) / (length * lengths[kind])
            one = int(ids[j])
            if one not in best:
                enough = score - 1e-12 if len(best) < k else enough
            best[one] = max(best.get(one, -2.0), known[kind])
        out += [(int(own[row[a]]), i, s) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": np.int64, "vec_id": np.int64, "score": np.float64})


def _met(rows: DataFrame, asked: DataFrame, k: int, most: int) -> DataFrame:
    """(query_id, vec_id, score) from rows (cell, bucket, id, v) and queries (cell, id, v, buckets), k at most for each in a cell.

    Queries of a cell come in blocks of about `most`; the number of cells bounds the table of blocks that is broadcast.
    """
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.broadcast(blocks)
    number = F.coalesce("blocks", F.lit(1))
    left = rows.join(blocks, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), number - 1)).alias("block"), "bucket", "id", "v")
    right = asked.join(blocks, "cell", "left").select("cell", F.pmod(F.xxhash64("id"), number).cast("int").alias("block"), "id", "v", "buckets")
    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(_exact(k), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _probed(vectors: DataFrame, queries: DataFrame, n: int, hashing: Hashing, k: int, cell: int, most: int) -> DataFrame:
    """What `queries` find in the buckets that they visit."""
    tables = len(hashing.a)
    hashing.cells = max(shuffle_width(vectors.sparkSession), -(-tables * n // cell))
    part_rows = max(1, tables * n // hashing.cells // 2)

    def filed(make, names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    unit = _unit(np.stack(part.column(1).to_numpy(zero_copy_only=False)))
                    for columns in make(part, unit):
                        yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    keys = lambda unit, t: hashing.key(hashing.slots(unit, t)[0], t)
    counted = vectors.mapInArrow(filed(lambda part, unit: ([pa.array(keys(unit, t))] for t in range(tables)), ["key"]), "key long").groupBy("key").agg(F.count("*").alias("n"))
    # keys of more than part_rows rows: at most twice as many as there are cells
    hashing.parts = {r["key"]: -(-r["n"] // part_rows) for r in counted.where(F.col("n") > part_rows).collect()}

    def index(part, unit):
        for t in range(tables):
            bucket = hashing.buckets(keys(unit, t), part.column(0).to_numpy())
            yield [pa.array(hashing.cell(bucket)), pa.array(bucket), *part.columns]

    def visits(part, unit):
        each = [np.concatenate(own) for own in zip(*(hashing.probes(unit, t) for t in range(tables)))]
        rows, cells, lists = [], [], []
        for i, own in enumerate(each):
            bucket = hashing.buckets(own)
            cell = hashing.cell(bucket)
            order = np.argsort(cell, kind="stable")
            bucket, cell = bucket[order], cell[order]
            begins = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            rows.append(np.full(len(begins), i))
            cells.append(cell[begins])
            lists += np.split(bucket, begins[1:])
            if len(lists) > 1 << 15 or i + 1 == len(each):
                at = pa.array(np.concatenate(rows))
                yield [pa.array(np.concatenate(cells)), *part.take(at).columns, pa.array(lists, pa.list_(pa.int64()))]
                rows, cells, lists = [], [], []

    rows = vectors.mapInArrow(filed(index, ["cell", "bucket", "id", "v"]), "cell long, bucket long, id long, v array<double>")
    asked = staged(queries.mapInArrow(filed(visits, ["cell", "id", "v", "buckets"]), "cell long, id long, v array<double>, buckets array<long>"))
    found = staged(_met(rows, asked, k, most))
    unstage(asked)
    return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, recall: float = RECALL, cell: int = CELL, asked: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): per query its k nearest found, by cosine, ties to the smaller id.

    Both inputs hold (id long, v array<double>) as `usable` gives them, of one dimension; vectors of the dimension that
    most rows have take part and others are left out. A query's own id is no candidate; rows with a repeated id count
    once, with the best score, in `queries` too. Fewer candidates than k: all. Empty: no rows.

    A cell holds about `cell` rows and meets about `asked` queries at a time, so one bucket may hold any share of the
    rows and be visited by any share of the queries.
    """
    spark = queries.sparkSession
    size = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, n = size["d"], size["count"]
    vectors, queries = (df.where(F.size("v") == dimension).select("id", "v") for df in (vectors, queries))
    r, share = radius(vectors, queries, k), 1 - (1 - recall) ** (1 / tables)
    rng, count = np.random.default_rng(SEED), functions_of(n, share)
    hashing = Hashing(rng.standard_normal((tables, dimension, count)), rng.random((tables, count)) * WIDTH * r, WIDTH * r, r, share)
    found = _probed(vectors, queries, n, hashing, k, cell, asked)
    in_reach = _ranked(found, k).where((F.col("rank") == k) & (F.col("score") >= 1 - r * r / 2)).select(F.col("query_id").alias("id"))
    left = staged(queries.join(in_reach, "id", "left_anti"))
    # the rest with all rows: a grid of blocks of rows and blocks of queries
    blocks = max(1, -(-n // cell))
    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("cell"), F.lit(0).cast("long").alias("bucket"), "id", "v")
    scan = left.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("cell"), "id", "v", F.array(F.lit(0).cast("long")).alias("buckets"))
    return _ranked(found.union(_met(rows, scan, k, asked)), k).select("query_id", "rank", "vec_id", "score")
