"""Hard-negative mining by dense products of blocks.

Anchors go out in broadcast blocks of bounded bytes; every task multiplies the block with the candidates it reads, block
by block, in float64 (exact, since products below 2^53 are integers; larger ones are multiplied as integers). A first
pass keeps each anchor's best rows of its own label, per task, which are merged into its positives. These are broadcast
in turn, and a second pass keeps, for each anchor and positive, the best rows of other labels inside the window of
scores that the positive gives. Tasks keep k rows per anchor or window whatever they read, so what is shuffled depends
on anchors and tasks and not on candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import ship, staged

ship(__name__)

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: Of a positive's score, in hundredths: the least and the most that a negative may have.
LOW, HIGH = 30, 90
#: Bytes of a block of anchors that is broadcast; candidates that a task reads at least, if there are as many.
ANCHOR_BYTES, TASK_ROWS = 32 << 20, 65_536
#: Anchors and candidates multiplied at a time.
_ROWS, _COLUMNS = 1024, 2048
_WHOLE = 1 << 53


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact products of rows that hold whole numbers as doubles: as doubles below 2^53, else as long; an error beyond a long."""
    top = float(np.abs(anchors).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * anchors.shape[1]
    if top < _WHOLE:
        return anchors @ candidates.T
    exact = np.array([[int(x) for x in row] for row in anchors], dtype=object) @ np.array([[int(x) for x in row] for row in candidates], dtype=object).T
    if any(abs(x) >= 1 << 63 for x in exact.ravel()):
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


def _lowest(made: np.ndarray):
    return -np.inf if made.dtype.kind == "f" else np.iinfo(np.int64).min


def strongest(made: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k first of every row by (value, largest first; column), without those that are the lowest value."""
    low = _lowest(made)
    if made.shape[1] <= k:
        return made > low
    least = np.partition(made, made.shape[1] - k, axis=1)[:, made.shape[1] - k][:, None]
    over = made > least
    tied = (made == least) & (least > low)
    return over | (tied & (np.cumsum(tied, axis=1) <= k - over.sum(axis=1, keepdims=True)))


class Best:
    """The k first (group, score, id) of each group by score, largest first, then id."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, np.iinfo(np.int64).min)
        self.group = self.score = self.id = np.zeros(0, dtype=np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ident = (np.concatenate(x) for x in ((self.group, group), (self.score, score.astype(np.int64)), (self.id, ident)))
        order = np.lexsort((ident, -score, group))
        group = group[order]
        begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        at = np.arange(len(group)) - np.repeat(begins, np.diff(begins, append=len(group)))
        keep = at < self.k
        self.group, self.score, self.id = group[keep], score[order][keep], ident[order][keep]
        full = at == self.k - 1
        self.least[group[full]] = score[order][full]


class Block:
    """A block of anchors, sorted by label: ids, labels, whole-number vectors, and for the second pass their windows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.low = self.high = None

    def windows(self, anchor: np.ndarray, rank: np.ndarray, score: np.ndarray, positives: int, low: int, high: int) -> None:
        """Windows of the positives given by anchor's place, rank from 0 and score; an anchor without one has an empty window."""
        self.low, self.high = np.ones((len(self.ids), positives), dtype=np.int64), np.zeros((len(self.ids), positives), dtype=np.int64)
        self.low[anchor, rank] = [-((-low * int(s)) // 100) for s in score]
        self.high[anchor, rank] = [(high * int(s)) // 100 for s in score]


def _without_own(made: np.ndarray, anchor_ids: np.ndarray, ids: np.ndarray) -> None:
    """Rows of an anchor's own id are no candidates. ids: sorted."""
    first, last = np.searchsorted(ids, anchor_ids), np.searchsorted(ids, anchor_ids, "right")
    for i in np.flatnonzero(last > first).tolist():
        made[i, first[i] : last[i]] = _lowest(made)


def positives_of(block: Block, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    """Take the candidates of each anchor's label into `best` (groups: anchors)."""
    for label in np.unique(labels).tolist():
        a, z = (int(np.searchsorted(block.labels, label, side)) for side in ("left", "right"))
        own = np.flatnonzero(labels == label)
        for at in range(a, z, _ROWS):
            rows = slice(at, min(z, at + _ROWS))
            made = scores(block.vectors[rows], vectors[own])
            _without_own(made, block.ids[rows], ids[own])
            keep = (made >= best.least[rows, None]) & (made > _lowest(made))
            if np.count_nonzero(keep) > 4 * best.k * len(made):
                keep = strongest(np.where(keep, made, _lowest(made)), best.k)
            r, c = np.nonzero(keep)
            best.add(r + at, made[r, c], ids[own[c]])


def negatives_of(block: Block, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    """Take the candidates of other labels into `best` (groups: anchor * positives + rank) where they lie in its window."""
    per = block.low.shape[1]
    open_ = block.low <= block.high
    for at in range(0, len(block.ids), _ROWS):
        rows = slice(at, min(len(block.ids), at + _ROWS))
        if not open_[rows].any():
            continue
        made = scores(block.vectors[rows], vectors)
        made[block.labels[rows, None] == labels[None, :]] = _lowest(made)
        _without_own(made, block.ids[rows], ids)
        least = np.maximum(block.low[rows], best.least.reshape(-1, per)[rows])
        top = np.iinfo(np.int64).max
        lowest, highest = np.where(open_[rows], least, top).min(axis=1), np.where(open_[rows], block.high[rows], -top).max(axis=1)
        r, c = np.nonzero((made >= lowest[:, None]) & (made <= highest[:, None]))
        many = len(r) > 4 * best.k * len(made)
        found = made[r, c]
        for j in range(per):
            if many:
                inside = (made >= least[:, j, None]) & (made <= block.high[rows, j, None]) & open_[rows, j, None]
                x, y = np.nonzero(strongest(np.where(inside, made, _lowest(made)), best.k))
                best.add((x + at) * per + j, made[x, y], ids[y])
            else:
                inside = (found >= least[r, j]) & (found <= block.high[rows, j][r]) & open_[rows, j][r]
                best.add((r[inside] + at) * per + j, found[inside], ids[c[inside]])


def usable(table: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id long, label long, v array<double>) of the rows that take part: no null, and only finite components, one or more."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)


def _columns(batch: pa.RecordBatch, dim: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids sorted, labels, whole-number vectors) of at most _COLUMNS rows at a time."""
    for at in range(0, batch.num_rows, _COLUMNS):
        part = batch.slice(at, _COLUMNS)
        ids, labels = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        vectors = np.floor(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim) * scale)
        order = np.argsort(ids, kind="stable")
        yield ids[order], labels[order], vectors[order]


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE,
         anchor_bytes: int = ANCHOR_BYTES, task_rows: int = TASK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score) for `anchors` against `rows`.

    Both hold (id long, label long, v array<double>), as `usable` makes them; components x count as floor(scale * x). A
    score is the inner product; higher first, ties to the smaller id. An anchor's positives are its first `positives`
    rows of its label; each positive's negatives are the first `negatives` rows of other labels whose score is between
    `low` and `high` hundredths of the positive's (nothing, if that is negative). Rows of an anchor's id are neither.
    Vectors of the dimension that most rows have take part. Repeated ids are candidates each; of anchors that share an
    id the one with the smallest label and vector counts. Fewer rows than asked for: all. Empty tables: no rows. A
    product that does not fit a long is an error. Anchors of one block are on the driver while it is mined: at most
    about `anchor_bytes`; a block costs two reads of `rows`.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    dim = size["d"]
    asked = staged(anchors.where(F.size("v") == dim).groupBy("id").agg(F.min(F.struct("label", "v")).alias("own")).select("id", "own.*"))
    blocks = -(-asked.count() // max(64, anchor_bytes // (8 * dim)))
    wanted = max(spark.sparkContext.defaultParallelism, -(-size["count"] // task_rows))
    candidates = rows.where(F.size("v") == dim).select("id", "label", "v").coalesce(wanted)

    def pass_over(shared, take, groups: int, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, best = shared.value, Best(groups, k)
            for batch in batches:
                for part in _columns(batch, dim, scale):
                    take(block, *part, best)
            if len(best.group):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.group, best.score, best.id)], names=["g", "score", "id"])

        merged = Window.partitionBy("g").orderBy(F.desc("score"), "id")
        found = candidates.mapInArrow(run, "g long, score long, id long")
        return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)

    out = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        vectors = np.concatenate([x for x in (c.flatten().to_numpy(zero_copy_only=False) for c in part.column("v").chunks)]).reshape(-1, dim)
        block = Block(part.column("id").to_numpy(), part.column("label").to_numpy(), np.floor(vectors * scale))
        first = pass_over(spark.sparkContext.broadcast(block), positives_of, len(block.ids), positives).toArrow()
        anchor, rank, score, found = (first.column(c).to_numpy() for c in ("g", "rank", "score", "id"))
        block.windows(anchor, rank - 1, score, positives, low, high)
        second = pass_over(spark.sparkContext.broadcast(block), negatives_of, len(block.ids) * positives, negatives)
        # bounded like the block: one row per anchor and positive
        kept = pa.table({"g": anchor * positives + rank - 1, "anchor_id": block.ids[anchor], "positive_id": found, "positive_rank": rank.astype(np.int32), "positive_score": score})
        out.append(second.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(spark.createDataFrame(kept)), "g"))
    if not out:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, out).select(*(c.split()[0] for c in schema.split(", ")))


def scores_by_rank(mined: DataFrame) -> DataFrame:
    """(positive_rank, rank, n, mean of negative over positive score): how hard the negatives are, for choosing the window."""
    share = F.col("negative_score") / F.col("positive_score")
    return mined.groupBy("positive_rank", "rank").agg(F.count("*").alias("n"), F.avg(share).alias("share"))
