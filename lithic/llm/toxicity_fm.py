"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and the first PREFIX letters of longer words (which joins inflected and compound forms),
each hashed to one of BUCKETS. From a bounded sample of labelled rows two kinds of buckets become features: those that
depend most on the label by themselves (chi-square), and those of the pairs that tell more about the label together
than each does alone, whatever each does alone. A second-order factorization machine on their presence is trained by
Adagrad. Its pairwise part, <v_i, v_j> for every two features of a text, learns that a term weighs more, or means the
opposite, beside another one.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import labelled_sample, ship, staged, text_or_empty, unstage, with_columns_of_text

ship(__name__)

BUCKETS = 1 << 18
PREFIX = 5
FEATURES = 1024
#: Buckets whose pairs are looked at: the most frequent of those in this share of the rows or more. Pairs that become
#: features, and the chi-square that they must have beyond that of their parts (the best of chance pairs has about 30).
SCREENED, OFTEN, PAIRS, GAIN = 4096, 0.005, 256, 40.0
RANK = 8
#: Labelled rows that training may read.
SAMPLE = 20_000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.1, 1e-4
#: Where Adagrad's sums of squares begin.
START = 1e-4
_WORD = re.compile(r"\w+")
#: Words whose buckets a task remembers before it starts anew.
_CACHE = 500_000


class Terms:
    """Buckets of texts; remembers the buckets of words it has seen. of: the only buckets that count, if given."""

    def __init__(self, of: np.ndarray | None = None):
        self.known: dict[str, tuple[int, ...]] = {}
        self.of = None if of is None else frozenset(of.tolist())

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= _CACHE:
            self.known.clear()
        own = (zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS,)
        if len(word) > PREFIX:
            own += (zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "replace")) % BUCKETS,)
        if self.of is not None:
            own = tuple(b for b in own if b in self.of)
        self.known[word] = own
        return own

    def __call__(self, text: str) -> set[int]:
        words, found = set(_WORD.findall(text.lower())), set()
        known = self.known.get
        for word in words:
            own = known(word)
            if own is None:
                own = self._of(word)
            if own:
                found.update(own)
        return found


@dataclass
class Machine:
    """bucket_of: feature number of each bucket or -1."""

    bucket_of: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, rows: list) -> np.ndarray:
        """Of texts given by their distinct buckets."""
        sizes = [len(r) for r in rows]
        own = self.bucket_of[np.fromiter((b for r in rows for b in r), dtype=np.int64, count=sum(sizes))]
        row = np.repeat(np.arange(len(rows)), sizes)[own >= 0]
        own = own[own >= 0]
        added = lambda x: np.bincount(row, x, len(rows))
        out = self.bias + added(self.weights[own])
        for factor in self.factors.T:
            out += 0.5 * (added(factor[own]) ** 2 - added(factor[own] ** 2))
        return out

    def logit(self, buckets: np.ndarray) -> float:
        return float(self.logits([np.unique(buckets)])[0])


def dependence(with_term: np.ndarray, with_both: np.ndarray, n: int, positive: int) -> np.ndarray:
    """Chi-square (one degree of freedom) of buckets and the label, from counts of texts with the bucket and of those with label 1."""
    expected = with_term * positive / n
    spread = expected * (1 - positive / n) * (1 - with_term / n)
    return np.where((with_term >= 3) & (with_term < n), (with_both - expected) ** 2 / np.maximum(spread, 1e-9), 0)


def choose(bucket: np.ndarray, with_term: np.ndarray, with_both: np.ndarray, n: int, positive: int) -> np.ndarray:
    """The FEATURES buckets that depend most on the label by themselves."""
    chi = dependence(with_term, with_both, n, positive)
    best = np.lexsort((bucket, -chi))[:FEATURES]
    return np.sort(bucket[best[chi[best] > 0]])


def screened(bucket: np.ndarray, with_term: np.ndarray, n: int) -> np.ndarray:
    """The buckets whose pairs are looked at."""
    often = np.flatnonzero((with_term >= max(3, OFTEN * n)) & (with_term < n))
    return np.sort(bucket[often[np.lexsort((bucket[often], -with_term[often]))[:SCREENED]]])


def _presence(rows: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    """Rows by `buckets` (sorted), 1 where a row has the bucket."""
    x = np.zeros((len(rows), len(buckets)), dtype=np.uint8)
    for k, own in enumerate(rows):
        at = np.minimum(np.searchsorted(buckets, own), max(len(buckets) - 1, 0)) if len(buckets) else np.zeros(0, np.int64)
        x[k, at[buckets[at] == own]] = 1
    return x


def paired(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, block: int = 256) -> np.ndarray:
    """The buckets of the PAIRS pairs that tell most about the label beyond what their parts tell, if that is GAIN or more.

    From the four cells of each pair: chi-square of the cells less that of either part. Pairs are looked at in blocks.
    """
    n, positive = len(rows), int(labels.sum())
    x, y = _presence(rows, buckets), labels.astype(np.float32)
    one, one_y = x.sum(axis=0, dtype=np.float64), np.zeros(len(buckets))
    for at in range(0, n, block):
        one_y += x[at : at + block][labels[at : at + block] > 0].sum(axis=0, dtype=np.float64)
    rate, alone = positive / n, dependence(one, one_y, n, positive)
    found: list[tuple[float, int, int]] = []
    for a in range(0, len(buckets), block):
        left = x[:, a : a + block].astype(np.float32)
        for b in range(a, len(buckets), block):
            right = x[:, b : b + block].astype(np.float32)
            both, both_y = (left.T @ right).astype(np.float64), ((left * y[:, None]).T @ right).astype(np.float64)
            i, j = np.arange(a, a + left.shape[1])[:, None], np.arange(b, b + right.shape[1])[None, :]
            cells = (
                (both, both_y), (one[i] - both, one_y[i] - both_y), (one[j] - both, one_y[j] - both_y),
                (n - one[i] - one[j] + both, positive - one_y[i] - one_y[j] + both_y),
            )
            chi = sum((z - m * rate) ** 2 / np.maximum(m * rate * (1 - rate), 1.0) for m, z in cells)
            gain = np.where((j > i) & (both >= 3), chi - alone[i] - alone[j], 0)
            for p, q in zip(*np.nonzero(gain >= GAIN)):
                found.append((-float(gain[p, q]), a + int(p), b + int(q)))
            found = sorted(found)[:PAIRS]
    return np.unique(buckets[[k for _, i, j in found for k in (i, j)]]) if found else buckets[:0]


def base_rate(n: int, positive: int) -> Machine:
    """The smoothed share of label 1, whatever the text."""
    rate = (positive + 1) / (n + 3)
    return Machine(np.full(BUCKETS, -1, dtype=np.int32), float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, RANK)))


def train(buckets: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Without rows of both labels: the base rate."""
    positive, n = int(labels.sum()), len(labels)
    if not 0 < positive < n:
        return base_rate(n, positive)
    with_term, with_both = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for own, label in zip(buckets, labels):
        with_term[own] += 1
        with_both[own] += label
    every = np.arange(BUCKETS)
    together = paired(buckets, labels, screened(every, with_term, n))
    return train_on(buckets, labels, np.union1d(choose(every, with_term, with_both, n, positive), together), seed)


def train_on(buckets: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, seed: int = 7) -> Machine:
    """Train on the presence of the chosen buckets; other buckets of the rows are ignored."""
    positive, n = int(labels.sum()), len(labels)
    bucket_of = np.full(BUCKETS, -1, dtype=np.int32)
    bucket_of[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), dtype=np.uint8)
    for k, own in enumerate(buckets):
        f = bucket_of[own]
        x[k, f[f >= 0]] = 1
    rng, y = np.random.default_rng(seed), labels.astype(np.float32)
    bias, w, v = float(np.log(positive / (n - positive))), np.zeros(len(chosen), np.float32), (rng.standard_normal((len(chosen), RANK)) * 0.01).astype(np.float32)
    sum_b, sum_w, sum_v = START, np.full_like(w, START), np.full_like(v, START)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            part = x[rows].astype(np.float32)
            s = part @ v
            z = bias + part @ w + 0.5 * ((s**2).sum(axis=1) - part @ (v**2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            through = part.T @ g
            grad_w = through + DECAY * w
            grad_v = part.T @ (g[:, None] * s) - through[:, None] * v + DECAY * v
            grad_b = float(g.sum())
            sum_b, sum_w, sum_v = sum_b + grad_b**2, sum_w + grad_w**2, sum_v + grad_v**2
            bias -= RATE * grad_b / sum_b**0.5
            w -= RATE * grad_w / np.sqrt(sum_w)
            v -= RATE * grad_v / np.sqrt(sum_v)
    return Machine(bucket_of, bias, w.astype(np.float64), v.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, remainder: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Train on at most `sample` labelled rows outside the held-out fold.

    The driver sees the counts per bucket (at most BUCKETS rows) and, of the sampled rows, the buckets that are chosen or
    whose pairs are looked at (at most FEATURES + SCREENED a row).
    """
    terms = Terms()
    rows = labelled_sample(docs, labels, label_col, modulus, remainder, sample, id_col, text_col)
    bucketed = with_columns_of_text(rows, "text", lambda texts: [pa.array([sorted(terms(t)) for t in texts], pa.list_(pa.int32()))], [("buckets", "array<int>")])
    kept = staged(bucketed.select("id", "label", "buckets"))
    total = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive")).first()
    if not 0 < total["positive"] < total["n"]:
        unstage(kept)
        return base_rate(total["n"], total["positive"])
    counts = kept.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").alias("both")).toPandas()
    number, n = counts["bucket"].to_numpy(), counts["n"].to_numpy(dtype=np.float64)
    chosen = choose(number, n, counts["both"].to_numpy(dtype=np.float64), total["n"], total["positive"])
    looked_at = screened(number, n, total["n"])
    own = F.array_intersect("buckets", F.array(*(F.lit(int(c)) for c in np.union1d(chosen, looked_at))))
    found = kept.select("id", "label", own.alias("own")).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    unstage(kept)
    label, own = found["label"].to_numpy(), found["own"].combine_chunks()
    rows = np.split(own.flatten().to_numpy(), own.value_lengths().to_numpy()[:-1].cumsum())
    return train_on(rows, label, np.union1d(chosen, paired(rows, label, looked_at)))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double in 0..1) of every row. Null and empty texts get the score of a text without terms.

    Repeated rows each get the same score; other columns are ignored; an empty table gives no rows.
    """
    terms = Terms(np.flatnonzero(machine.bucket_of >= 0))

    def make(texts):
        logits = machine.logits([terms(t) for t in texts])
        return [pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))))]

    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return with_columns_of_text(texts, "text", make, [("score", "double")]).select(id_col, "score")
