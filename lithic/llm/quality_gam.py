"""Quality by a generalised additive model with pairwise interactions.

Each text becomes a few numbers (`features`). Every number is cut into quantile bins; cyclic boosting visits feature
after feature, fits a shallow tree to the gradients per bin and adds it to that feature's lookup table. Then the pairs
of features that explain most of what is left get tables over coarser bins, boosted likewise. A score is the sum of
one table entry per feature and per pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import labelled_sample, ship, text_or_empty, unused, with_columns_of_text

ship(__name__)

#: Labelled rows that training may read.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAF_L2, LEAVES = 120, 60, 0.15, 3.0, 4
NAMES = (
    "chars", "words", "word_chars", "upper", "digits", "symbols", "exclaims", "odd_symbols", "bars", "lines", "line_chars",
    "distinct_words", "distinct_trigrams", "distinct_lines", "longest_word", "dots",
)


def features(text: str) -> tuple[float, ...]:
    """Numbers of one text, in the order of NAMES; all zero but for the counts' logarithms if it is empty."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = len(text) or 1, len(words) or 1
    upper, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
    letters = upper + int(counts[97:123].sum()) + int(counts[192:].sum())
    symbols = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    odd = int(sum(counts[c] for c in b"#$%&*<>=@\\^_{}~"))
    trigrams = max(len(words) - 2, 1)
    return (
        np.log1p(len(text)), np.log1p(len(words)), (len(text) - int(counts[32])) / m, upper / max(letters, 1), digits / n, symbols / n, counts[33] / n, odd / n, counts[124] / n, len(lines) / n, np.log1p(len(text) / max(len(lines), 1)),
        len(set(words)) / m, len(set(zip(words, words[1:], words[2:]))) / trigrams if len(words) > 2 else 1.0, len(set(lines)) / max(len(lines), 1), np.log1p(max(map(len, words), default=0)), counts[46] / n,
    )


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, k], "right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out


def _tree(gradients: np.ndarray, hessians: np.ndarray) -> np.ndarray:
    """Best-first tree over ordered bins: leaf values per bin."""
    value = lambda g, h: -g / (h + LEAF_L2)
    gain = lambda g, h: g * g / (h + LEAF_L2)
    leaves = [(0, len(gradients))]
    sums_g, sums_h = np.concatenate(([0], np.cumsum(gradients))), np.concatenate(([0], np.cumsum(hessians)))
    while len(leaves) < LEAVES:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(leaves):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                left_g, left_h = sums_g[cut] - sums_g[a], sums_h[cut] - sums_h[a]
                all_g, all_h = sums_g[b] - sums_g[a], sums_h[b] - sums_h[a]
                better = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
                at = int(better.argmax())
                if better[at] > best[0]:
                    best = (float(better[at]), k, int(cut[at]))
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradients))
    for a, b in leaves:
        out[a:b] = value(sums_g[b] - sums_g[a], sums_h[b] - sums_h[a])
    return out


def _quadrants(gradients: np.ndarray, hessians: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of a grid into four by one row and one column cut: its gain, and the values per cell."""
    g, h = (np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for x in (gradients, hessians))
    best, out = 0.0, np.zeros_like(gradients)
    rows, columns = gradients.shape
    parts = lambda s, r, c: (s[r, c], s[r, columns] - s[r, c], s[rows, c] - s[r, c], s[rows, columns] - s[r, columns] - s[rows, c] + s[r, c])
    for r in range(1, rows):
        for c in range(1, columns):
            four_g, four_h = np.array(parts(g, r, c)), np.array(parts(h, r, c))
            gain = float((four_g**2 / (four_h + LEAF_L2)).sum())
            if gain > best:
                values = -four_g / (four_h + LEAF_L2)
                best, out = gain, np.zeros_like(gradients)
                out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:] = values
    return best, out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Without rows of both labels: the smoothed base rate, whatever the text."""
    n, positive = len(y), int(y.sum())
    rate = (positive + 1) / (n + 2)
    model = Model(float(np.log(rate / (1 - rate))), [], [], [], [])
    if not 0 < positive < n:
        return model
    cut = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    model.edges, model.coarse = [cut(v, BINS) for v in x.T], [cut(v, PAIR_BINS) for v in x.T]
    bins = [np.searchsorted(e, v, "right") for e, v in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(n, model.base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(own, g, len(model.tables[k])), np.bincount(own, h, len(model.tables[k])))
            model.tables[k] += step
            z += step[own]
    coarse = [np.searchsorted(e, v, "right") for e, v in zip(model.coarse, x.T)]

    def grid(i, j):
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        cell, (g, h) = coarse[i] * shape[1] + coarse[j], slopes()
        return cell, *(np.bincount(cell, s, shape[0] * shape[1]).reshape(shape) for s in (g, h))

    worth = sorted(((-_quadrants(*grid(i, j)[1:])[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))[:PAIRS]
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for gain, i, j in worth if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            cell, g, h = grid(i, j)
            step = RATE * _quadrants(g, h)[1]
            table += step
            z += step.ravel()[cell]
    return model


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, remainder: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most `sample` labelled rows outside the held-out fold; only their numbers reach the driver."""
    rows = labelled_sample(docs, labels, label_col, modulus, remainder, sample, id_col, text_col)
    made = with_columns_of_text(rows, "text", lambda texts: [pa.array(_matrix(texts).tolist(), pa.list_(pa.float64()))], [("x", "array<double>")])
    found = made.select("id", "label", "x").toPandas().sort_values(["id", "label"], kind="stable")
    return train(np.array(found["x"].tolist()).reshape(-1, len(NAMES)), found["label"].to_numpy(dtype=np.float64))


def _scores(model: Model):
    return lambda texts: [pa.array(1 / (1 + np.exp(-np.clip(model.logits(_matrix(texts)), -500, 500))))]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double in 0..1) of every row. A null text counts as empty; empty texts are scored by their numbers.

    Repeated rows each get the same score; other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return with_columns_of_text(texts, "text", _scores(model), [("score", "double")]).select(id_col, "score")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score `threshold` or more, unchanged."""
    hidden = unused("__quality", docs)
    return with_columns_of_text(docs, text_col, _scores(model), [(hidden, "double")]).where(F.col(hidden) >= threshold).drop(hidden)
