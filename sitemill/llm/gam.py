"""A quality classifier: a generalised additive model with pairs.

Each feature of a text is cut into bins. Boosting goes round the features,
always in the same order, fitting a shallow tree of the one feature's bins to
the residuals and adding a small step of it to the feature's lookup table; then
the pairs of features whose joint bins explain most of what is left are boosted
the same way, by trees of one cut in each. A text's score is the logistic of
the sum of what its bins look up.

Fitting takes at most ``SAMPLE`` labelled documents, drawn by a hash of their
id, on the driver; scoring is one narrow map over all whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextChunk
from .texts import FEATURES, features, held_out, map_texts

SAMPLE = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, STEP, LEAF = 32, 8, 150, 60, 6, 0.15, 20


@dataclass
class Model:
    """Cut points and lookup tables; all a score needs."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 of rows of features."""
        total = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Between different values at equal shares of the rows, so that equal
    values share a bin; a hump at one value leaves more cuts to the others."""
    values = np.unique(x)
    if len(values) <= 1:
        return np.zeros(0)
    at = np.unique(np.concatenate([np.quantile(x, np.arange(1, bins) / bins), np.quantile(values, np.arange(1, bins) / bins)]))
    i = np.unique(np.clip(np.searchsorted(values, at), 1, len(values) - 1))
    return (values[i - 1] + values[i]) / 2


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    G, H, N = g.sum(), h.sum(), n.sum()
    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
    gain = np.where((nl >= LEAF) & (N - nl >= LEAF), gain, -np.inf)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of each bin."""
    gain, cut = _best_cut(g, h, n) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut along one side with one cut across each half: its gain
    over no cut, and the values of the cells."""
    best, out = 0.0, np.full(g.shape, g.sum() / (h.sum() + 1))
    whole = g.sum() ** 2 / (h.sum() + 1)
    for turned in (False, True):
        G, H, N = (x.T if turned else x for x in (g, h, n))
        for i in range(1, len(G)):
            gain, value = -whole, np.empty(G.shape)
            for part in (slice(0, i), slice(i, None)):
                a, b, c = G[part].sum(0), H[part].sum(0), N[part].sum(0)
                more, cut = _best_cut(a, b, c)
                gain += a.sum() ** 2 / (b.sum() + 1) + more
                value[part] = _tree(a, b, c, 1) if cut else a.sum() / (b.sum() + 1)
            if gain > best:
                best, out = gain, value.T if turned else value
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits rows of features to labels 0 and 1. One kind of label alone, or
    none, gives a model of that rate."""
    n, k = x.shape if x.size else (0, len(FEATURES))
    rate = (float(y.sum()) + 0.5) / (n + 1)
    model = Model(float(np.log(rate / (1 - rate))), [np.zeros(0)] * k, [np.zeros(1)] * k)
    if n == 0 or y.min() == y.max():
        return model
    model.cuts = [_cut_points(x[:, j], BINS) for j in range(k)]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    total = np.full(n, model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, (b, table) in enumerate(zip(bins, model.tables, strict=True)):
            g, h = residuals()
            step = STEP * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), counts[j])
            table += step
            total += step[b]
    model.pair_cuts = [_cut_points(x[:, j], PAIR_BINS) for j in range(k)]
    wide = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    size = [len(c) + 1 for c in model.pair_cuts]

    def cells(a: int, b: int, w: np.ndarray | None) -> np.ndarray:
        return np.bincount(wide[a] * size[b] + wide[b], w, size[a] * size[b]).reshape(size[a], size[b])

    g, h = residuals()
    gains = sorted(((_quadrants(cells(a, b, g), cells(a, b, h), cells(a, b, None))[0], -a, -b) for a in range(k) for b in range(a + 1, k) if size[a] > 1 and size[b] > 1), reverse=True)
    model.pairs = [(-a, -b, np.zeros((size[-a], size[-b]))) for _, a, b in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = residuals()
            step = STEP * _quadrants(cells(a, b, g), cells(a, b, h), cells(a, b, None))[1]
            table += step
            total += step[wide[a], wide[b]]
    return model


def _features(chunk: TextChunk) -> list[pa.Array]:
    flat = np.array([features(t) for t in chunk.rows()]).reshape(-1)
    return [pa.FixedSizeListArray.from_arrays(pa.array(flat), len(FEATURES)).cast(pa.list_(pa.float64()))]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from labelled documents that are not held out, at most ``sample``
    label rows by the order of a hash of their id. Labels that are null or not
    0 or 1 are left out. The drawn labels number ``sample`` at most, so they
    are broadcast, and the features of that many rows go to the driver."""
    drawn = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    joined = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("own_id") == F.col("label_id"))
    got = map_texts(joined, ["own_id", "label"], "x array<double>", _features).select("kept.own_id", "kept.label", "x").orderBy(F.xxhash64("own_id"), "own_id", "label", "x").limit(sample).collect()
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in got], np.float64))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``kept`` (the columns of ``keep``) and ``score`` of every whole text; a
    null text scores as an empty one, and all empty texts alike. Rows are
    scored one by one: repeated rows repeat their score, equal scores are
    nothing to break, and an empty table gives none. A long text is read whole,
    its words in memory; ``kept`` is a struct, so no name can clash."""

    def work(chunk: TextChunk) -> list[pa.Array]:
        x = np.array([features(t) for t in chunk.rows()]).reshape(-1, len(FEATURES))
        return [pa.array(model.score(x))]

    return map_texts(docs, keep, "score double", work, text_col)
