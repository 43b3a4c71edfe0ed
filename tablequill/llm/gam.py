"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text are binned; cyclic boosting visits one feature after the
other and adds a small step of a shallow tree on its bins to that feature's
lookup table, then does the same for the pairs of features whose residuals
interact most. A score is a sum of table entries per bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablequill.llm import labelled, measures

FEATURES = [
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "distinct",
    "ends", "short_words", "digits", "wide", "longest", "words_per_line",
]
# Labelled documents the model is fitted on, at most about so many.
TRAINING_ROWS = 30_000
BINS = 32
PAIR_BINS = 8
LEAVES = 4


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; an empty or NULL text has 0 throughout."""
    m = {c: v.astype(np.float64) for c, v in measures.measure(texts).items()}
    words, letters = np.maximum(m["n_words"], 1), np.maximum(m["n_upper"] + m["n_lower"], 1)
    lines = np.maximum(m["n_lines"], 1)
    return np.column_stack([
        np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words,
        m["n_dup_lines"] / lines, m["n_repeat_words"] / words, m["n_upper"] / letters,
        m["n_marks"] / words, m["n_window_words"] / words, m["n_ends"] / words,
        m["n_short_words"] / words, m["n_digits"] / words, m["n_wide"] / words,
        np.log1p(m["longest_word"]), np.log1p(m["n_words"] / lines),
    ])


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin limits at quantiles of the distinct values, so that rare extremes get bins."""
    spread = np.quantile(values, np.linspace(0, 1, bins // 2 + 1)[1:-1])
    extremes = np.quantile(np.unique(values), np.linspace(0, 1, bins // 2 + 1)[1:-1])
    return np.unique(np.concatenate([spread, extremes]))


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right")
                  for pair in self.pairs for j in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[coarse[a], coarse[b]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _best_split(grad: np.ndarray, hess: np.ndarray, lo: int, hi: int, ridge: float):
    """(gain, bin) of the best cut of the bins lo..hi-1."""
    g, h = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi])
    if len(g) < 2:
        return 0.0, lo
    left = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
    best = int(np.argmax(left))
    return float(left[best] - g[-1] ** 2 / (h[-1] + ridge)), lo + best + 1


def _tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """Step per bin of a tree of at most LEAVES leaves, grown by largest gain."""
    leaves = [(0, len(grad))]
    for _ in range(LEAVES - 1):
        splits = [(*_best_split(grad, hess, lo, hi, ridge), lo, hi) for lo, hi in leaves]
        gain, cut, lo, hi = max(splits)
        if gain <= 1e-9:
            break
        leaves.remove((lo, hi))
        leaves += [(lo, cut), (cut, hi)]
    step = np.empty(len(grad))
    for lo, hi in leaves:
        step[lo:hi] = grad[lo:hi].sum() / (hess[lo:hi].sum() + ridge)
    return step


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best of: one cut of the rows, then one cut of the columns on each side (or the reverse)."""
    best = (-1.0, np.zeros_like(grad))
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        for cut in range(1, len(g)):
            step, gain = np.zeros_like(g), 0.0
            for part in (slice(0, cut), slice(cut, len(g))):
                gs, hs = g[part].sum(0), h[part].sum(0)
                _, at = _best_split(gs, hs, 0, len(gs), ridge)
                for side in (slice(0, at), slice(at, len(gs))):
                    total, weight = gs[side].sum(), hs[side].sum() + ridge
                    step[part, side] = total / weight
                    gain += total**2 / weight
            if gain > best[0]:
                best = (gain, step.T if flip else step)
    return best


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, n_pairs: int = 4,
    pair_rounds: int = 40, ridge: float = 5.0,
) -> Model:
    """Without examples, or with one class only, the model is the (smoothed) share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    margin = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, at in enumerate(bins):
            grad, hess = slopes()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(at, grad, size), np.bincount(at, hess, size), ridge)
            model.tables[j] += step
            margin += step[at]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]

    def grids(a: int, b: int):
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        at = coarse[a] * shape[1] + coarse[b]
        grad, hess = slopes()
        n = shape[0] * shape[1]
        return at, np.bincount(at, grad, n).reshape(shape), np.bincount(at, hess, n).reshape(shape)

    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            _, grad, hess = grids(a, b)
            gains.append((_pair_tree(grad, hess, ridge)[0], a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [
        np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs
    ]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            at, grad, hess = grids(a, b)
            step = rate * _pair_tree(grad, hess, ridge)[1]
            model.pair_tables[k] += step
            margin += step.ravel()[at]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS,
          id_col: str = "doc_id", text: str = "text") -> Model:
    """Fit on about ``rows`` labelled documents (see ``labelled.training_labels``).

    The ids of the sample are broadcast (bounded by ``rows``), so the texts stay
    where they are; only FEATURES and the target of the sample reach the driver.
    """
    sample = F.broadcast(labelled.training_labels(labels, label, rows))
    found = (
        docs.select(F.col(id_col).alias("_label_id"), F.col(text).alias("_text"))
        .join(sample, "_label_id")
        .select("_label_id", "_target", _feature_column("_text").alias("_x"))
        # one row per id, however often it repeats
        .groupBy("_label_id", "_target").agg(F.min("_x").alias("_x"))
        .toPandas()
    )
    if len(found) == 0:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    # the order of rows decides the last bits of sums: make it the same on every run
    found = found.sort_values(["_label_id", "_target"], kind="stable")
    return fit(np.array(found["_x"].tolist()), found["_target"].to_numpy(np.float64))


def _features_udf(texts: pa.Array) -> pa.Array:
    x = features(texts)
    at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))


def _feature_column(text: str) -> Column:
    return F.arrow_udf(_features_udf, T.ArrayType(T.DoubleType()))(F.col(text))


def score(model: Model, text: str = "text") -> Column:
    """Probability of label 1 of a text; empty and NULL texts get that of no features."""

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(features(texts)))

    return F.arrow_udf(scored, T.DoubleType())(F.col(text))


def op10_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return docs.select(
        "doc_id", labelled.held_out("doc_id").alias("held_out"), score(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
