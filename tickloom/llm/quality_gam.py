"""Quality scores from an additive model with pairwise interactions.

Each feature of a text is cut into bins; the model is a lookup table for each feature and
for a few pairs of features, summed and squashed. Boosting visits the features in turn, and
each visit adds a shallow tree on that one feature to its table, so that no feature hides
behind another; then the pairs that explain most of what is left are boosted in the same way.

The fit runs on the driver over at most ``max_rows`` rows of ``FEATURES`` numbers; scoring is
one pass over the texts with a table look-up for each bin.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import short_batches, table
from tickloom.llm.labelled import MAX_LABELLED, held_out, labelled_sample

THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
FEATURES = (
    "log_words", "word_length", "distinct", "adjacent_repeats", "upper", "digits", "signs", "stops",
    "exclamations", "bars", "repeated_lines", "words_a_line", "high_bytes",
)

_SIGNS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", dtype=np.uint8)


def features(text: str | None) -> list[float]:
    """Numbers that describe a text's shape; all are 0 for null and empty texts."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size, distinct = raw.sum(), set(words)
    lines = [x for x in text.split("\n") if x]
    repeats = sum(map(operator.eq, words, words[1:]))
    return [
        float(np.log1p(n)),
        size / n,
        len(distinct) / n,
        repeats / n,
        raw[65:91].sum() / size,
        raw[48:58].sum() / size,
        raw[_SIGNS].sum() / n,
        (raw[44] + raw[46]) / n,
        raw[33] / n,
        raw[124] / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        raw[128:].sum() / size,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def tree_1d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with at most two splits, for sums of gradients and hessians per bin."""
    out = np.empty(len(g))

    def split(a: int, b: int, depth: int) -> None:
        G, H = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        gain = _gain(G[:-1], H[:-1]) + _gain(G[-1] - G[:-1], H[-1] - H[:-1]) - _gain(G[-1], H[-1])
        if depth == 0 or len(gain) == 0 or gain.max() <= 1e-9:
            out[a:b] = _leaf(G[-1], H[-1])
            return
        k = a + int(gain.argmax()) + 1
        split(a, k, depth - 1)
        split(k, b, depth - 1)

    split(0, len(g), 2)
    return out


def tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of the best cut into four quadrants, and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = -1.0, (0, 0)
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            q = [(G[i, j], H[i, j]), (G[i, -1] - G[i, j], H[i, -1] - H[i, j]), (G[-1, j] - G[i, j], H[-1, j] - H[i, j])]
            q.append((G[-1, -1] - sum(x for x, _ in q), H[-1, -1] - sum(x for _, x in q)))
            if (gain := sum(_gain(x, y) for x, y in q)) > best:
                best, at = gain, (i + 1, j + 1)
    out = np.zeros_like(g)
    for rows in (slice(0, at[0]), slice(at[0], None)):
        for cols in (slice(0, at[1]), slice(at[1], None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return out, best - _gain(g.sum(), h.sum())


class Gam:
    def __init__(self, edges, coarse, base, tables, pairs):
        self.edges, self.coarse, self.base, self.tables, self.pairs = edges, coarse, base, tables, pairs

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Gam:
        """With no rows, or one class only, the score is constant."""
        n_features = len(FEATURES)
        x = x.reshape(-1, n_features)

        def edges(bins):
            return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for f in range(n_features)]

        fine, coarse = edges(BINS), edges(PAIR_BINS)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        model = cls(fine, coarse, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in fine], [])
        if len(np.unique(y)) < 2:
            return model
        at, score = cls._binned(x, fine), np.full(len(y), model.base)
        for _ in range(ROUNDS):
            for f, lookup in enumerate(model.tables):
                p = _sigmoid(score)
                step = RATE * tree_1d(np.bincount(at[:, f], y - p, len(lookup)), np.bincount(at[:, f], p * (1 - p), len(lookup)))
                lookup += step
                score += step[at[:, f]]
        rough, p = cls._binned(x, coarse), _sigmoid(score)

        def cells(i, j, p):
            shape = len(coarse[i]) + 1, len(coarse[j]) + 1
            flat = rough[:, i] * shape[1] + rough[:, j]
            size = shape[0] * shape[1]
            return flat, np.bincount(flat, y - p, size).reshape(shape), np.bincount(flat, p * (1 - p), size).reshape(shape)

        gains = {(i, j): tree_2d(*cells(i, j, p)[1:])[1] for i, j in combinations(range(n_features), 2)}
        chosen = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
        model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in chosen]
        for _ in range(PAIR_ROUNDS):
            for i, j, lookup in model.pairs:
                flat, g, h = cells(i, j, _sigmoid(score))
                step = RATE * tree_2d(g, h)[0]
                lookup += step
                score += step.ravel()[flat]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        at = self._binned(x, self.edges)
        for f, lookup in enumerate(self.tables):
            total += lookup[at[:, f]]
        rough = self._binned(x, self.coarse)
        for i, j, lookup in self.pairs:
            total += lookup[rough[:, i], rough[:, j]]
        return _sigmoid(total)


def feature_udf():
    @pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t) for t in texts], dtype=object)

    return measure


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Gam:
    """Fits on ``labels.quality`` of at most ``max_rows`` labelled texts outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", max_rows)
    rows = sorted(tuple(r) for r in sample.select("doc_id", "y", feature_udf()("text").alias("x")).collect())
    return Gam.fit(np.array([r[2] for r in rows], dtype=float), np.array([r[1] for r in rows], dtype=float))


def scorer(model: Gam):
    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))

    return score


def score_quality(docs: DataFrame, model: Gam, text_col: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with the score in ``into``, which must be new. Null and empty texts are scored as having no words."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    short_batches(docs.sparkSession)
    return docs.withColumn(into, scorer(model)(F.col(text_col)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document's whole text, whether it is held out, and the prediction; null texts count as empty."""
    short_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, into="score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
