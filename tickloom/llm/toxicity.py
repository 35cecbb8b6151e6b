"""Toxicity scores by weak supervision.

Many voters look at a text. Lexicon voters are mined words and word beginnings, which vote
"toxic" if the text has them often enough, for its length or at all; pattern voters look at
shouting, masked words and the like. The voters are noisy and overlap. Words that are mined on
one fold of the labelled texts vote on the other fold. There a generative label model
estimates how each voter votes in toxic and clean texts: voters that agree more than the
classes explain are put into one cluster, and a cluster's number of votes has a distribution of
its own in each class, so that correlated voters are not counted twice. Expectation
maximisation begins with the rates of the fold that the words were mined on, goes on over the
votes of the other fold without its labels, and gives each of its texts the probability of being
toxic. A linear classifier is trained on those probabilities.

Mining counts terms in Spark, summed before the shuffle; the sample is bounded by
``max_rows``, and only its votes of a few dozen voters reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import short_batches, table
from tickloom.llm.labelled import MAX_LABELLED, held_out, labelled_sample

THRESHOLD = 0.5
VOTERS = 160
BEGINNINGS = (4, 5, 6)
#: Times per text, and times in a hundred words, that make a voter vote.
TIMES, RATES = (1, 2), (1.0, 3.0)
LEAST_TOXIC = 6
CORRELATED = 0.8
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")
#: Pattern voters: each votes if it matches at least so often.
PATTERN_VOTERS = [
    (re.compile(r"[!?]{2,}"), 1),
    (re.compile(r"!"), 3),
    (re.compile(r"\b[A-Z]{3,}\b"), 2),
    (re.compile(r"(?<![A-Za-z])[A-Za-z]++[*@#$]++[A-Za-z]"), 1),
    (re.compile(r"([A-Za-z])\1{3,}"), 1),
]


def words_of(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def term_counts(words: Counter[str]) -> Counter[str]:
    """Times that each word ("=word") and each longer word's beginning ("begin*") occurs."""
    out: Counter[str] = Counter()
    for w, n in words.items():
        out["=" + w] += n
        for k in BEGINNINGS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def votes(n: int, total: int) -> list[bool]:
    """Whether n occurrences among ``total`` words reach each of the levels."""
    return [n >= t for t in TIMES] + [100 * n >= r * total and n >= 2 for r in RATES]


LEVELS = len(TIMES) + len(RATES)


def mine_terms(sample: DataFrame, max_voters: int = VOTERS) -> list[tuple[str, int]]:
    """(term, level) of the voters that tell toxic from clean labelled texts best."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for text, y in zip(batch["text"], batch["y"]):
                words = words_of(text)
                total = sum(words.values())
                for term, n in term_counts(words).items():
                    row = sums.setdefault(term, [0] * (2 * LEVELS))
                    for k, vote in enumerate(votes(n, total)):
                        row[2 * k + int(y)] += vote
            if sums:
                yield pd.DataFrame({"term": list(sums), "n": list(sums.values())})

    clean, toxic = (int(sample.agg(F.coalesce(F.sum((F.col("y") == v).cast("int")), F.lit(0))).first()[0]) for v in (0, 1))
    counted = sample.select("text", "y").mapInPandas(count, "term string, n array<bigint>")
    sums = counted.groupBy("term").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(2 * LEVELS)])
    ratings = []
    for k in range(LEVELS):
        bad, good = F.col(f"n{2 * k + 1}"), F.col(f"n{2 * k}")
        odds = F.log(((bad + 0.5) / (toxic + 1)) / ((good + 0.5) / (clean + 1)))
        ratings.append(F.struct(F.when((bad >= LEAST_TOXIC) & (odds >= 2), bad * (odds - 1)).otherwise(0.0).alias("worth"), F.lit(k).alias("level")))
    best = sums.select("term", F.array_max(F.array(*ratings)).alias("best")).where(F.col("best.worth") > 0)
    rows = best.orderBy(F.desc("best.worth"), "term").limit(max_voters).collect()
    return sorted((r["term"], r["best"]["level"]) for r in rows)


class Counters:
    """Votes and features of texts for given voters."""

    def __init__(self, terms: list[tuple[str, int]]):
        self.terms = terms
        self.numbers: dict[str, int] = {}
        for term, _ in terms:
            self.numbers.setdefault(term, len(self.numbers))
        self.known: dict[str, tuple[int, ...]] = {}

    def hits(self, word: str) -> tuple[int, ...]:
        if (found := self.known.get(word)) is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            mine = ["=" + word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]
            found = self.known[word] = tuple(self.numbers[t] for t in mine if t in self.numbers)
        return found

    def row(self, text: str | None) -> list[float]:
        """A vote for each voter, patterns last; then features of all hits together: words hit, their number and their share."""
        words = words_of(text)
        counts, hit, kinds = [0] * len(self.numbers), 0, 0
        for w, n in words.items():
            if found := self.hits(w):
                hit += n
                kinds += 1
                for t in found:
                    counts[t] += n
        total = sum(words.values())
        cast = [float(votes(counts[self.numbers[term]], total)[level]) for term, level in self.terms]
        cast += [float(sum(1 for _ in islice(p.finditer(text or ""), least)) >= least) for p, least in PATTERN_VOTERS]
        return [*cast, np.log1p(hit), np.log1p(kinds), min(1.0, 10 * hit / max(total, 10)), np.log1p(total) / 10]


def clusters_of(correlations: np.ndarray) -> np.ndarray:
    """Cluster of each voter: voters whose votes correlate within a class are joined."""
    m = len(correlations)
    link = correlations > CORRELATED
    label = np.arange(m)
    while True:
        after = np.minimum(label, np.where(link, label[None, :], m).min(axis=1, initial=m))
        if (after == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = after


def correlations_of(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Larger one of two voters' correlations within toxic and within clean texts, by the probabilities ``p`` of toxic."""
    out = np.full((v.shape[1], v.shape[1]), -1.0)
    for weight in (p, 1 - p):
        if weight.sum() > 2:
            centred = v - weight @ v / weight.sum()
            both = (centred * weight[:, None]).T @ centred / weight.sum()
            spread = np.sqrt(np.diag(both))
            out = np.maximum(out, both / np.maximum(np.outer(spread, spread), 1e-3))
    return out


@dataclass
class LabelModel:
    """What expectation maximisation has found about the texts of one fold from their votes alone."""

    posterior: np.ndarray  # probability of toxic, by row
    toxic_rates: np.ndarray  # share of toxic texts in which a voter votes
    clean_rates: np.ndarray
    correlations: np.ndarray
    clusters: np.ndarray

    @classmethod
    def fit(cls, mined: np.ndarray, mined_y: np.ndarray, v: np.ndarray, rounds: int = 10, most: int = 5) -> LabelModel:
        """From the votes and labels of the fold that the voters were mined on, and the votes of another fold.

        Clusters, and first rates of their numbers of votes in either class, come from the mined
        fold, whose share of toxic texts is taken for the other one too. Rates are then estimated
        over both folds, a text of the other one counting by its probability. Labels of the
        texts whose votes are ``v`` take no part.
        """
        correlations = correlations_of(mined, mined_y.astype(float))
        clusters = clusters_of(correlations)
        number = range(clusters.max(initial=-1) + 1)
        counted = [tuple(np.minimum(z[:, clusters == c].sum(axis=1).astype(int), most) for z in (mined, v)) for c in number]
        known = [tuple(np.bincount(x, w, most + 1) + 0.5 for w in (mined_y, 1 - mined_y)) for x, _ in counted]
        share = float(np.clip(mined_y.mean(), 0.005, 0.5))
        p = np.zeros(len(v))
        for n in range(rounds + 1):
            odds = np.full(len(v), np.log(share / (1 - share)))
            for (_, x), (bad, good) in zip(counted, known):
                if n:
                    bad, good = bad + np.bincount(x, p, most + 1), good + np.bincount(x, 1 - p, most + 1)
                odds += np.log(bad / bad.sum() / (good / good.sum()))[x]
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        rates = [(w @ v + 0.1) / (w.sum() + 0.2) for w in (p, 1 - p)]
        return cls(p, rates[0], rates[1], correlations, clusters)


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and intercept of a logistic model of soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty), x.T @ (p - q) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, max_voters: int = VOTERS) -> tuple[list[tuple[str, int]], np.ndarray]:
    """Voters and weights, from ``labels.toxic`` of at most ``max_rows`` labelled texts outside the held-out fold.

    The sample has two folds. Words mined on one of them vote on the other, whose labels the label
    model does not see; the classifier has the voters of both and learns from the probabilities
    of both, never from labels, unless one fold is empty. Without labelled rows all scores are
    0.5; with clean ones only, only patterns vote.
    """
    sample = labelled_sample(docs, labels, "toxic", max_rows).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int"))
    by_fold = [mine_terms(sample.where(F.col("fold") == k), max_voters) for k in (0, 1)]
    terms = sorted(set(by_fold[0]) | set(by_fold[1]))
    rows = sorted(tuple(r) for r in sample.select("doc_id", "y", "fold", _row_udf(terms)("text").alias("x")).collect())
    width = len(Counters(terms).row(""))
    if not rows:
        return terms, np.zeros(width + 1)
    x, y, fold = np.array([r[3] for r in rows], dtype=float), np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows])
    return terms, fit_linear(x, cross_fitted(x, y, fold, terms, by_fold))


def cross_fitted(x: np.ndarray, y: np.ndarray, fold: np.ndarray, terms: list[tuple[str, int]], by_fold: list[list[tuple[str, int]]]) -> np.ndarray:
    """Probability of toxic of each text by the votes of the voters that the other fold has chosen, without its own label."""
    p = y.astype(float)
    patterns = range(len(terms), len(terms) + len(PATTERN_VOTERS))
    for k in (0, 1):
        mine = [terms.index(t) for t in by_fold[k]] + [*patterns]
        if (fold == k).any() and (fold != k).any():
            p[fold != k] = LabelModel.fit(x[fold == k][:, mine], y[fold == k], x[fold != k][:, mine]).posterior
    return p


def _row_udf(terms: list[tuple[str, int]]):
    @pandas_udf("array<double>")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counters = Counters(terms)
        for texts in batches:
            yield pd.Series([counters.row(t) for t in texts], dtype=object)

    return rows


def scorer(terms: list[tuple[str, int]], weights: np.ndarray):
    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counters = Counters(terms)
        for texts in batches:
            x = np.array([[*counters.row(t), 1.0] for t in texts]).reshape(-1, len(weights))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return score


def score_toxicity(docs: DataFrame, terms: list[tuple[str, int]], weights: np.ndarray, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the score in ``into``, which must be new. Null and empty texts have no words and no votes."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    short_batches(docs.sparkSession)
    return docs.withColumn(into, scorer(terms, weights)(F.col(text_col)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document's whole text, whether it is held out, and the prediction; null and empty texts have no words."""
    short_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms, weights = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, terms, weights, into="score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
