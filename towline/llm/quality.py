"""Quality classifier: Bradley-Terry ranking of documents by logistic loss on feature differences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import held_out, labelled_sample, map_texts
from .text import Words, shingles

FEATURES = (
    "length", "word_length", "symbols", "bars", "shouts", "capitals", "digits", "stops", "stutter", "repeats", "distinct", "line_words",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&<>{}[]^~=_\\@+")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".?;:,")] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return np.diff(total[offsets]).astype(float)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a block, each between 0 and about 1. An empty text has zeros only."""
    words = Words(data, offsets)
    n_words = words.counts().astype(float)
    some = np.maximum(n_words, 1)
    letters = _sums(~np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)) & ((data & 0xC0) != 0x80), offsets)
    upper = _sums((data >= 65) & (data <= 90), offsets)
    lower = _sums((data >= 97) & (data <= 122), offsets)
    stutter, repeats, distinct = (np.zeros(len(n_words)) for _ in range(3))
    for d in range(len(n_words)):
        h = words.hash[words.first[d] : words.first[d + 1]]
        if len(h) < 2:
            continue
        stutter[d] = np.mean(h[1:] == h[:-1])
        distinct[d] = 1 - len(np.unique(h)) / len(h)
        grams = shingles(h, 5)
        if len(grams) > 1:
            repeats[d] = 1 - len(np.unique(grams)) / len(grams)
    rate = lambda mask: np.minimum(1, _sums(mask, offsets) / some)
    return np.stack([
        np.log1p(n_words) / 10, np.minimum(1, letters / some / 10), rate(_SYMBOLS[data]), rate(data == ord("|")),
        rate(data == ord("!")), upper / np.maximum(1, upper + lower), rate((data >= 48) & (data <= 57)), rate(_STOPS[data]),
        stutter, repeats, distinct, np.log1p(some / (1 + _sums(data == 10, offsets))) / 10,
    ], axis=1) * (n_words > 0)[:, None]


@dataclass(frozen=True)
class Ranking:
    """Weights of the features, and the score at which documents pass."""

    weights: np.ndarray
    cut: float
    at: float  # what a document on the cut scores after scaling

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(x @ self.weights - self.cut + np.log(self.at / (1 - self.at)), -35, 35)
        return 1 / (1 + np.exp(-z))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs_per_loser: int = 40, penalty: float = 1e-4, pass_at: float = 0.7) -> Ranking:
    """Weights w with P(a is preferred to b) = logistic(w . (x_a - x_b)), from pairs of a good and a bad document.

    Each bad document meets `pairs_per_loser` good ones, dealt in turn. Newton steps with a quadratic penalty run until
    the loss is stationary. The cut is the quantile of the training scores at the share of bad documents. Without
    documents of both kinds there is nothing to prefer: all documents pass.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(x.shape[1]), -1.0, pass_at)
    losers = np.repeat(bad, pairs_per_loser)
    winners = good[np.arange(len(losers)) * 7919 % len(good)]
    gap = x[winners] - x[losers]
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(np.clip(gap @ w, -35, 35)))  # chance of the other outcome
        slope = gap.T @ p / len(gap) - penalty * w
        if np.abs(slope).max() < 1e-8:
            break
        curve = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 10 / max(1e-12, np.abs(step).max()))
    scores = np.sort(x @ w)
    below = len(bad)  # the quantile at the share of bad documents
    return Ranking(w, float(scores[below - 1] + scores[below]) / 2, pass_at)


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, max_labelled: int = 20_000) -> Ranking:
    """Fit on at most `max_labelled` labelled documents outside the held-out part. Only their features reach the driver."""
    sample = labelled_sample(docs, labels, "quality", parts, part, max_labelled)
    rows = map_texts(sample, ["doc_id", "y"], lambda d, o: [*features(d, o).T], ", ".join(f"{c} double" for c in FEATURES))
    frame = rows.toPandas().sort_values("doc_id")
    return bradley_terry(frame[list(FEATURES)].to_numpy(float), frame["y"].to_numpy())


def score(docs: DataFrame, ranking: Ranking, keep: list[str], name: str = "score") -> DataFrame:
    """`keep` and a score of every text; NULL and empty texts score as a text with all features 0."""
    return map_texts(docs, keep, lambda d, o: [ranking.scores(features(d, o))], f"{name} double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`.

    Rows stay apart when repeated or when doc_id is NULL (then held_out); other columns are not read. An empty table
    gives an empty result.
    """
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, fit_on: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, with their columns, by a ranking fitted on `fit_on`."""
    scored = score(docs, fit(fit_on, labels), docs.columns, "__score")
    return scored.filter(F.col("__score") >= threshold).drop("__score")
