"""Toxicity: maximum-scoring segments over token log-odds.

Each word of the labelled sample scores its log-odds of standing in a toxic rather than a clean document, under a
Dirichlet prior that leans on the words with the same beginning, less a margin for the uncertainty of few counts; a word
that the sample lacks scores as its beginning does. One linear scan finds all disjoint maximal segments of a text.
Extreme-value statistics of segment scores in clean texts tell which are significant, and the surprise of a text's
significant segments is turned into a probability. Both are fitted with every text of the sample scored as if it had
not been counted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.session import cut, drop

from .frames import held_out, labelled_sample, map_texts
from .text import LETTERS, Words, blocks

HEAD_BYTES = 4
PRIOR = 8.0  # pseudo-counts of the Dirichlet prior of a word
LEAST_PRIOR = 0.5  # pseudo-counts of either kind at least, however clear the beginning is
MARGIN = 2.0  # standard errors taken off a log-odds of either sign


def _token_counts(sample: DataFrame) -> DataFrame:
    """(word, head, toxic, clean): numbers of texts that hold a word, by hashes of the word and of its beginning."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                words = Words(data, offsets, LETTERS)
                label = np.asarray(batch.column("y").slice(rows.start, rows.stop - rows.start))
                text = np.repeat(np.arange(len(offsets) - 1), words.counts())
                pair, at = np.unique(np.stack([words.hash, text.astype(np.uint64)]), axis=1, return_index=True)
                h, y = pair[0].astype(np.int64), label[text[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(words.heads(HEAD_BYTES)[at].astype(np.int64)), pa.array(y.astype(np.int64)), pa.array((1 - y).astype(np.int64))],
                    names=["word", "head", "toxic", "clean"],
                )

    rows = sample.select("y", "text").mapInArrow(run, "word bigint, head bigint, toxic bigint, clean bigint")
    return rows.groupBy("word", "head").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Lexicon:
    """Numbers of toxic and clean texts by sorted hash of words and of beginnings, and the calibration of segments.

    `up` and `down` weigh toxic and clean texts so that both kinds count alike.
    """

    words: np.ndarray
    word_counts: np.ndarray
    heads: np.ndarray
    head_counts: np.ndarray
    up: float = 1.0
    down: float = 1.0
    shift: float = 0.0
    decay: float = 1.0
    density: float = 1.0
    weights: tuple[float, float] = (0.0, 1.0)

    def _head_scores(self, counts: np.ndarray) -> np.ndarray:
        half = np.full(len(counts), 0.5)
        return _log_odds(counts[:, 0] * self.up, counts[:, 1] * self.down, half)

    def _scores(self, words: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """From the (toxic, clean) counts of each token's word and beginning."""
        toxic, clean = heads[:, 0] * self.up, heads[:, 1] * self.down
        by_head = self._head_scores(heads)
        by_word = _log_odds(words[:, 0] * self.up, words[:, 1] * self.down, (toxic + PRIOR) / (toxic + clean + 2 * PRIOR))
        # A word never met in a clean text is as toxic as its beginning at least.
        by_word = np.where(words[:, 1] == 0, np.maximum(by_word, by_head), by_word)
        return np.where(words.any(1), by_word, by_head) - self.shift

    def token_scores(self, words: Words, labels: np.ndarray | None = None) -> np.ndarray:
        """Scores of tokens; with a label for each token, as if its text had not been counted."""
        own, begin = _counts(self.words, self.word_counts, words.hash), _counts(self.heads, self.head_counts, words.heads(HEAD_BYTES))
        if labels is not None:
            mine = np.stack([labels, 1 - labels], 1)
            own, begin = np.maximum(own - mine, 0), np.maximum(begin - mine, 0)
        return self._scores(own, begin)

    def surprise(self, segments: list[tuple[int, int, float]], n_words: int) -> tuple[float, int]:
        """Sum of -log E over segments with an expected number E below 1 in clean text of this length, and how many they are."""
        found = [s for s in (self.decay * x - np.log(self.density * max(n_words, 1)) for _, _, x in segments) if s > 0]
        return float(sum(found)), len(found)

    def probability(self, surprise: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * np.sqrt(surprise), -35, 35)))


def _log_odds(toxic: np.ndarray, clean: np.ndarray, share: np.ndarray) -> np.ndarray:
    a = toxic + np.maximum(PRIOR * share, LEAST_PRIOR)
    b = clean + np.maximum(PRIOR * (1 - share), LEAST_PRIOR)
    value = np.log(a / b)
    return np.sign(value) * np.maximum(0, np.abs(value) - MARGIN * np.sqrt(1 / (a + 1) + 1 / (b + 1)))


def _counts(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """(toxic, clean) of each wanted hash; zeros for those that are not there."""
    if not len(keys):
        return np.zeros((len(wanted), 2))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], counts[at], 0.0)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All disjoint maximal-scoring segments (start, end, score), left to right, in linear time.

    Cumulative sums before and after each positive score suffice. A new segment joins the nearest earlier one that
    starts lower whenever it also ends higher; otherwise it stands alone.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    after = np.cumsum(scores)
    ends, begins = after[positive].tolist(), (after[positive] - scores[positive]).tolist()
    open_: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier one that starts lower
    for at, low, high in zip(positive.tolist(), begins, ends):
        new = [at, at + 1, low, high, -1]
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= new[2]:
                j = open_[j][4]
            new[4] = j
            if j < 0 or open_[j][3] >= new[3]:
                open_.append(new)
                break
            joined = open_[j]
            new = [joined[0], new[1], joined[2], new[3], -1]
            del open_[j:]
    return [(a, b, high - low) for a, b, low, high, _ in open_]


def _scored(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray | None = None):
    """For each text: its segments and number of words. With labels, texts are scored as if they had not been counted."""
    words = Words(data, offsets, LETTERS)
    scores = lexicon.token_scores(words, None if labels is None else np.repeat(labels, words.counts()))
    for d in range(len(offsets) - 1):
        own = scores[words.first[d] : words.first[d + 1]]
        yield maximal_segments(own), len(own)


def _decay(scores: np.ndarray) -> float:
    """The positive root of mean(exp(x * score)) = 1 for scores with a negative mean and some positive ones."""
    if scores.max(initial=-1) <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while np.mean(np.exp(np.minimum(high * scores, 700))) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if np.mean(np.exp(np.minimum(middle * scores, 700))) < 1 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[float, float]:
    design, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        slope = design.T @ (y - p) / len(y) - penalty * w
        if np.abs(slope).max() < 1e-9:
            break
        w = w + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design / len(y) + penalty * np.eye(2), slope)
    return float(w[0]), max(float(w[1]), 1e-3)


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, max_labelled: int = 20_000) -> Lexicon:
    """Learn from at most `max_labelled` labelled documents outside the held-out part; equal texts count once.

    The driver gets one row per word and one per beginning of the sample, and three numbers per text of it: all bounded by the sample.
    """
    sample = labelled_sample(docs, labels, "toxic", parts, part, max_labelled).groupBy("text").agg(F.max("y").alias("y"))
    sample = cut(sample)
    counts = cut(_token_counts(sample))

    def ordered(key: str, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = rows.groupBy(key).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
        keys = table[key].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], table[["toxic", "clean"]].to_numpy(float)[order]

    heads = ordered("head", counts)
    toxic, clean = heads[1].sum(0) if len(heads[0]) else (0.0, 0.0)
    if not toxic or not clean:
        empty = np.zeros(0, np.uint64), np.zeros((0, 2))
        return Lexicon(*empty, *empty, shift=1.0, weights=(-3.0, 1.0))
    lexicon = Lexicon(*ordered("word", counts), *heads, up=(toxic + clean) / (2 * toxic), down=(toxic + clean) / (2 * clean))
    drop(counts)
    return _calibrated(sample, lexicon)


def _labelled_texts(sample: DataFrame, make, fields: str) -> DataFrame:
    """y and the arrays that `make(bytes, offsets, labels)` gives for a block of texts."""
    names = ["y", *(field.split()[0] for field in fields.split(","))]

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                y = batch.column("y").slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([y, *(pa.array(x) for x in make(data, offsets, y.to_numpy()))], names=names)

    return sample.select("y", "text").mapInArrow(run, f"y int, {fields}")


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Shift scores so that clean words average -1; then fit decay and density of clean segments, and the logistic."""

    def tokens(data, offsets, labels):
        words = Words(data, offsets, LETTERS)
        s = np.round(lexicon.token_scores(words, np.repeat(labels, words.counts())), 1)
        return [[s[words.first[d] : words.first[d + 1]].tolist() for d in range(len(offsets) - 1)]]

    clean = _labelled_texts(sample.filter("y = 0"), tokens, "s array<double>")
    bins = clean.select(F.explode("s").alias("s")).groupBy("s").count().toPandas()
    values, weight = bins["s"].to_numpy(float), bins["count"].to_numpy(float)
    lexicon.shift = float(np.average(values, weights=weight)) + 1.0
    lexicon.decay = _decay(np.repeat(values - lexicon.shift, np.maximum(1, np.round(weight / weight.sum() * 100_000)).astype(int)))

    def best(data, offsets, labels):
        found = list(_scored(lexicon, data, offsets, labels))
        return [np.array([max((s for *_, s in x), default=0.0) for x, _ in found], float), np.array([n for _, n in found], np.int64)]

    rows = _labelled_texts(sample, best, "best double, n bigint").toPandas()
    own = rows[rows["y"] == 0]
    lexicon.density = float(len(own) / max(1e-300, np.sum(np.maximum(own["n"], 1) * np.exp(-lexicon.decay * own["best"]))))

    def surprises(data, offsets, labels):
        return [np.array([lexicon.surprise(x, n)[0] for x, n in _scored(lexicon, data, offsets, labels)], float)]

    rows = _labelled_texts(sample, surprises, "x double").toPandas()
    lexicon.weights = _logistic(np.sqrt(rows["x"].to_numpy(float)), rows["y"].to_numpy(float))
    drop(sample)
    return lexicon


def toxic_passages(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per significant passage: doc_id, start and end in words, score, and expected number in clean text."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                out = []
                for d, (segments, n) in enumerate(_scored(lexicon, data, offsets)):
                    for a, b, x in segments:
                        expected = float(lexicon.density * n * np.exp(-lexicon.decay * x))
                        if expected < 1:
                            out.append((batch.column("doc_id")[rows.start + d].as_py(), a, b, x, expected))
                columns = list(zip(*out)) or [[]] * 5
                kinds = [batch.column("doc_id").type, pa.int32(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "score", "expected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start int, end int, score double, expected double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) for each row of `docs`.

    NULL and empty texts have no passage. Rows stay apart when repeated or when doc_id is NULL (then held_out); other
    columns are not read. Without labels of both kinds no text is toxic. An empty table gives an empty result.
    """
    lexicon = fit(docs, labels)

    def score(data, offsets):
        found = [lexicon.surprise(x, n) for x, n in _scored(lexicon, data, offsets)]
        return [lexicon.probability(np.array([x for x, _ in found], float)), np.array([k for _, k in found], np.int32)]

    scored = map_texts(docs, ["doc_id"], score, "score double, n_passages int")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages",
    )
