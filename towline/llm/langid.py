"""Language identification: a byte convolutional network over fixed-length windows.

Filters of widths 2, 3 and 4 over bytes, the maximum over the window, and a softmax. Each filter is a sum of one table
entry per byte of its width, so a convolution is a lookup, and pairs of bytes are looked up at once when predicting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import held_out, map_texts

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 8  # per width


@dataclass
class Network:
    """Tables of shape (width, 256, FILTERS) per width, and the softmax layer over all pooled filters."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each row of bytes; zero bytes are padding."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        parts = []
        for table, joint in zip(self.tables, self._joint()):
            width, n = len(table), windows.shape[1] - len(table) + 1
            total = joint[0][pairs[:, :n]]
            if width == 3:
                total += table[2][windows[:, 2 : 2 + n]]
            elif width == 4:
                total += joint[1][pairs[:, 2 : 2 + n]]
            parts.append(total.max(1))
        return np.maximum(np.concatenate(parts, 1) + self.bias, 0)

    def _joint(self) -> list[list[np.ndarray]]:
        if not hasattr(self, "_pairs"):
            both = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
            self._pairs = [[both(t[0], t[1])] + ([both(t[2], t[3])] if len(t) == 4 else []) for t in self.tables]
        return self._pairs

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages for each window."""
        z = self.pooled(windows) @ self.out + self.out_bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts of a block as rows of bytes, and which text each is from.

    Windows step by WINDOW - 3, so that no four neighbouring bytes are parted; the last one is padded with zeros.
    """
    step = WINDOW - max(WIDTHS) + 1
    sizes = np.diff(offsets)
    numbers = np.where(sizes > 0, -(-np.maximum(sizes - (WINDOW - step), 1) // step), 0)
    text = np.repeat(np.arange(len(sizes)), numbers)
    order = np.arange(len(text)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
    starts = offsets[:-1][text] + order * step
    limit = offsets[1:][text]
    at = starts[:, None] + np.arange(WINDOW)
    held = at < limit[:, None]
    padded = np.where(held, np.append(data, np.uint8(0))[np.where(held, at, len(data))], 0)
    return padded.astype(np.uint8), text


def train(
    windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7
) -> Network:
    """Adam on the mean cross-entropy of windows; gradients pass only through the position that holds each maximum."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages, [rng.normal(0, 0.5, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    params = [*net.tables, net.bias, net.out, net.out_bias]
    first, second, steps = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), batch):
            x, y = windows[order[low : low + batch]], labels[order[low : low + batch]]
            tops, places = [], []
            for table in net.tables:
                n = x.shape[1] - len(table) + 1
                total = sum(table[o][x[:, o : o + n]] for o in range(len(table)))
                places.append(total.argmax(1))
                tops.append(total.max(1))
            hidden = np.concatenate(tops, 1) + net.bias
            act = np.maximum(hidden, 0)
            z = act @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (hidden > 0)
            grads = []
            for k, (table, place) in enumerate(zip(net.tables, places)):
                own, g = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(table)
                rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
                for o in range(len(table)):
                    np.add.at(g[o], (x[rows, place + o], np.broadcast_to(cols, place.shape)), own)
                grads.append(g)
            grads += [back.sum(0), act.T @ p, p.sum(0)]
            steps += 1
            for value, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


def fit(docs: DataFrame, parts: int = 4, part: int = 2, max_texts: int = 4_000, max_windows: int = 12_000) -> Network | None:
    """Learn from at most `max_texts` texts with a language outside the held-out part, and `max_windows` of their windows.

    Texts are shared out evenly among languages, those with the least hash of their id first. None without any.
    """
    usable = docs.select("doc_id", "lang", "text").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"), parts, part))
    # One row per language, and about how many documents it has.
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    if not sizes:
        return None
    share = max(1, min(1000, max_texts // len(sizes)))
    # A document can only be among the first of its language if its hash is low. Below these limits are four times as many as are
    # wanted, and some more, so that a frequent language makes no large task.
    limits = [(r["lang"], -(1 << 63) + min((1 << 64) - 1, (4 * share + 64) * (1 << 64) // max(1, r["n"]))) for r in sizes]
    limits = usable.sparkSession.createDataFrame(limits, "lang string, __limit bigint")
    low = usable.select("doc_id", "lang").join(F.broadcast(limits), "lang").filter(F.xxhash64("doc_id") <= F.col("__limit"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = low.select("doc_id", "lang").distinct().withColumn("__rank", rank).filter(F.col("__rank") <= share).select("doc_id", "lang")
    # At most max_texts ids, or one per language: safe to broadcast at any size of the corpus.
    sample = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    each = max(1, max_windows // max_texts)

    def some_windows(data, offsets):
        x, text = windows_of(data, offsets)
        out = [[] for _ in range(len(offsets) - 1)]
        for d in range(len(out)):
            own = np.flatnonzero(text == d)
            out[d] = [x[i].tobytes() for i in own[np.linspace(0, len(own) - 1, min(each, len(own))).astype(int)]]
        return [out]

    rows = map_texts(sample, ["doc_id", "lang"], some_windows, "w array<binary>").toPandas().sort_values("doc_id")
    windows = np.stack([np.frombuffer(w, np.uint8) for ws in rows["w"] for w in ws])
    languages = sorted(set(rows["lang"]))
    labels = np.array([languages.index(lang) for lang, ws in zip(rows["lang"], rows["w"]) for _ in ws])
    return train(windows, labels, languages)


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs`.

    A text's score is the mean log-probability of its windows, weighted by their bytes, as a probability. Texts that are
    NULL or have no letter are `und` with score 1; so are all if there is nothing to learn from. Rows stay apart when
    repeated or when doc_id is NULL (then held_out). An empty table gives an empty result.
    """
    net = fit(docs)

    def guess(data, offsets):
        x, text = windows_of(data, offsets)
        n = len(offsets) - 1
        if net is None:
            return [np.array(["und"] * n, object), np.ones(n)]
        total, weight = np.zeros((n, len(net.languages))), np.zeros(n)
        for low in range(0, len(x), 512):
            part, own = x[low : low + 512], text[low : low + 512]
            size = np.count_nonzero(part, axis=1)
            np.add.at(total, own, net.log_odds(part) * size[:, None])
            np.add.at(weight, own, size)
        mean = total / np.maximum(weight, 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True, initial=-1e9))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [np.array(net.languages, object)[best], p[np.arange(n), best]]

    source = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    scored = map_texts(source, ["doc_id", "__letters"], guess, "lang_pred string, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        F.when(F.col("__letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("__letters"), F.col("score")).otherwise(1.0).alias("score"),
    )
