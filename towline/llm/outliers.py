"""Quality rules: base rules, and robust outliers among the documents of one language and source.

The verdict on a document that passes the base rules is the Mahalanobis distance of its transformed statistics from the
minimum-covariance-determinant estimate of its group. The estimate is found by concentration steps: distances under
the present estimate, the group's `share` quantile of them, then mean and covariance of the rows within. Each step is
an aggregate over all rows, so a group of any size is only ever summed.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.session import cut

from .frames import bounded, map_texts
from .text import Words, shingles

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
DIM = 5
# Least standard deviation of each transformed statistic: most documents of a group agree exactly on a rate of 0.
FLOORS = (0.3, 0.15, 0.05, 0.12, 0.12)
PRIOR_ROWS = 50.0  # a group's scatter counts as if so many rows with the pooled scatter had been added


def _repeat_words(h: np.ndarray) -> int:
    grams = shingles(h, 5)
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(h) + 1, int)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words = Words(data, offsets)
    n = len(offsets) - 1
    spaces = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    chars, symbols = total(~spaces & ((data & 0xC0) != 0x80)), total(_SYMBOL[data])
    dup, lines, repeat = (np.zeros(n, np.int64) for _ in range(3))
    for d in range(n):
        h = words.hash[words.first[d] : words.first[d + 1]]
        if len(h) > 5:
            repeat[d] = _repeat_words(h)
        if len(h):
            found = [x for x in data[offsets[d] : offsets[d + 1]].tobytes().split(b"\n") if x and not x.isspace()]
            lines[d], dup[d] = len(found), len(found) - len(set(found))
    return [words.counts().astype(np.int64), chars.astype(np.int64), symbols.astype(np.int64), dup, repeat, lines]


def _transformed() -> list[Column]:
    some = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(some), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / some), F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / some),
    ]


_X = [f"__x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_GROUP = ["__lang", "__source"]
_MODEL = ", ".join([f"__m{i} double" for i in range(DIM)] + [f"__p{i}{j} double" for i, j in _PAIRS] + ["__logdet double"])


def _distance() -> Column:
    gap = [F.col(x) - F.col(f"__m{i}") for i, x in enumerate(_X)]
    return sum((F.col(f"__p{i}{j}") * gap[i] * gap[j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _estimates(sums: DataFrame, pooled: np.ndarray | None) -> DataFrame:
    """Means, precision and log-determinant per group from its sums; `pooled` is the scatter added as PRIOR_ROWS rows."""

    def run(frames):
        for f in frames:
            out = f[_GROUP].copy()
            n = f["__n"].to_numpy(float)
            mean = np.stack([f[f"__s{i}"].to_numpy(float) / n for i in range(DIM)], 1)
            cov = np.empty((len(f), DIM, DIM))
            for i, j in _PAIRS:
                cov[:, i, j] = cov[:, j, i] = f[f"__q{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            cov = (cov * n[:, None, None] + (0 if pooled is None else PRIOR_ROWS * pooled)) / (n + (0 if pooled is None else PRIOR_ROWS))[:, None, None]
            cov = cov + np.diag(np.square(FLOORS))
            inverse = np.linalg.inv(cov)
            values = {f"__m{i}": mean[:, i] for i in range(DIM)} | {f"__p{i}{j}": inverse[:, i, j] for i, j in _PAIRS}
            values["__logdet"] = np.linalg.slogdet(cov)[1]
            yield pd.concat([out.reset_index(drop=True), pd.DataFrame(values)], axis=1)

    return sums.mapInPandas(run, f"__lang string, __source string, {_MODEL}")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(x).alias(f"__s{i}") for i, x in enumerate(_X)],
        *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"__q{i}{j}") for i, j in _PAIRS],
    )


def _pooled(sums: DataFrame) -> np.ndarray:
    """Scatter around the group means over all groups: DIM x DIM numbers."""
    cells = [F.sum(F.col(f"__q{i}{j}") - F.col(f"__s{i}") * F.col(f"__s{j}") / F.col("__n")) for i, j in _PAIRS]
    row = sums.agg(F.sum("__n"), *cells).first()
    out = np.zeros((DIM, DIM))
    for (i, j), value in zip(_PAIRS, row[1:]):
        out[i, j] = out[j, i] = (value or 0.0) / max(1, row[0] or 0)
    return out


def chi_square_quantile(p: float, dim: int) -> float:
    """Wilson and Hilferty's approximation."""
    z = NormalDist().inv_cdf(p)
    return dim * (1 - 2 / (9 * dim) + z * math.sqrt(2 / (9 * dim))) ** 3


def _with_distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    # Groups with a missing language or source are groups too, hence the NULL-safe join.
    m = bounded(model.withColumnsRenamed({g: f"{g}2" for g in _GROUP}), 8 * (DIM + len(_PAIRS) + 8))
    near = F.col("__lang").eqNullSafe(F.col("__lang2")) & F.col("__source").eqNullSafe(F.col("__source2"))
    return rows.join(m, near, "left").withColumn("__d", _distance())


def judge(stats: DataFrame, share: float = 0.75, reject: float = 1e-6, tolerance: float = 1e-3, max_steps: int = 50) -> DataFrame:
    """`stats` (the counts, __lang, __source, base_failed) with `kept`, and `distance` (NULL where base_failed).

    Steps end when no group's log-determinant falls by more than `tolerance`; it never rises, so they do end.
    """
    rows = stats.select("*", *[x.alias(name) for x, name in zip(_transformed(), _X)])
    rows = cut(rows)
    good = rows.filter(~F.col("base_failed"))
    sums = cut(_sums(good))
    pooled = _pooled(sums)
    # The start: medians as centres with the pooled scatter, whose outliers the first step leaves out.
    middle = good.groupBy(*_GROUP).agg(*[F.percentile_approx(x, 0.5).alias(f"__m{i}") for i, x in enumerate(_X)])
    start = np.linalg.inv(pooled + np.diag(np.square(FLOORS)))
    model = cut(middle.select("*", *[F.lit(float(start[i, j])).alias(f"__p{i}{j}") for i, j in _PAIRS], F.lit(math.inf).alias("__logdet")))
    for _ in range(max_steps):
        placed = _with_distance(good, model)
        limit = placed.groupBy(*_GROUP).agg(F.percentile_approx("__d", share).alias("__h"))
        limit = bounded(cut(limit).withColumnsRenamed({g: f"{g}3" for g in _GROUP}), 64)
        inner = placed.join(limit, F.col("__lang").eqNullSafe(F.col("__lang3")) & F.col("__source").eqNullSafe(F.col("__source3"))).filter("__d <= __h")
        inner_sums = cut(_sums(inner))
        following = cut(_estimates(inner_sums, _pooled(inner_sums)))
        old = model.select(*[F.col(g).alias(f"{g}2") for g in _GROUP], F.col("__logdet").alias("__old"))
        fall = following.join(old, F.col("__lang").eqNullSafe(F.col("__lang2")) & F.col("__source").eqNullSafe(F.col("__source2")))
        most = fall.agg(F.max(F.col("__old") - F.col("__logdet"))).first()[0]
        model = following
        if most is None or most <= tolerance:
            break
    placed = _with_distance(rows, model)
    # The covariance of the inner rows is too small for all rows: medians of distances tell by how much.
    centre = chi_square_quantile(0.5, DIM)
    scale = cut(placed.filter(~F.col("base_failed")).groupBy(*_GROUP).agg(F.greatest(F.percentile_approx("__d", 0.5) / centre, F.lit(1.0)).alias("__scale")))
    scale = bounded(scale.withColumnsRenamed({g: f"{g}3" for g in _GROUP}), 64)
    placed = placed.join(scale, F.col("__lang").eqNullSafe(F.col("__lang3")) & F.col("__source").eqNullSafe(F.col("__source3")), "left")
    distance = F.when(~F.col("base_failed"), F.sqrt(F.col("__d") / F.col("__scale")))
    most = math.sqrt(chi_square_quantile(1 - reject, DIM))
    return placed.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= most, F.lit(False)))


def quality_rules(docs: DataFrame, reject: float = 1e-6) -> DataFrame:
    """(doc_id, five counts, base_failed, kept, distance) for each row of `docs`.

    A NULL or empty text has no words and fails the base rules. Rows stay apart when repeated or when doc_id is NULL;
    NULL languages or sources form groups of their own. An empty table gives an empty result.
    """
    source = docs.select("doc_id", F.col("lang").alias("__lang"), F.col("source").alias("__source"), "text")
    stats = map_texts(source, ["doc_id", *_GROUP], statistics, ", ".join(f"{c} bigint" for c in COUNTS))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judge(stats.withColumn("base_failed", failed), reject=reject).select("doc_id", *COUNTS[:5], "base_failed", "kept", "distance")
