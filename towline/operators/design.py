"""Design columns from terms, and the Gram matrix they share across models.

Terms are column names, `numeric("month")`, `categorical("year")`, and interactions `"a:b"`; `"a*b"`
stands for `a, b, a:b`, and `"a*b*c"` for all products of its parts. Text columns are categorical, others numeric. Categorical terms are treatment
coded against their first level, interactions multiply the columns of their parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIAS_TOLERANCE = 1e-10


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str | None = None


def numeric(name: str) -> Variable:
    return Variable(name, "numeric")


def categorical(name: str) -> Variable:
    return Variable(name, "categorical")


@dataclass
class DesignColumn:
    name: str
    term: str
    raw: Column
    anchor: float
    parts: tuple[tuple[str, str | None], ...]

    def shifted(self) -> Column:
        """The column minus a constant near its mean, so that sums of squares keep their digits."""
        return self.raw - F.lit(self.anchor)


@dataclass
class Design:
    variables: dict[str, Variable]
    levels: dict[str, list]
    terms: list[str]
    columns: list[DesignColumn]

    def complete(self, df: DataFrame, *more: str) -> DataFrame:
        """Rows in which every used variable is known."""
        return df.dropna(subset=[*self.variables, *more])

    def term_of(self) -> list[str]:
        return [c.term for c in self.columns]


def _expand_terms(terms: Sequence) -> list[list[Variable]]:
    products: list[list[Variable]] = []
    for term in terms:
        if isinstance(term, Variable):
            parts = [[term]]
        elif "*" in term:
            pieces = [Variable(p.strip()) for p in term.split("*")]
            parts = [list(c) for size in range(1, len(pieces) + 1) for c in combinations(pieces, size)]
        else:
            parts = [[Variable(p.strip()) for p in term.split(":")]]
        for product in parts:
            if [v.name for v in product] not in [[v.name for v in p] for p in products]:
                products.append(product)
    mains = {p[0].name for p in products if len(p) == 1}
    for product in products:
        if len(product) > 1 and any(v.name not in mains for v in product):
            raise ValueError("an interaction needs the main effects of its parts")
    return products


def term_variables(terms: Sequence) -> list[str]:
    """Names of the columns that terms use."""
    return list(dict.fromkeys(v.name for product in _expand_terms(terms) for v in product))


def _levels(df: DataFrame, names: list[str]) -> dict[str, list]:
    """Sorted levels of the categorical variables, all in one distinct pass."""
    if not names:
        return {}
    cells = F.array([F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("level")) for n in names])
    rows = df.select(F.explode(cells).alias("c")).select("c.name", "c.level").distinct().collect()
    number = {n: isinstance(df.schema[n].dataType, T.NumericType) for n in names}
    return {
        n: sorted((r["level"] for r in rows if r["name"] == n and r["level"] is not None),
                  key=float if number[n] else str)
        for n in names
    }


def design(df: DataFrame, terms: Sequence) -> Design:
    """Read levels and means once and state every design column as an expression."""
    products = _expand_terms(terms)
    given = {v.name: v for p in products for v in p}
    for product in products:
        for v in product:
            if v.kind:
                given[v.name] = v
    variables = {
        n: Variable(n, v.kind or ("categorical" if isinstance(df.schema[n].dataType, (T.StringType, T.BooleanType)) else "numeric"))
        for n, v in given.items()
    }
    known = df.dropna(subset=list(variables))
    levels = _levels(known, [n for n, v in variables.items() if v.kind == "categorical"])
    numbers = [n for n, v in variables.items() if v.kind == "numeric"]
    # A constant column is anchored at its value, so that it is exactly zero and drops out.
    means = known.agg(*[
        F.when(F.min(n) == F.max(n), F.min(F.col(n).cast("double"))).otherwise(F.avg(F.col(n).cast("double"))).alias(n)
        for n in numbers
    ]).first().asDict() if numbers else {}
    blocks: dict[str, list[DesignColumn]] = {}
    for n, v in variables.items():
        if v.kind == "numeric":
            blocks[n] = [DesignColumn(n, n, F.col(n).cast("double"), float(means[n] or 0.0), ((n, None),))]
        else:
            blocks[n] = [
                DesignColumn(f"{n}[{level}]", n, F.when(F.col(n).cast("string") == level, 1.0).otherwise(0.0), 0.0,
                             ((n, level),))
                for level in levels[n][1:]
            ]
    columns: list[DesignColumn] = []
    for product in products:
        label = ":".join(v.name for v in product)
        combined = blocks[product[0].name]
        for v in product[1:]:
            combined = [
                DesignColumn(f"{a.name}:{b.name}", label, a.raw * b.raw, a.anchor * b.anchor, a.parts + b.parts)
                for a in combined for b in blocks[v.name]
            ]
        columns.extend(DesignColumn(c.name, label, c.raw, c.anchor, c.parts) for c in combined)
    return Design(variables, levels, [":".join(v.name for v in p) for p in products], columns)


def gram(df: DataFrame, columns: Sequence[Column], by: Sequence[str] = ()) -> dict[tuple, np.ndarray]:
    """Sums of products of columns, per group if asked: a p x p matrix per group.

    Narrow designs are plain sums in one aggregate. Wide ones are multiplied per batch inside the
    tasks, one p x p partial per task and group being summed by Spark.
    """
    p = len(columns)
    named = df.select(*by, *[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    cells = [(a, b) for a in range(p) for b in range(a, p)]
    result: dict[tuple, np.ndarray] = {}
    if len(cells) <= 90:
        sums = [F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"s{k}") for k, (a, b) in enumerate(cells)]
        for row in named.groupBy(*by).agg(*sums).collect():
            matrix = np.zeros((p, p))
            for k, (a, b) in enumerate(cells):
                matrix[a, b] = matrix[b, a] = row[f"s{k}"] if row[f"s{k}"] is not None else 0.0
            result[tuple(row[c] for c in by)] = matrix
        return result
    keys = list(by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            parts = batch.groupby(keys, dropna=False) if keys else [((), batch)]
            for key, part in parts:
                block = part[[f"c{k}" for k in range(p)]].to_numpy()
                key = key if isinstance(key, tuple) else (key,)
                totals[key] = totals.get(key, 0.0) + block.T @ block
        for key, total in totals.items():
            yield pd.DataFrame({
                **{c: [v] * (p * p) for c, v in zip(keys, key)},
                "a": np.repeat(np.arange(p), p), "b": np.tile(np.arange(p), p), "v": total.ravel(),
            })

    schema = T.StructType([*[named.schema[c] for c in keys], T.StructField("a", T.IntegerType()),
                           T.StructField("b", T.IntegerType()), T.StructField("v", T.DoubleType())])
    for row in named.mapInPandas(partial, schema).groupBy(*keys, "a", "b").agg(F.sum("v").alias("v")).collect():
        result.setdefault(tuple(row[c] for c in keys), np.zeros((p, p)))[row["a"], row["b"]] = row["v"]
    return result


@dataclass
class Factor:
    """Centred design factored in order: `kept` columns, inverse triangular factor, means."""

    n: float
    means: np.ndarray
    centred: np.ndarray
    kept: list[int]
    inverse: np.ndarray


def factor(matrix: np.ndarray) -> Factor:
    """Factor the Gram matrix of `[1, columns]`, dropping columns that earlier ones already explain."""
    n = matrix[0, 0]
    means = matrix[0, 1:] / n
    centred = matrix[1:, 1:] - n * np.outer(means, means)
    scale = np.diag(matrix)[1:]
    kept: list[int] = []
    rows: list[np.ndarray] = []
    for k in range(len(means)):
        row = np.array([centred[j, k] for j in kept])
        solved = np.zeros(len(kept))
        for j in range(len(kept)):
            solved[j] = (row[j] - rows[j][:j] @ solved[:j]) / rows[j][j]
        pivot = centred[k, k] - solved @ solved
        if pivot > ALIAS_TOLERANCE * max(centred[k, k], 1e-6 * scale[k]):
            rows.append(np.append(solved, np.sqrt(pivot)))
            kept.append(k)
    lower = np.zeros((len(kept), len(kept)))
    for j, row in enumerate(rows):
        lower[j, : len(row)] = row
    inverse = np.linalg.inv(lower).T if kept else np.zeros((0, 0))
    return Factor(n, means, centred, kept, inverse)


def design_rows(df: DataFrame, terms: Sequence, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Rows as `x` = array of the intercept and all design columns, and the names of its entries."""
    spec = design(df, terms)
    values = F.array(F.lit(1.0), *[c.raw for c in spec.columns])
    return spec.complete(df).select(*keep, values.alias("x")), ["(intercept)", *[c.name for c in spec.columns]]
