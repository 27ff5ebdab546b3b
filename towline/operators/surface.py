"""Smooth surface of an environment variable over an ordination: a penalised spline of low rank.

The basis is a product of cubic B-splines on both axes, with a penalty on second differences of neighbouring coefficients
along each axis (Eilers and Marx 1996). One pass sums the Gram matrix of the basis over the units, batch by batch, so
what reaches the driver is its square and nothing per unit. One decomposition of it against the penalty gives the fit, its
degrees of freedom and the generalised cross-validation score at any penalty (Wahba 1990); the best penalty is searched on these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEGREE = 3
RIDGE = 1e-9  # of the mean diagonal, for parts of the plane without units


def spline_rows(x: np.ndarray, low: float, high: float, n_basis: int) -> np.ndarray:
    """(len x, n_basis): cubic B-splines with equal knots over [low, high]; values outside are taken to its ends."""
    pieces = n_basis - DEGREE
    at = np.clip((np.asarray(x, float) - low) / (high - low if high > low else 1.0), 0.0, 1.0) * pieces
    left = np.minimum(at.astype(int), pieces - 1)
    t = at - left
    # The four splines that are not zero in a piece.
    values = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], 1) / 6
    rows = np.zeros((len(at), n_basis))
    rows[np.arange(len(at))[:, None], left[:, None] + np.arange(4)] = values
    return rows


def product_rows(a: np.ndarray, b: np.ndarray, box: tuple[float, float, float, float], n_basis: int) -> np.ndarray:
    first, second = spline_rows(a, box[0], box[1], n_basis), spline_rows(b, box[2], box[3], n_basis)
    return (first[:, :, None] * second[:, None, :]).reshape(len(first), -1)


def roughness(n_basis: int) -> np.ndarray:
    """Sum of squared second differences of the coefficients along both axes, as a quadratic form."""
    steps = np.diff(np.eye(n_basis), 2, axis=0)
    one = steps.T @ steps
    return np.kron(one, np.eye(n_basis)) + np.kron(np.eye(n_basis), one)


class Surface(NamedTuple):
    """Fitted values on a grid; the coefficients, box, penalty, effective degrees of freedom, cross-validation score, share of variance and number of units."""

    grid: DataFrame
    coefficients: np.ndarray
    box: tuple[float, float, float, float]
    n_basis: int
    penalty: float
    edf: float
    gcv: float
    r2: float
    n: int


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def _inside(hull: np.ndarray, points: np.ndarray) -> np.ndarray:
    if len(hull) < 3:
        return np.zeros(len(points), bool)
    edge = np.roll(hull, -1, axis=0) - hull
    gap = points[:, None, :] - hull[None]
    return np.all(edge[:, 0] * gap[:, :, 1] - edge[:, 1] * gap[:, :, 0] >= -1e-9 * np.abs(edge).max() ** 2, axis=1)


class _Path:
    """The fit at every penalty, from one decomposition of the Gram matrix against the penalty form."""

    def __init__(self, gram: np.ndarray, form: np.ndarray, right: np.ndarray, square: float, n: int):
        lower = np.linalg.cholesky(gram + RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)))
        half = np.linalg.solve(lower, form)
        values, vectors = np.linalg.eigh(np.linalg.solve(lower, half.T))
        self.back = np.linalg.solve(lower.T, vectors)
        self.values, self.target, self.square, self.n = np.maximum(values, 0.0), self.back.T @ right, square, n

    def at(self, penalty: float) -> tuple[np.ndarray, float, float, float]:
        """(coefficients, degrees of freedom, residual sum of squares, score)."""
        shrink = 1 / (1 + penalty * self.values)
        edf = float(shrink.sum())
        rest = float(max(self.square - (self.target**2 * (2 * shrink - shrink**2)).sum(), 0.0))
        return self.back @ (shrink * self.target), edf, rest, self.n * rest / max(self.n - edf, 1e-9) ** 2

    def best(self) -> float:
        """The penalty of least score: the best of a wide grid, refined by golden section between its neighbours."""
        grid = np.linspace(-12, 16, 57)
        k = int(np.argmin([self.at(math.exp(g))[3] for g in grid]))
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
        ratio = (math.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if self.at(math.exp(a))[3] <= self.at(math.exp(b))[3] else (a, high)
        return math.exp((low + high) / 2)


def smooth_surface(coords: DataFrame, env: DataFrame, col: str, nx: int = 31, ny: int = 31, n_basis: int = 8, penalty: float | None = None,
                   axes: tuple[str, str] = ("axis1", "axis2"), unit: str = "unit") -> Surface:
    """Fit `col` over two ordination axes and evaluate it on a grid `(gx, gy, axis1, axis2, fitted, inside)`.

    `inside` tells grid points within the convex hull of the units. The penalty is chosen by generalised cross-validation unless it is
    given. Units whose value or place is unknown are left out.
    """
    a, b = axes
    used = coords.select(unit, a, b).join(env.select(unit, F.col(col).cast("double").alias("__y")), unit).dropna(subset=[a, b, "__y"])
    ends = used.agg(F.min(a), F.max(a), F.min(b), F.max(b), F.count(F.lit(1)), F.avg("__y")).first()
    if not ends[4]:
        raise ValueError("no unit has both a place and a value")
    box, n, mean, p = tuple(float(v) for v in ends[:4]), ends[4], float(ends[5]), n_basis**2

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right, square, corners = np.zeros((p, p)), np.zeros(p), 0.0, np.zeros((0, 2))
        for batch in batches:
            rows = product_rows(batch[a].to_numpy(), batch[b].to_numpy(), box, n_basis)
            y = batch["__y"].to_numpy() - mean
            gram, right, square = gram + rows.T @ rows, right + rows.T @ y, square + float(y @ y)
            corners = _hull(np.concatenate([corners, batch[[a, b]].to_numpy(float)]))
        yield pd.DataFrame({"gram": [gram.tobytes()], "right": [right.tobytes()], "square": [square], "hull": [corners.tobytes()]})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: sum(np.frombuffer(v) for v in frame[c])
        corners = _hull(np.concatenate([np.frombuffer(v).reshape(-1, 2) for v in frame["hull"]]))
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "gram": [add("gram").tobytes()], "right": [add("right").tobytes()], "square": [frame["square"].sum()], "hull": [corners.tobytes()]})

    # Summed in two steps, so that neither one task nor the driver reads a matrix of every task.
    shape = "gram binary, right binary, square double, hull binary"
    parts = used.select(a, b, "__y").mapInPandas(sums, shape).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    done = parts.groupBy("part").applyInPandas(total, f"part int, {shape}").toPandas()
    whole = total(done).iloc[0]
    path = _Path(np.frombuffer(whole["gram"]).reshape(p, p), roughness(n_basis), np.frombuffer(whole["right"]), float(whole["square"]), n)
    chosen = path.best() if penalty is None else float(penalty)
    coefficients, edf, rest, score = path.at(chosen)

    spark = coords.sparkSession
    xs, ys = np.linspace(box[0], box[1], nx), np.linspace(box[2], box[3], ny)
    gx, gy = (v.ravel() for v in np.meshgrid(np.arange(nx), np.arange(ny), indexing="ij"))
    points = np.stack([xs[gx], ys[gy]], 1)
    fitted = product_rows(points[:, 0], points[:, 1], box, n_basis) @ coefficients + mean
    inside = _inside(np.frombuffer(whole["hull"]).reshape(-1, 2), points)
    grid = spark.createDataFrame(
        pd.DataFrame({"gx": gx.astype("int32"), "gy": gy.astype("int32"), a: points[:, 0], b: points[:, 1], "fitted": fitted, "inside": inside}))
    # Splines of a point sum to one, so the mean is a constant added to every coefficient.
    return Surface(grid, coefficients + mean, box, n_basis, chosen, edf, score, 1 - rest / float(whole["square"]) if whole["square"] > 0 else 0.0, n)


def surface_at(coords: DataFrame, surface: Surface, axes: tuple[str, str] = ("axis1", "axis2"), to: str = "fitted") -> DataFrame:
    """`coords` with the surface's value at each place; NULL where the place is unknown."""
    a, b = axes
    box, n_basis, coefficients = surface.box, surface.n_basis, surface.coefficients

    @F.pandas_udf("double")
    def value(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[known] = product_rows(x.to_numpy(float)[known], y.to_numpy(float)[known], box, n_basis) @ coefficients
        return pd.Series(out).where(known, None)

    return coords.withColumn(to, value(F.col(a).cast("double"), F.col(b).cast("double")))
