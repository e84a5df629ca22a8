"""Linear forecasters from sums of products: one aggregate over the steps, a small system solved by the driver.

The sums are grouped (by look-back, by order of difference), so several fits share one pass. What reaches the driver
is one row per group with F x F numbers, however many rows were summed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE, TARGET = "_one", "_target"


class LinearForecast:
    """Coefficients of named columns, used like a fitted model; the first one belongs to the constant."""

    def __init__(self, columns: list[str], weights: np.ndarray) -> None:
        self.columns, self.weights = list(columns), np.asarray(weights, float)
        self._name = "prediction"

    @property
    def intercept(self) -> float:
        return float(self.weights[0])

    @property
    def coefficients(self) -> np.ndarray:
        return self.weights[1:]

    def value(self) -> Column:
        total = F.lit(self.intercept)
        for column, weight in zip(self.columns, self.coefficients):
            total = total + F.lit(float(weight)) * F.col(column)
        return total

    def setPredictionCol(self, name: str) -> "LinearForecast":  # noqa: N802  as fitted models have it
        self._name = name
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self._name, self.value())


def product_sums(rows: DataFrame, columns: list[str], weight: str, by: list[str]) -> dict[tuple, np.ndarray]:
    """For each group the matrix of weighted sums of products of ``columns``, those of one column included.

    Rows whose weight is zero or null, or that miss a value, do not count.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.col(weight) * F.col(columns[i]) * F.col(columns[j])).alias(f"_p{i}_{j}") for i, j in pairs]
    found = rows.filter(F.col(weight) > 0).dropna(subset=columns).groupBy(*by).agg(*sums)
    matrices = {}
    for row in found.collect():
        matrix = np.empty((len(columns), len(columns)))
        for i, j in pairs:
            matrix[i, j] = matrix[j, i] = row[f"_p{i}_{j}"]
        matrices[tuple(row[c] for c in by)] = matrix
    return matrices


def least_squares(sums: np.ndarray) -> np.ndarray:
    """Weights that minimise the squared error; of several such the smallest ones. The last column is the target."""
    scale = np.sqrt(np.maximum(np.diag(sums)[:-1], 0))
    scale[scale == 0] = 1
    a = sums[:-1, :-1] / np.outer(scale, scale)
    return np.linalg.lstsq(a, sums[:-1, -1] / scale, rcond=1e-12)[0] / scale


def penalised(sums: np.ndarray, reg_param: float = 0.0, elastic_net: float = 0.0) -> np.ndarray:
    """Weights under a penalty on standardised columns, as Spark ML's linear regression has it.

    ``sums`` begins with the constant, whose weight is not penalised. The penalty is ``reg_param`` over the target's
    deviation times a mix of absolute (``elastic_net``) and half squared weights. A constant column gets weight zero.
    """
    total = sums[0, 0]
    mean = sums[0, 1:] / total
    covariance = sums[1:, 1:] / total - np.outer(mean, mean)
    variance = np.diag(covariance)
    deviation = np.sqrt(np.where(variance > 1e-12 * np.maximum(mean * mean, 1e-300), variance, 0))
    spread, y_spread = deviation[:-1], deviation[-1]
    weights = np.zeros(len(spread))
    varies = spread > 0
    if y_spread > 0 and varies.any():
        a = covariance[:-1, :-1][np.ix_(varies, varies)] / np.outer(spread[varies], spread[varies])
        b = covariance[:-1, -1][varies] / (spread[varies] * y_spread)
        strength = reg_param / y_spread
        if strength * elastic_net == 0:
            own = np.linalg.lstsq(a + strength * np.eye(len(b)), b, rcond=1e-12)[0]
        else:
            own = _descend(a, b, strength * elastic_net, strength * (1 - elastic_net))
        weights[varies] = own * y_spread / spread[varies]
    return np.append(mean[-1] - weights @ mean[:-1], weights)


def _descend(a: np.ndarray, b: np.ndarray, absolute: float, squared: float, rounds: int = 100_000) -> np.ndarray:
    """One weight at a time until none moves."""
    own = np.zeros(len(b))
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(b)):
            rest = b[k] - a[k] @ own + a[k, k] * own[k]
            new = np.sign(rest) * max(abs(rest) - absolute, 0.0) / (a[k, k] + squared)
            moved, own[k] = max(moved, abs(new - own[k])), new
        if moved < 1e-12:
            break
    return own
