"""Weighted logistic regression with an L2 penalty, fitted by Newton steps on distributed cross-products.

A step is one scan: every task adds up loss, slope and curvature of its rows in blocks and sends one row per
entry of these, Spark adds them up by entry, and the driver solves one system of the size of the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block inside a task.
BLOCK = 8192
#: Terms of a score that are written out one by one; of more features, Spark folds the array.
WRITTEN = 100


class NotConvergedError(RuntimeError):
    """The Newton steps did not come to rest."""


@dataclass(frozen=True)
class LogisticModel:
    coefficients: np.ndarray
    intercept: float
    steps: int

    def probability(self, x: Column) -> Column:
        """P(label = 1) for an array of features; terms are added in the order of the array."""
        weights = [F.lit(float(c)) for c in self.coefficients]
        z = F.lit(float(self.intercept))
        if len(weights) <= WRITTEN:  # written out, Spark compiles the sum
            for i, c in enumerate(weights):
                z = z + F.get(x, F.lit(i)) * c
        else:
            z = F.aggregate(F.zip_with(x, F.array(*weights), lambda a, b: a * b), z, lambda s, t: s + t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _entries(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, upper: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Loss, slope and upper triangle of the curvature of some rows, one after the other."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    z = x @ beta
    p = np.where(z >= 0, 1.0, np.exp(-np.abs(z))) / (1.0 + np.exp(-np.abs(z)))
    loss = w @ (np.maximum(z, 0.0) - y * z + np.log1p(np.exp(-np.abs(z))))
    curve = x.T @ (x * (w * p * (1.0 - p))[:, None])
    return np.concatenate([[loss], x.T @ (w * (p - y)), curve[upper]])


def objective(rows: DataFrame, beta: np.ndarray, penalty: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and curvature of summed weighted loss + penalty / 2 * |coefficients|^2 at ``beta``.

    ``rows`` holds ``x`` (array of doubles), ``y`` (0 or 1) and ``w``; ``beta`` starts with the intercept, which
    carries no penalty.
    """
    size = len(beta)
    upper = np.triu_indices(size)
    length = 1 + size + len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(length), False
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size - 1)
                y, w = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
                total, some = total + _entries(x, y, w, beta, upper), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], names=["entry", "value"])

    numbers = rows.select("x", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    sums = numbers.mapInArrow(run, "entry long, value double").groupBy("entry").agg(F.sum("value")).collect()
    flat = np.zeros(length)
    for entry, value in sums:  # as many as the square of the features
        flat[entry] = value
    own = np.append(0.0, np.full(size - 1, float(penalty)))
    curve = np.zeros((size, size))
    curve[upper] = flat[1 + size :]
    curve = curve + np.triu(curve, 1).T + np.diag(own)
    return float(flat[0] + 0.5 * own @ beta**2), flat[1 : 1 + size] + own * beta, curve


def fit_logistic(rows: DataFrame, size: int, penalty: float = 1.0, max_steps: int = 100, tolerance: float = 1e-10) -> LogisticModel:
    """The minimum of ``objective``: Newton steps from zero, halved while they do not lower the value.

    With a positive penalty and rows of both labels the minimum is unique, so partitions can change no more
    than the last digits. A feature that is constant keeps the coefficient 0. The search is over once a step moves no coefficient by
    more than ``tolerance`` (relative to 1 + its size); a fit that never gets there raises NotConvergedError.
    """
    beta = np.zeros(size + 1)
    value, slope, curve = objective(rows, beta, penalty)
    for taken in range(1, max_steps + 1):
        # The least-squares solution also serves a column that equals another one when there is no penalty.
        move = np.linalg.lstsq(curve, -slope, rcond=None)[0]
        if np.all(np.abs(move) <= tolerance * (1.0 + np.abs(beta))):
            beta = beta + move
            return LogisticModel(beta[1:], float(beta[0]), taken)
        share = 1.0
        while True:
            after = objective(rows, beta + share * move, penalty)
            # Near the minimum the value only moves in its last bits.
            if after[0] <= value + 1e-12 * (1.0 + abs(value)) or share < 1e-6:
                break
            share /= 2.0
        beta = beta + share * move
        value, slope, curve = after
    raise NotConvergedError(f"No minimum after {max_steps} steps; the gradient is {np.abs(slope).max():.3g}.")
