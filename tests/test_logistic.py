"""Newton fit of the logistic regression: against a direct solution, partitions, separable and odd inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import logistic
from marketlens.operators.logistic import NotConvergedError, fit_logistic, objective
from marketlens.plans import propensity
from tests.test_models import _features

SCHEMA = "x array<double>, y double, w double"


def _rows(spark, n=600, size=4, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    y = (rng.random(n) < 1 / (1 + np.exp(0.7 - x @ np.arange(size)))).astype(float)
    w = rng.choice([0.5, 1.0, 2.5], n)
    return x, y, w, spark.createDataFrame([(r.tolist(), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], SCHEMA)


def _direct(x, y, w, penalty):
    z, ridge = np.column_stack([np.ones(len(x)), x]), np.append(0.0, np.full(x.shape[1], penalty))
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (p - y)) + ridge * beta)
    return beta


@pytest.mark.parametrize("penalty", [0.0, 1.0, 50.0])
def test_minimum_is_that_of_a_direct_solution(spark, penalty):
    x, y, w, rows = _rows(spark)
    model = fit_logistic(rows, 4, penalty)
    assert np.append(model.intercept, model.coefficients) == pytest.approx(_direct(x, y, w, penalty), abs=1e-9)
    value, slope, curve = objective(rows, np.append(model.intercept, model.coefficients), penalty)
    assert np.abs(slope).max() < 1e-8 and np.all(np.linalg.eigvalsh(curve) > 0) and value > 0
    got = [r[0] for r in rows.select(model.probability(F.col("x"))).collect()]
    assert got == pytest.approx(1 / (1 + np.exp(-(x @ model.coefficients + model.intercept))), abs=1e-12)


def test_gradient_is_the_slope_of_the_value(spark):
    rows = _rows(spark)[3]
    at, step = np.array([0.3, -0.2, 0.1, 0.4, 0.0]), 1e-5
    slope = objective(rows, at)[1]
    for i in range(5):
        move = np.eye(5)[i] * step
        assert slope[i] == pytest.approx((objective(rows, at + move)[0] - objective(rows, at - move)[0]) / (2 * step), abs=1e-4)


def test_separable_constant_and_equal_columns(spark):
    """The penalty keeps separable labels finite; a constant 0 column gets 0, equal columns share their weight."""
    lines = [([float(i), 0.0, float(i)], float(i > 0), 1.0) for i in range(-30, 31)]
    model = fit_logistic(spark.createDataFrame(lines, SCHEMA).repartition(7), 3)
    a, zero, b = model.coefficients
    assert zero == pytest.approx(0.0, abs=1e-12) and a == pytest.approx(b, abs=1e-9) and 0 < a < 10


def test_huge_scores_do_not_overflow(spark):
    lines = [([s * 1e4], float(s > 0), 1.0) for s in (-3.0, -2.0, -1.0, 1.0, 2.0, 3.0)] * 3
    value, slope, _ = objective(spark.createDataFrame(lines, SCHEMA), np.array([0.0, 1.0]), 0.0)
    assert value == pytest.approx(0.0, abs=1e-12) and np.all(np.isfinite(slope))
    with pytest.raises(NotConvergedError):
        fit_logistic(spark.createDataFrame(lines, SCHEMA), 1, penalty=0.0, max_steps=3)


def test_propensity_does_not_depend_on_partitions(spark):
    features = _features(spark, 1500)
    found = []
    for parts in (1, 16):
        drivers = propensity.fit_scores(features.repartition(parts), gradient=True)[1].collect()
        assert max(abs(r["gradient"]) for r in drivers) < 1e-8 and abs(drivers[0]["intercept_gradient"]) < 1e-8
        found.append({r["feature"]: r["coefficient"] for r in drivers})
    assert found[0].keys() == found[1].keys()
    assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 1e-9


def test_scores_written_out_equal_folded_ones(spark, monkeypatch):
    rows = _rows(spark)[3].select("x").union(spark.createDataFrame([(None,)], "x array<double>"))
    model = logistic.LogisticModel(np.array([0.3, -1.7, 2.5, 1e-9]), -0.4, 1)
    written = [r[0] for r in rows.select(model.probability(F.col("x"))).collect()]
    monkeypatch.setattr(logistic, "WRITTEN", 0)
    folded = rows.select(model.probability(F.col("x")))
    assert written == [r[0] for r in folded.collect()] and written.count(None) == 1
