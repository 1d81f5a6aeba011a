"""Boosted trees: against a plain grower, cut points, partitions, weights and odd inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import boosting
from marketlens.operators.boosting import cut_points, fit_boosted
from marketlens.plans import experiment, propensity
from marketlens.plans.encode import design_matrix
from tests.test_models import _features

SCHEMA = "id long, x array<double>, y double, w double"


def _rows(spark, n=900, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n), rng.exponential(50, n).round(2), np.full(n, 3.0), -rng.random(n)])
    y = 40 * (x[:, 0] > 0.3) * x[:, 1] + x[:, 2] / 10 + rng.normal(size=n)
    w = rng.choice([0.25, 1.0, 2.0], n)
    return x, y, w, spark.createDataFrame([(i * 7919, r.tolist(), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w, strict=True))], SCHEMA)


def _grow(x, y, w, cuts, depth, penalty, least):
    """A plain tree: recursion over rows, every cut tried."""
    value = (w @ y) / (w.sum() + penalty) if len(y) else 0.0
    best = (1e-9, None)
    for f, at in enumerate(cuts if depth else []):
        for c in at:
            go = x[:, f] < c
            a, b = w[go].sum(), w[~go].sum()
            if go.any() and not go.all() and min(a, b) >= least:
                gain = (w[go] @ y[go]) ** 2 / (a + penalty) + (w[~go] @ y[~go]) ** 2 / (b + penalty) - (w @ y) ** 2 / (w.sum() + penalty)
                if gain > best[0] * (1 + 1e-12):
                    best = (gain, (f, c))
    if best[1] is None:
        return lambda q: np.full(len(q), value)
    f, c = best[1]
    go = x[:, f] < c
    low, high = (_grow(x[s], y[s], w[s], cuts, depth - 1, penalty, least) for s in (go, ~go))
    return lambda q: np.where(q[:, f] < c, low(q), high(q))


@pytest.mark.parametrize(("penalty", "least"), [(1.0, 1.0), (0.0, 60.0)])
def test_against_plain_trees(spark, penalty, least):
    x, y, w, rows = _rows(spark)
    model = fit_boosted(rows, 5, 4, seed=3, rate=0.3, row_share=1.0, column_share=1.0, penalty=penalty, least_weight=least)
    plain = np.full(len(y), (w @ y) / w.sum())
    for _ in range(4):
        plain += 0.3 * _grow(x, y - plain, w, model.cuts, 3, penalty, least)(x)
    got = {r["id"]: r["p"] for r in model.predict(rows.repartition(5), "x", "p").collect()}
    assert [got[i * 7919] for i in range(len(y))] == pytest.approx(plain, abs=1e-6)


def test_cut_points_share_the_rows(spark):
    x, _, _, rows = _rows(spark, 3000)
    cuts = cut_points(rows.repartition(6), "x", 5)
    assert [len(c) for c in cuts][1:4:2] == [1, 0] and all(np.all(np.diff(c) > 0) and len(c) < boosting.BINS for c in cuts)
    for f in (0, 2, 4):
        sizes = np.bincount(np.searchsorted(cuts[f], x[:, f], "right"), minlength=len(cuts[f]) + 1)
        assert len(cuts[f]) > 25 and sizes.max() < 3000 / 12
    # A level that few rows have, at either end, has a cut of its own.
    rare = spark.createDataFrame([(i, [float(i == 7), float(i != 7)], 0.0, 1.0) for i in range(500)], SCHEMA)
    assert [len(c) for c in cut_points(rare, "x", 2)] == [1, 1]


def test_samples_repeat_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 3)
    rows = _rows(spark)[3]
    one, many = (fit_boosted(rows.repartition(p), 5, 8, seed=11) for p in (1, 16))
    assert one.base == many.base
    for a, b in zip(one.trees, many.trees, strict=True):
        assert all(np.array_equal(u, v) for u, v in zip(a, b, strict=True))
    other = fit_boosted(rows, 5, 8, seed=12)
    assert any(not np.array_equal(a[2], b[2]) for a, b in zip(one.trees, other.trees, strict=True))
    shares = [boosting._drawn(np.arange(20000) * 32, 5, t, 0.9) for t in range(3)]
    assert all(abs(s.mean() - 0.9) < 0.01 for s in shares) and 0.79 < (shares[0] & shares[1]).mean() < 0.83


def test_a_level_is_one_job_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 64)
    rows, sc, jobs = _rows(spark)[3].repartition(4), spark.sparkContext, []
    for rounds in (2, 7):
        sc.setJobGroup(f"fit-{rounds}", "boosting")
        fit_boosted(rows, 5, rounds, seed=11)
        jobs.append(sc.statusTracker().getJobIdsForGroup(f"fit-{rounds}"))
    sc._jsc.clearJobGroup()
    assert len(jobs[1]) - len(jobs[0]) == 5 * 3
    last = sc.statusTracker().getJobInfo(max(jobs[1]))
    assert sc.statusTracker().getStageInfo(max(last.stageIds)).numTasks == min(15, sc.defaultParallelism) > 1


def test_tasks_beyond_the_driver_share_the_sums(spark, monkeypatch):
    rows = _rows(spark)[3]
    plain = fit_boosted(rows, 5, 3, seed=11)
    monkeypatch.setattr(boosting, "BLOCK", 64)
    monkeypatch.setattr(boosting, "PART_BYTES", 2000)
    monkeypatch.setattr(boosting, "SUMMED", 2)
    for a, b in zip(plain.trees, fit_boosted(rows, 5, 3, seed=11).trees, strict=True):
        assert all(np.array_equal(u, v) for u, v in zip(a, b, strict=True))


def test_odd_inputs(spark):
    with pytest.raises(ValueError, match="positive weight"):
        fit_boosted(spark.createDataFrame([], SCHEMA), 2, 3, seed=1)
    same = spark.createDataFrame([(i, [1.0, 2.0], 5.0, 1.0) for i in range(20)] + [(99, [1.0, 2.0], None, 1.0)], SCHEMA)
    flat = fit_boosted(same, 2, 3, seed=1)
    assert flat.trees == [] and flat.base == 5.0 and {r["p"] for r in flat.predict(same, "x", "p").collect()} == {5.0}
    zero = fit_boosted(spark.createDataFrame([(i, [float(i)], 0.0, 1.0) for i in range(50)], SCHEMA), 1, 3, seed=1)
    assert all(not leaf.any() for _, _, leaf in zero.trees)


def test_r_learner_does_not_depend_on_partitions(spark):
    features = _features(spark, 1200)
    u = lambda s: experiment.F.abs(F.xxhash64("customer_unique_id", F.lit(s)) % 1000)
    scores = features.select("customer_unique_id", (u("p") / 1000.0).alias("repeat_probability"))
    spent = features.select("customer_unique_id", u("spent").cast("double").alias("outcome"))
    trial = experiment.experiment_rows(experiment.experiment_frame(features, scores), spent, experiment.Scope(("BA",), "toys"))
    found = []
    for parts in (1, 16):
        out = experiment.r_learner(trial.repartition(parts), rounds=4).scored.collect()
        found.append({r["customer_unique_id"]: (r["m_hat"], r["tau_hat"], r["aipw_score"], r["selected_segment"]) for r in out})
    assert len(found[0]) == 1200 and found[0] == found[1]


def test_models_of_the_same_rows_share_their_cut_points(spark, monkeypatch):
    rows, found, plain = _rows(spark)[3], [], boosting.cut_points
    first = fit_boosted(rows, 5, 3, seed=11)
    monkeypatch.setattr(boosting, "cut_points", lambda *a: found.append(1) or plain(*a))
    for a, b in zip(first.trees, fit_boosted(rows, 5, 3, seed=11, cuts=first.cuts).trees, strict=True):
        assert all(np.array_equal(u, v) for u, v in zip(a, b, strict=True))
    assert not found
    frame = experiment.experiment_frame(_features(spark, 300), None, label_as_score=True)
    spent = frame.select("customer_unique_id", F.abs(F.xxhash64("customer_unique_id") % 90).cast("double").alias("outcome"))
    experiment.r_learner(experiment.experiment_rows(frame, spent, experiment.Scope(("BA",), "toys")), rounds=1)
    assert len(found) == 1


def _with_levels(spark, n=900, levels=30):
    rng = np.random.default_rng(5)
    level = np.minimum(rng.integers(0, 2 * levels, n), levels)  # half of the rows have none
    x = np.column_stack([rng.normal(size=n), *[(level == k).astype(float) for k in range(levels)], rng.random(n) < 0.3])
    y = 30.0 * (level == 4) - 20.0 * (level == 9) * x[:, -1] + 3 * x[:, 0] + rng.normal(size=n)
    return x, y, spark.createDataFrame([(i * 7919, r.tolist(), float(v), 1.0) for i, (r, v) in enumerate(zip(x, y, strict=True))], SCHEMA)


def test_work_of_a_level_grows_with_categories_not_with_their_levels(spark, monkeypatch):
    x, y, rows = _with_levels(spark)
    found, plain = [], boosting._histogram
    monkeypatch.setattr(boosting, "_histogram", lambda *a: found.append(plain(*a)) or found[-1])
    model = fit_boosted(rows.repartition(3), x.shape[1], 4, seed=3, rate=0.3, row_share=1.0, column_share=1.0)
    value = np.full(len(y), y.mean())
    for _ in range(4):
        value += 0.3 * _grow(x, y - value, np.ones(len(y)), model.cuts, 3, 1.0, 1.0)(x)
    got = {r["id"]: r["p"] for r in model.predict(rows, "x", "p").collect()}
    assert [got[i * 7919] for i in range(len(y))] == pytest.approx(value, abs=1e-6)
    # A number, a category and a flag that meets its levels: not 32 bins for each of 32 features.
    assert {f.size // len(f) // 3 for f in found} == {boosting.BINS + 31 + 2}
    # Below the root the smaller child of each node is counted.
    seen = [f[..., 0].sum() for f in found]
    assert all(2 * seen[3 * t + level] <= seen[3 * t] for t in range(4) for level in (1, 2))


def test_bins_stand_for_the_numbers(spark):
    x, _, rows = _with_levels(spark)
    first = fit_boosted(rows, x.shape[1], 3, seed=11)
    plain = {r["id"]: r["p"] for r in first.predict(rows, "x", "p").collect()}
    binned = first.predict(rows, "x", "p", bins=True)
    assert dict(binned.dtypes)["x"] == "binary" and {r["id"]: r["p"] for r in binned.collect()} == plain
    again = first.predict(binned.drop("p").repartition(3), "x", "p")
    assert {r["id"]: r["p"] for r in again.collect()} == plain
    other = fit_boosted(binned.drop("p"), x.shape[1], 3, seed=12, cuts=first.cuts)
    for a, b in zip(fit_boosted(rows, x.shape[1], 3, seed=12).trees, other.trees, strict=True):
        assert all(np.array_equal(u, v) for u, v in zip(a, b, strict=True))


def test_models_store_no_matrix_of_doubles(spark, monkeypatch):
    stored = []
    for plan in (experiment, propensity):
        plain = plan.materialize
        monkeypatch.setattr(plan, "materialize", lambda df, plain=plain: stored.append(df) or plain(df))
    features = _features(spark, 300)
    scored = propensity.fit_scores(features)[0]
    spent = features.select("customer_unique_id", F.abs(F.xxhash64("customer_unique_id") % 90).cast("double").alias("outcome"))
    experiment.run_experiment(features, scored, spent, experiment.Scope(("BA",), "toys"), rounds=1)
    assert len(stored) > 5 and not [d for df in stored for _, d in df.dtypes if "array" in d or "vector" in d]


def test_the_matrix_takes_no_missing_number(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, None, "b")], "is_train int, x double, c string")
    with pytest.raises(Exception, match="null or NaN"):
        design_matrix(rows, ["x"], ["c"], min_count=1)[0].collect()
