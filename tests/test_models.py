"""Behaviour of models, forecasts and experiments."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.functions.scalars import uniform
from marketlens.plans import experiment, forecast, propensity, segments
from marketlens.schemas import SEGMENT_FEATURES

START = dt.date(2018, 1, 1)


def _series(spark, name, values):
    rows = [(START + dt.timedelta(days=i), "SP", name, float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "order_date date, customer_state string, product_category string, revenue double")


def _features(spark, n=4000):
    u = lambda s: uniform("customer_unique_id", 3, s)
    df = spark.range(n).withColumnRenamed("id", "customer_unique_id")
    pick = lambda s, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u(s) * len(values)) + 1).cast("int"))
    return df.select(
        "customer_unique_id",
        pick("state", ["SP", "RJ", "MG", "BA"]).alias("first_customer_state"),
        pick("cat", ["health_beauty", "toys", "auto"]).alias("first_product_category"),
        pick("pay", ["credit_card", "boleto"]).alias("first_payment_type"),
        F.round(20 + 300 * u("value"), 2).alias("first_order_value"),
        (1 + F.floor(3 * u("items"))).alias("first_item_count"),
        F.round(40 * u("freight"), 2).alias("first_freight_value"),
        (1 + F.floor(5 * u("inst"))).cast("double").alias("first_avg_installments"),
        F.when(u("late") < 0.1, 1).otherwise(0).alias("first_late_delivery"),
        F.when(u("nodel") > 0.02, (2 + F.floor(20 * u("del"))).cast("int")).alias("first_delivery_days"),
        (1 + F.floor(12 * u("month"))).cast("int").alias("first_order_month"),
        F.when(u("label") < F.when(F.col("first_product_category") == "toys", 0.5).otherwise(0.15), 1)
        .otherwise(0).alias("repeat_purchase_label"),
    )


@pytest.fixture(scope="module")
def features(spark):
    return _features(spark).persist()


def test_series_grid_and_guard(spark):
    daily = _series(spark, "gap", [1, None, None, 4] + [2] * 30).unionByName(_series(spark, "long", [3] * 35))
    series = forecast.daily_series(daily)
    gap = [r["revenue"] for r in series.filter("product_category = 'gap'").orderBy("order_date").collect()]
    assert gap == [1.0, 0.0, 0.0, 4.0] + [2.0] * 30
    status = {r["product_category"]: r["status"] for r in forecast.series_status(series).collect()}
    assert status == {"gap": "too short", "long": "ok"}
    with pytest.raises(ValueError, match="35"):
        forecast.scope_forecast(daily, "gap", method="ets")
    with pytest.raises(ValueError, match="none of"):
        forecast.scope_forecast(daily, "long", method="magic")
    with pytest.raises(forecast.EmptyScopeError):
        forecast.scope_forecast(daily, "absent")
    assert forecast.daily_series(_series(spark, "one", [5])).count() == 1


@pytest.mark.parametrize("method", forecast.METHODS)
def test_constant_series(spark, method):
    rows = forecast.scope_forecast(_series(spark, "c", [50] * 60), "c", periods=14, method=method).collect()
    assert len(rows) == 14 and {r["customer_state"] for r in rows} == {"ALL"}
    assert min(r["order_date"] for r in rows) == START + dt.timedelta(days=60)
    for r in rows:
        assert r["forecast_revenue"] == pytest.approx(50, abs=1e-6)
        assert r["upper_revenue"] - r["lower_revenue"] == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("method", ["ets", "sarimax"])
def test_weekly_pattern_is_followed(spark, method):
    week = [100, 20, 30, 40, 50, 60, 200]
    rng = np.random.default_rng(1)
    values = [week[i % 7] + rng.normal(0, 1) for i in range(210)]
    rows = forecast.forecast(forecast.daily_series(_series(spark, "w", values)), method, periods=14).orderBy("order_date").collect()
    for i, r in enumerate(rows):
        assert r["forecast_revenue"] == pytest.approx(week[(210 + i) % 7], abs=12)
        assert 0 <= r["lower_revenue"] <= r["forecast_revenue"] <= r["upper_revenue"]


def test_moving_average_against_numpy(spark):
    rng = np.random.default_rng(2)
    y = np.round(rng.gamma(2, 50, 100), 2)
    out = forecast.moving_average_forecast(forecast.daily_series(_series(spark, "m", y)), 5, 0.2).orderBy("order_date").collect()
    w = min(28, max(7, len(y) // 8))
    mean = np.array([np.nan if i < 6 else y[max(0, i - w + 1) : i + 1].mean() for i in range(len(y))])
    sd = np.nanstd(y - mean, ddof=1)
    for h, r in enumerate(out, start=1):
        assert r["forecast_revenue"] == pytest.approx(y[-w:].mean())
        assert r["upper_revenue"] == pytest.approx(y[-w:].mean() + 1.2815515655446004 * sd * h**0.5)
    assert forecast.interval_z(0.05) == pytest.approx(1.959964, abs=1e-6)


def test_default_scope_and_overlay(spark):
    daily = _series(spark, "a", [5] * 40).unionByName(_series(spark, "b", [6] * 40))
    assert forecast.default_scope(daily).first()["product_category"] == "b"
    chosen = forecast.select_scope(daily)
    assert {r[0] for r in chosen.select("customer_state").distinct().collect()} == {"SP"}
    series = forecast.daily_series(chosen)
    both = forecast.overlay(series, forecast.forecast(series, "moving_average", 10))
    assert {r["kind"]: r["count"] for r in both.groupBy("kind").count().collect()} == {"actual": 40, "forecast": 10}
    no_state = daily.drop("customer_state")
    assert forecast.select_scope(no_state).first()["customer_state"] == "ALL"


def test_propensity(spark, features):
    result = propensity.run_propensity(features)
    m = result.metrics.first()
    assert m["roc_auc"] > 0.6 and m["average_precision"] > m["repeat_rate"]
    assert 850 < m["test_rows"] < 1150
    preds = result.predictions
    assert preds.count() == 4000 and preds.filter("repeat_probability NOT BETWEEN 0 AND 1").count() == 0
    top = result.feature_importance.first()
    assert top["feature"].startswith("first_category=")
    assert result.state_summary.count() == 4 and result.category_summary.first()["first_product_category"] == "toys"
    lift = {r["population_slice"]: r for r in result.topk_summary.collect()}
    assert lift["Top 20%"]["customers"] == 800 and lift["Top 20%"]["lift_vs_baseline"] > 1.3


def test_propensity_needs_two_classes(spark, features):
    with pytest.raises(propensity.SingleClassError):
        propensity.fit_scores(features.withColumn("repeat_purchase_label", F.lit(0)))


def test_logistic_matches_newton(spark, features):
    """Coefficients equal those of a direct solution of the penalised, class-weighted likelihood."""
    from marketlens.operators.prep import stratified_split
    from marketlens.plans.encode import design_matrix
    from marketlens.schemas import REPEAT_CATEGORICAL, REPEAT_NUMERIC

    _, drivers = propensity.fit_scores(features)
    rows = stratified_split(features, "customer_unique_id", "repeat_purchase_label", 0.25, 42)
    matrix, names = design_matrix(rows, REPEAT_NUMERIC, REPEAT_CATEGORICAL)
    train = matrix.filter("is_train = 1").select("features", "repeat_purchase_label").collect()
    x = np.array([np.append(r[0].toArray(), 1.0) for r in train])
    y = np.array([r[1] for r in train], dtype=float)
    n, pos = len(y), y.sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    beta, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 0.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        beta -= np.linalg.lstsq(hess, grad, rcond=None)[0]
    got = {r["feature"]: r["coefficient"] for r in drivers.collect()}
    clean = [n_.replace("numeric__", "").replace("categorical__first_product_category_", "first_category=")
             .replace("categorical__first_customer_state_", "state=").replace("categorical__first_payment_type_", "payment=")
             for n_ in names]
    for name, value in zip(clean, beta[:-1], strict=True):
        assert got[name] == pytest.approx(value, abs=1e-9)


def test_segments(spark):
    rows = [(i, 60 - c, c, r, r / c, k, 0) for i, (c, r, k) in
            enumerate([(1, 100.0, 1), (5, 5000.0, 3), (9, 20000.0, 5), (2, 900.0, 2)] * 40)]
    df = spark.createDataFrame(rows, "customer_unique_id long, recency_days int, order_count long, total_revenue double, "
                                     "avg_order_value double, category_count long, churn_label int")
    named, summary = segments.segment_customers(segments.cluster_customers(df, restarts=5))
    assert named.count() == 160 and summary.count() == 4
    assert {r["customers"] for r in summary.collect()} == {40}
    best = named.filter("order_count = 9").select("segment_name").distinct().collect()
    assert [r[0] for r in best] == ["Champions"]
    with pytest.raises(segments.TooFewRowsError):
        segments.cluster_customers(df.limit(3), restarts=1)


def test_clusters_do_not_depend_on_partitions_and_reach_a_plain_optimum(spark):
    rng = np.random.default_rng(12)
    rows = [(i, *(float(x) for x in rng.normal(size=5) + rng.integers(0, 3))) for i in range(700)] + [(9000 + i, *[1.0] * 5) for i in range(50)]
    names = ["recency_days", "order_count", "total_revenue", "avg_order_value", "category_count"]
    df = spark.createDataFrame(rows, "customer_unique_id long, " + ", ".join(f"{n} double" for n in names))
    found = [{r["customer_unique_id"]: r["cluster"] for r in segments.cluster_customers(df.repartition(n), restarts=8).collect()} for n in (1, 16)]
    assert found[0] == found[1] and len(found[0]) == 750
    used = df.toPandas()[SEGMENT_FEATURES].to_numpy()
    z = (used - used.mean(axis=0)) / used.std(axis=0)
    cluster = np.array([found[0][r[0]] for r in rows])
    centres = np.array([z[cluster == c].mean(axis=0) for c in range(4)])
    away = ((z[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (away.argmin(axis=1) == cluster).mean() > 0.999  # a fixed point of the plain algorithm
    costs = []
    for seed in range(20):
        c = z[np.random.default_rng(seed).choice(len(z), 4, replace=False)]
        for _ in range(200):
            near = ((z[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([z[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(4)])
        costs.append(((z - c[near]) ** 2).sum())
    assert ((z - centres[cluster]) ** 2).sum() <= min(costs) * 1.01


@pytest.fixture(scope="module")
def trial(spark, features):
    """The features with a known effect: customers of one state who first bought toys spend 800 more when treated."""
    scores = features.select("customer_unique_id", uniform("customer_unique_id", 9, "p").alias("repeat_probability"))
    spent = features.select("customer_unique_id", (300 * uniform("customer_unique_id", 4, "spent")).alias("outcome"))
    scope = experiment.Scope(("BA",), "toys")
    rows = experiment.experiment_rows(experiment.experiment_frame(features, scores), spent, scope)
    helped = F.col("core_market") * F.col("target_category_affinity")
    return rows.withColumn("outcome", F.col("outcome") + 800 * helped * F.col("treatment")).withColumn("helped", helped).persist()


def test_arms_follow_a_hash(trial):
    s = experiment.experiment_summary(trial, experiment.Scope(("BA",), "toys")).first()
    assert s["customers"] == 4000 and abs(s["treated_customers"] - 2000) < 150
    assert s["treated_customers"] + s["control_customers"] == 4000 and 0.05 < s["target_rate"] < 0.12


def test_later_revenue_leaves_the_first_order_out(spark):
    rows = [("a", "o1", 1, 10.0), ("a", "o2", 2, 5.0), ("a", "o3", 2, 7.0), ("b", "o4", 1, 3.0)]
    df = spark.createDataFrame(rows, "customer_unique_id string, order_id string, d int, payment_value double")
    facts = df.selectExpr("*", "'shipped' AS order_status", "timestamp_ntz'2020-01-01' + make_dt_interval(d) AS order_purchase_ts")
    got = {r[0]: r[1] for r in experiment.later_revenue(facts).collect()}
    assert got == {"a": 12.0, "b": 0.0}


def test_welch_recovers_a_large_effect(trial):
    shifted = trial.withColumn("outcome", 300 * uniform("customer_unique_id", 4, "spent") + 100 * F.col("treatment"))
    row = experiment.welch_test(shifted).first()
    assert abs(row["estimate"] - 100) < 3 * row["standard_error"]
    assert row["is_significant_05"] and row["p_value"] < 1e-6


@pytest.mark.parametrize(("t", "v", "p"), [(0.0, 5.0, 1.0), (1.0, 1.0, 0.5), (2.0, 10.0, 0.0733880), (-2.042272, 30.0, 0.05), (1.96, 1e7, 0.0499958), (12.706205, 1.0, 0.05), (40.0, 50.0, 0.0)])
def test_p_values(spark, t, v, p):
    row = spark.createDataFrame([(t, v)], "statistic double, freedom double")
    assert experiment.with_p_value(row).first()["p_value"] == pytest.approx(p, abs=1e-6)


def test_mean_tests_on_tiny_groups(spark):
    df = spark.createDataFrame([(1, 5.0), (0, 1.0), (0, 2.0)], "treatment int, outcome double")
    row = experiment.welch_test(df).first()
    assert row["p_value"] is None and row["is_significant_05"] is False
    single = experiment.with_p_value(experiment.mean_statistics(df.filter("treatment = 1"), "outcome")).first()
    assert single["standard_error"] is None and single["p_value"] is None


def test_experiment_frame_needs_scores(features):
    with pytest.raises(ValueError):
        experiment.experiment_frame(features, None)
    leak = experiment.experiment_frame(features, None, label_as_score=True)
    assert leak.filter("repeat_probability <> repeat_purchase_label").count() == 0


def test_r_learner_finds_the_helped_segment(trial):
    out = experiment.r_learner(trial, rounds=15)
    row = out.result.first()
    assert row["train_rows"] + row["holdout_rows"] == 4000 and abs(row["holdout_rows"] - 2000) <= 1
    scored = out.scored
    assert scored.columns == experiment.SAMPLE_COLUMNS and scored.count() == 4000
    assert scored.filter("split = 'train' AND (tau_hat IS NOT NULL OR selected_segment <> 0)").count() == 0
    chosen = scored.filter("selected_segment = 1").join(trial.select("customer_unique_id", "helped"), "customer_unique_id")
    assert chosen.agg(F.avg("helped")).first()[0] > 0.8
    assert abs(row["estimate"] - 800 * chosen.agg(F.avg("helped")).first()[0]) < 4 * row["standard_error"]
    table = experiment.method_comparison(experiment.welch_test(trial), out.result).collect()
    assert [r["method"][:10] for r in table] == ["Difference", "R-learner "]
    assert all(r["reject_at_5pct"] in ("Yes", "No") for r in table)


def test_kmeans_step_is_one_job_and_adds_up_all_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, centres = rng.integers(-(1 << 24), 1 << 24, (500, 3)), rng.normal(0, 1 << 23, (7, 4, 3))
    points = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "_id long, a long, b long, c long").repartition(3)
    monkeypatch.setattr(segments, "BLOCK", 64)
    monkeypatch.setattr(segments, "SUMMED", 2)
    blocks = segments._point_blocks(points, ["a", "b", "c"], 500)
    assert blocks.getNumPartitions() > 2 and sorted(i for ids, _ in blocks.collect() for i in ids) == list(range(500))
    nearest = ((x[:, None, None, :] - centres[None]) ** 2).sum(axis=3).argmin(axis=2)
    plain = {(r, c): (int(own.sum()), *x[own].sum(axis=0).tolist()) for r in range(7) for c in range(4) if (own := nearest[:, r] == c).any()}
    assert segments._cluster_sums(blocks, centres) == plain
    monkeypatch.setattr(segments, "SUMMED", 32)
    spark.sparkContext.setJobGroup("kmeans", "one step")
    assert segments._cluster_sums(blocks, centres) == plain
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("kmeans")) == 1
    spark.sparkContext._jsc.clearJobGroup()
    blocks.unpersist()
