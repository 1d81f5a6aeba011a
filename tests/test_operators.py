"""Distributed operators against brute force on small skewed inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import prep, quantiles, ranking, scoring


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    # a third of the rows share one score
    rows = [(i, 0.5 if i % 3 == 0 else rng.randrange(40) / 40, int(rng.random() < 0.3)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, s double, y int").repartition(13)


def test_row_number(scored):
    rows, df = scored
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    got = ranking.global_row_number(df, [F.col("s").desc(), F.col("id")])
    assert {r["id"]: r["row_number"] for r in got.collect()} == want


def test_running_totals(spark):
    rows = [(i, i % 7) for i in range(1, 2000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(11)
    want = dict(zip([r[0] for r in rows], np.cumsum([r[1] for r in rows]).tolist(), strict=True))
    assert {r["k"]: r["cum_v"] for r in ranking.running_totals(df, ["k"], ["v"]).collect()} == want


def test_exact_quantiles(spark):
    rng = random.Random(9)
    rows = [(1.0 if i % 3 == 0 else rng.gauss(0, 5), None if i % 10 == 0 else i % 17, None) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    row = quantiles.exact_quantiles(df, {"a": [0.0, 0.5, 0.85, 1.0], "b": [0.25, 0.95], "c": [0.5]}).first()
    a, b = [r[0] for r in rows], [r[1] for r in rows if r[1] is not None]
    for p in (0.0, 0.5, 0.85, 1.0):
        assert row[quantiles.quantile_name("a", p)] == pytest.approx(np.quantile(a, p), abs=1e-12)
    for p in (0.25, 0.95):
        assert row[quantiles.quantile_name("b", p)] == pytest.approx(np.quantile(b, p), abs=1e-12)
    assert row[quantiles.quantile_name("c", 0.5)] is None
    close = quantiles.approx_quantiles(df, {"a": [0.85]}).first()[0]
    assert close == pytest.approx(np.quantile(a, 0.85), abs=0.05)


@pytest.mark.parametrize("keep", [1, 40, 10**6])
def test_quantiles_narrow_to_the_same_values(spark, monkeypatch, keep):
    monkeypatch.setattr(quantiles, "KEEP", keep)
    rng = random.Random(4)
    a = [rng.choice([0.0, 1e-300, -1e300, float("inf"), 7.0]) if i % 2 else rng.gauss(0, 1) ** 9 for i in range(6000)]
    b = [5 if i % 3 else rng.randrange(10**12) for i in range(6000)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b long").repartition(7)
    ps = [0.0, 0.01, 0.3333, 0.5, 0.95, 0.999]
    row = quantiles.exact_quantiles(df, {"a": ps, "b": ps}).first()
    for name, values in (("a", sorted(a)), ("b", sorted(b))):
        for p in ps:
            at = p * 5999
            low, high = values[int(at)], values[min(5999, int(at) + 1)]
            if at - int(at) < 1e-9 or low == high:
                assert row[quantiles.quantile_name(name, p)] == pytest.approx(low, rel=1e-12)
            elif abs(high) != float("inf"):
                assert row[quantiles.quantile_name(name, p)] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)


def test_quantiles_with_nan_and_of_one_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, None), (nan, 2.0, None), (3.0, 2.0, None), (None, 2.0, None), (2.0, 2.0, None)], "a double, b double, c double")
    row = quantiles.exact_quantiles(df, {"a": [0.0, 0.5, 1.0], "b": [0.3], "c": [0.5]}).first()
    assert tuple(row)[:2] == (1.0, 2.5) and math.isnan(row[2]) and tuple(row)[3:] == (2.0, None)
    assert tuple(quantiles.exact_quantiles(df.limit(0), {"a": [0.5]}).first()) == (None,)


def test_percentile_and_bands(spark):
    for n in (19, 20, 100):
        df = spark.createDataFrame([(i, float(i // 4)) for i in range(n)], "id long, s double")
        got = {r["id"]: r for r in scoring.add_percentile(df, "s", "id").collect()}
        for i in range(n):
            p = (i + 1) / n
            assert got[i]["propensity_percentile"] == p
            assert got[i]["propensity_band"] == ("High" if p >= 0.9 else "Medium" if p >= 0.6 else "Low")


def test_topk_lift(spark):
    for n in (19, 20, 100):
        rows = [(i, float(i % 5), i % 2) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, s double, y int")
        ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
        base = sum(r[2] for r in rows) / n
        for got, f in zip(scoring.topk_lift(df, "s", "id", "y").collect(), (0.05, 0.1, 0.2), strict=True):
            k = max(1, int(n * f))
            rate = sum(r[2] for r in ordered[:k]) / k
            assert (got["customers"], got["repeat_rate"]) == (k, rate)
            assert got["lift_vs_baseline"] == pytest.approx(rate / base)
    none = spark.createDataFrame([(1, 0.5, 0)], "id long, s double, y int")
    assert scoring.topk_lift(none, "s", "id", "y").first()["lift_vs_baseline"] is None


def test_ranking_metrics(scored, spark):
    rows, df = scored
    pos = [r[1] for r in rows if r[2]]
    neg = np.array([r[1] for r in rows if not r[2]])
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert scoring.roc_auc(df, "s", "y").first()[0] == pytest.approx(auc, abs=1e-9)
    ap, tp, seen = 0.0, 0, 0
    for s in sorted({r[1] for r in rows}, reverse=True):
        gain = sum(1 for r in rows if r[1] == s and r[2])
        tp, seen = tp + gain, seen + sum(1 for r in rows if r[1] == s)
        ap += gain / len(pos) * tp / seen
    assert scoring.average_precision(df, "s", "y").first()[0] == pytest.approx(ap, abs=1e-9)
    assert scoring.roc_auc(df.filter("y = 0"), "s", "y").first()[0] is None
    zero = scoring.classification_metrics(df.withColumn("s", F.lit(0.0)), "s", "y").first()
    assert (zero["precision"], zero["recall"], zero["f1"]) == (0.0, 0.0, 0.0)


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame([(1.0, "b", 3.0), (None, "b", 3.0), (4.0, "a", 3.0), (9.0, "a", 3.0), (2.0, None, 3.0)],
                               "x double, c string, k double")
    assert [r["x"] for r in prep.impute_median(df, ["x"]).collect()][1] == 3.0
    assert [r["c"] for r in prep.impute_mode(df, ["c"]).collect()][4] == "a"
    scaled = prep.standardize(df, ["x", "k"]).collect()
    xs = np.array([1.0, 4.0, 9.0, 2.0])
    assert scaled[0]["x_z"] == pytest.approx((1.0 - xs.mean()) / xs.std())
    assert scaled[0]["k_z"] == 0.0


def test_rare_categories(spark):
    train = spark.createDataFrame([("r",)] * 49 + [("f",)] * 50 + [(None,)], "c string")
    new = spark.createDataFrame([("r",), ("f",), ("new",), (None,)], "c string")
    got = [r["c_level"] for r in prep.pool_rare_categories(new, ["c"], train).collect()]
    assert sorted(got) == sorted([prep.RARE, "f", prep.UNSEEN, prep.UNSEEN])


def test_split_is_repeatable_and_close(spark):
    df = spark.range(20000)
    share = prep.seeded_split(df, "id", 0.25, 42).agg(F.avg(1 - F.col("is_train"))).first()[0]
    assert share == pytest.approx(0.25, abs=0.01)
    one = prep.seeded_split(df.repartition(3), "id", 0.25, 42).orderBy("id").collect()
    assert one == prep.seeded_split(df.repartition(17), "id", 0.25, 42).orderBy("id").collect()


def test_hot_order_product_and_buyer(spark):
    """One order, one product and one buyer hold a third of the rows; results equal pandas."""
    import pandas as pd

    from marketlens.plans import fact, features
    from marketlens.schemas import RAW_SCHEMAS

    rng = random.Random(3)
    items = [
        (f"o{0 if i % 3 == 0 else rng.randrange(400)}", i, f"p{1 if i % 3 == 1 else rng.randrange(50)}",
         f"s{rng.randrange(9)}", rng.randrange(1, 5000) / 100, 1.25)
        for i in range(6000)
    ]
    orders = [(f"o{i}", f"c{i}", "delivered", f"2018-01-{1 + i % 28:02d} 00:00:00", None, None) for i in range(400)]
    customers = [(f"c{i}", "u0" if i % 3 == 0 else f"u{i}", "x", "SP") for i in range(400)]
    raw = {
        "orders": orders, "customers": customers, "order_items": items, "order_payments": [],
        "products": [(f"p{i}", f"cat{i % 6}") for i in range(50)], "category_translation": [],
    }
    tables = {name: spark.createDataFrame(rows, RAW_SCHEMAS[name]) for name, rows in raw.items()}
    facts = fact.fact_orders(tables)
    got = {r["order_id"]: r for r in facts.collect()}

    pdf = pd.DataFrame(items, columns=["o", "i", "p", "s", "price", "freight"])
    pdf["cat"] = pdf["p"].map(lambda p: f"cat{int(p[1:]) % 6}")
    for order, group in pdf.groupby("o"):
        r = got[order]
        assert (r["item_count"], r["distinct_product_count"], r["seller_count"]) == (len(group), group["p"].nunique(), group["s"].nunique())
        assert r["item_revenue"] == pytest.approx(group["price"].sum())
        assert r["product_category"] == group["cat"].max()

    buyers = {r["customer_unique_id"]: r for r in features.customer_features(facts).collect()}
    assert buyers["u0"]["order_count"] == 134
    first = {r["customer_unique_id"]: r for r in features.customer_repeat_features(facts).collect()}
    assert first["u0"]["first_order_value"] == got["o0"]["payment_value"]
    assert first["u0"]["repeat_purchase_label"] == 1 and first["u1"]["repeat_purchase_label"] == 0
