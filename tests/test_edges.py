"""A few rows each for the places where semantics are easy to get wrong."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.functions import scalars
from marketlens.plans import dashboard, fact, features, quality
from marketlens.plans.segments import assign_segment_names
from marketlens.schemas import RAW_SCHEMAS


@pytest.fixture(scope="module")
def raw(spark):
    rows = {
        "customers": [("c1", "u1", "x", "SP"), ("c2", "u1", "x", "SP"), ("c3", "u2", "y", "RJ"),
                      ("c4", "u3", "y", "RJ"), ("c5", "u3", "y", "RJ"), ("c6", "u4", "z", "MG")],
        "orders": [
            # empty order: no items, no payment
            ("o1", "c1", "delivered", "2018-01-01 10:00:00", None, "2018-01-20 00:00:00"),
            # items without payment; delivered shortly after midnight of the next day
            ("o2", "c2", "delivered", "2018-01-02 23:00:00", "2018-01-03 01:00:00", "2018-01-10 00:00:00"),
            # same instant for one buyer: the lower id is first; first has no delivery, second has one
            ("o3", "c4", "shipped", "2018-02-01 12:00:00", None, None),
            ("o4", "c5", "delivered", "2018-02-01 12:00:00", "2018-02-20 12:00:00", "2018-02-10 00:00:00"),
            # malformed purchase time drops the order, malformed delivery becomes NULL
            ("o5", "c3", "delivered", "no date", None, None),
            ("o6", "c3", "delivered", "2018-03-01 08:00:00", "31/12/2018", "2018-03-05 00:00:00"),
            # the latest order is canceled
            ("o7", "c6", "canceled", "2018-06-29 00:00:00", None, None),
            ("o8", "nobody", "delivered", "2018-03-01 08:00:00", None, None),
        ],
        "order_items": [
            ("o2", 1, "p1", "s1", 10.10, 1.05), ("o2", 2, "p1", "s2", 10.10, 1.05), ("o2", 3, "p2", None, 0.05, 0.0),
            ("o3", 1, "p3", "s1", None, None),
            ("o4", 1, "p9", "s1", 7.0, 1.0), ("o4", 2, None, "s1", 2.0, 1.0),
            ("o6", 1, "p2", "s3", 5.0, 2.0),
            ("orphan", 1, "p1", "s1", 1.0, 1.0),
        ],
        "order_payments": [
            ("o4", "boleto", 1, 4.0), ("o4", "voucher", 2, 6.0), ("o3", "credit_card", 3, None),
            ("o6", "credit_card", 1, 7.0), (None, "voucher", 1, 1.0),
        ],
        "products": [("p1", "beleza"), ("p2", None), ("p3", "sem_traducao"), (None, "beleza")],
        "category_translation": [("beleza", "health_beauty")],
    }
    return {name: spark.createDataFrame(rows[name], RAW_SCHEMAS[name]) for name in rows}


@pytest.fixture(scope="module")
def orders(raw):
    return {r["order_id"]: r for r in fact.fact_orders(raw).collect()}


def test_empty_order_gets_defaults(orders):
    o = orders["o1"]
    assert (o["item_count"], o["distinct_product_count"], o["seller_count"]) == (0, 0, 0)
    assert (o["item_revenue"], o["freight_value"], o["payment_value"], o["avg_installments"]) == (0.0, 0.0, 0.0, 1.0)
    assert (o["primary_payment_type"], o["product_category"], o["is_late_delivery"]) == ("unknown", "unknown", 0)


def test_payment_falls_back_to_items(orders):
    o = orders["o2"]
    assert o["payment_value"] == pytest.approx(22.35)
    assert (o["item_count"], o["distinct_product_count"], o["seller_count"]) == (3, 2, 2)
    assert o["product_category"] == "health_beauty"


def test_null_money_and_null_keys(orders):
    assert orders["o3"]["item_revenue"] == 0.0 and orders["o3"]["payment_value"] == 0.0
    assert orders["o3"]["product_category"] == "sem_traducao"
    assert (orders["o4"]["item_count"], orders["o4"]["distinct_product_count"]) == (2, 1)
    assert orders["o4"]["payment_value"] == 10.0 and orders["o4"]["avg_installments"] == 1.5
    assert orders["o4"]["primary_payment_type"] == "voucher" and orders["o4"]["is_late_delivery"] == 1


def test_bad_timestamps(orders):
    assert "o5" not in orders and "o8" not in orders
    assert orders["o6"]["delivered_customer_ts"] is None


def test_repeated_catalogue_rows_count_items_again(spark, raw):
    twice = raw["products"].unionByName(raw["products"])
    once = fact.item_summary(raw["order_items"], raw["products"], raw["category_translation"])
    doubled = fact.item_summary(raw["order_items"], twice, raw["category_translation"])
    plain = raw["order_items"].join(twice, "product_id", "left").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("product_id").alias("p"))
    want = {r["order_id"]: (r["n"], r["p"]) for r in plain.collect()}
    assert {r["order_id"]: (r["item_count"], r["distinct_product_count"]) for r in doubled.collect()} == want
    assert once.filter("order_id = 'o2'").first()["item_count"] == 3


def test_first_order_rules(raw):
    rows = {r["customer_unique_id"]: r for r in features.customer_repeat_features(fact.fact_orders(raw)).collect()}
    assert set(rows) == {"u1", "u2", "u3"}
    assert rows["u3"]["first_payment_type"] == "credit_card" and rows["u3"]["first_delivery_days"] is None
    assert rows["u3"]["repeat_purchase_label"] == 1 and rows["u2"]["repeat_purchase_label"] == 0
    assert rows["u1"]["first_order_value"] == 0.0 and rows["u1"]["first_order_month"] == 1


def test_same_order_twice_is_no_repeat(spark, raw):
    facts = fact.fact_orders(raw).filter("order_id = 'o6'")
    both = facts.unionByName(facts)
    assert features.customer_repeat_features(both).first()["repeat_purchase_label"] == 0
    assert features.customer_features(both).first()["order_count"] == 1
    assert not features.orders_are_unique(both) and features.orders_are_unique(facts)


def test_day_differences(spark):
    df = spark.sql("SELECT timestamp_ntz'2018-01-03 01:00:00' AS e, timestamp_ntz'2018-01-02 23:00:00' AS s")
    row = df.select(scalars.day_difference("e", "s").alias("c"), scalars.day_difference("e", "s", "elapsed").alias("d")).first()
    assert (row["c"], row["d"]) == (1, 0)


def test_snapshot_scope(raw):
    facts = fact.fact_orders(raw)
    by_all = {r["customer_unique_id"]: r for r in features.customer_features(facts).collect()}
    by_valid = {r["customer_unique_id"]: r for r in features.customer_features(facts, snapshot_scope="valid").collect()}
    # 2018-03-01 to 2018-06-29 is exactly 120 days: not churned
    assert by_all["u2"]["recency_days"] == 120 and by_all["u2"]["churn_label"] == 0
    assert by_all["u3"]["recency_days"] == 148 and by_all["u3"]["churn_label"] == 1
    assert by_valid["u2"]["recency_days"] == 0


def test_reference_checks_count_orphans_and_null_keys(raw):
    def orphans(child, key, parent):
        return quality.missing_parents("x", raw[child], key, raw[parent], "d").first()["value"]

    assert orphans("orders", "customer_id", "customers") == "1"
    assert orphans("order_items", "order_id", "orders") == "1"
    assert orphans("order_payments", "order_id", "orders") == "1"
    assert orphans("order_items", "product_id", "products") == "2"


def test_duplicate_keys_count_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    row = quality.duplicate_keys("t", df, "k").first()
    assert (row["value"], row["status"]) == ("2", "fail")


def test_null_rate_at_the_limit_passes(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1, None), (3, 1, 1), (4, 1, 1)], "a int, b int, c int")
    got = {r["check"]: (r["status"], r["value_num"]) for r in quality.table_profile("t", df).collect()}
    assert got["raw_null_rate__t__b"] == ("pass", 0.25)
    assert got["raw_null_rate__t__c"] == ("warn", 0.5)
    assert got["raw_row_count__t"] == ("pass", 4.0)


def test_audit_reports_missing_tables(spark, raw):
    present = {name: name != "products" for name in raw}
    some = {name: df for name, df in raw.items() if name != "products"}
    report = quality.audit(spark, present, some, {"fact_orders": fact.fact_orders(raw)})
    got = {r["check"]: r["status"] for r in report.collect()}
    assert got["raw_file_exists__products"] == "fail" and got["processed_table_exists__ab_test_sample"] == "fail"
    assert "referential_integrity__items_to_products" not in got
    assert quality.overall_status(report).first()["overall_status"] == "fail"


def test_audit_on_empty_tables(spark):
    empty = {name: spark.createDataFrame([], schema) for name, schema in RAW_SCHEMAS.items()}
    got = {r["check"]: r["value"] for r in quality.raw_checks(empty).collect()}
    assert got["raw_row_count__orders"] == "0" and got["referential_integrity__orders_to_customers"] == "0"
    assert fact.fact_orders(empty).count() == 0
    assert features.ab_test_sample(fact.fact_orders(empty)).count() == 0


def test_latest_rows_equal_a_full_sort(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=(i * 7919) % 300_000 // 3 * 3)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz").repartition(9)
    for n in (1, 2, 100, 3999, 4000, 9000):
        want = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:n]
        assert sorted(map(tuple, features.latest_rows(df, "ts", "id", n).collect())) == sorted(want)
    gaps = df.withColumn("ts", F.when(F.col("id") % 5 > 0, F.col("ts")))
    known = [r for r in rows if r[0] % 5]
    latest = sorted(known, key=lambda r: (r[1], r[0]), reverse=True)
    lost = [(i, None) for i in range(3995, -1, -5)]
    for n in (1, 3199, 3200, 3205, 4000, 9000):
        got = features.latest_rows(gaps, "ts", "id", n).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, (latest + lost)[:n]))
    same = df.withColumn("ts", F.lit(start).cast("timestamp_ntz"))
    assert [r["id"] for r in features.latest_rows(same, "ts", "id", 3).collect()] == [3999, 3998, 3997]


def test_labels(spark):
    df = spark.createDataFrame([("HEALTH_beauty",), (None,), ("state=SP_x",), ("first_order_value",)], "s string")
    got = [tuple(r) for r in df.select(scalars.category_label("s"), scalars.feature_label("s")).collect()]
    assert got == [
        ("Health beauty", "Health beauty"), ("Unknown", "Unknown"),
        ("State=sp x", "State: Sp x"), ("First order value", "First order value"),
    ]
    names = spark.createDataFrame([("categorical__first_payment_type_boleto",), ("numeric__first_order_value",)], "s string")
    assert [r[0] for r in names.select(scalars.clean_feature_name("s")).collect()] == ["payment=boleto", "first_order_value"]
    assert [scalars.header(c) for c in ("customer_unique_id", "repeat_rate", "cvr")] == ["Customer ID", "Repeat rate", "CVR"]


def test_segment_names_with_ties_and_five_clusters(spark):
    rows = [(0, 10.0, 100.0, 5.0), (1, 20.0, 100.0, 4.0), (2, 30.0, 80.0, 3.0), (3, 40.0, 70.0, 2.0), (4, 50.0, 60.0, 1.0)]
    df = spark.createDataFrame(rows, "cluster int, recency_days double, total_revenue double, order_count double")
    got = {r["cluster"]: r["segment_name"] for r in assign_segment_names(df).collect()}
    assert got == {0: "Champions", 1: "Loyal", 2: "Promising", 3: "At Risk", 4: "At Risk"}


def test_filters_and_empty_views(raw):
    facts = fact.fact_orders(raw)
    kept = dashboard.filtered_orders(facts, "2018-01-02", "2018-02-01", [], None)
    assert {r["order_id"] for r in kept.collect()} == {"o2", "o3", "o4"}
    nothing = dashboard.filtered_orders(facts, "2030-01-01", None, ["SP"], ["x"])
    row = dashboard.kpi_summary(nothing, features.customer_features(nothing)).first()
    assert (row["total_revenue"], row["total_orders"], row["avg_order_value"], row["top_category"]) == (0.0, 0, 0.0, "n/a")


def test_amounts_are_summed_as_they_are(spark):
    rows = [("o1", "a", 1, 0.005), ("o1", "b", 1, 0.004), ("o1", "c", 1, 12.3456), ("o2", "a", 1, float("nan")), ("o2", "b", 1, 2.0), ("o3", "a", 1, 1e18)]
    df = spark.createDataFrame(rows, RAW_SCHEMAS["order_payments"])
    got = {r["order_id"]: r["payment_value"] for r in fact.payment_summary(df).collect()}
    assert got == {"o1": pytest.approx(12.3546), "o2": 2.0, "o3": 1e18}
