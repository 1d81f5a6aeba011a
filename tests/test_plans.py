"""Physical plans that must hold at scale, and results that must not depend on partitioning."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import oracle_sql, queries
from marketlens.functions.scalars import within_dates
from marketlens.plans import fact, features, quality
from marketlens.sources import binding

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["fact_orders", "customer_features", "state_category_daily_sales", "customer_repeat_features"])
def test_no_python_and_no_single_task_over_rows(spark, no_broadcast, name):
    plan = plan_of(queries()[name](spark, SF_DIR))
    assert not re.search(r"Python|ArrowEval|MapInPandas", plan)
    # the one single-partition exchange allowed is below the snapshot date: a one-row aggregate
    assert plan.count("Exchange SinglePartition") <= (1 if name == "customer_features" else 0)
    assert "CartesianProduct" not in plan


def test_large_sides_are_never_hinted(spark, no_broadcast):
    assert "BroadcastHashJoin" not in plan_of(fact.fact_orders(binding.retail_tables(spark, SF_DIR)))


def test_columns_are_pruned_into_the_scan(spark):
    daily = plan_of(features.category_daily_sales(fact.fact_orders(binding.retail_tables(spark, SF_DIR))))
    lineitem = [line for line in daily.splitlines() if "lineitem.parquet" in line]
    assert lineitem and all("l_linenumber" not in line for line in lineitem)


@pytest.mark.parametrize("name", ["customer_features", "kpi_summary"])
def test_distinct_counts_do_not_multiply_rows(spark, name):
    assert "Expand" not in plan_of(queries()[name](spark, SF_DIR))


def test_first_order_window_limits_before_the_shuffle(spark):
    plan = plan_of(queries()["first_orders"](spark, SF_DIR))
    assert plan.count("WindowGroupLimit") == 2


def test_date_filter_reaches_the_scan(spark):
    stored = spark.read.parquet(f"{SF_DIR}/orders.parquet").withColumnRenamed("o_orderdate", "order_purchase_ts")
    plan = plan_of(stored.filter(within_dates("order_purchase_ts", "1996-01-01", "1996-12-31")))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1996-01-01" in plan
    assert "LessThan(o_orderdate" in plan


INVARIANT = [
    "fact_orders", "customer_features", "customer_repeat_features", "ab_test_sample", "daily_series",
    "forecast_moving_average", "propensity_bands", "topk_lift", "roc_auc", "impute_median",
    "experiment_rows", "stratified_split", "uplift_cutoff", "dq_report",
]


@pytest.mark.parametrize("name", INVARIANT)
def test_results_do_not_depend_on_partitioning(spark, name):
    assert name in oracle_sql()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n, adaptive in (("1", "true"), ("16", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            df = queries()[name](spark, SF_DIR)
            results.append(sorted(map(str, df.select(*sorted(df.columns)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert results[0] == results[1]


def test_pairs_of_items_are_dealt_into_parts_that_grow_with_the_items(spark):
    rows = [(o, i, (o + i) % 7, o % 3, 2.0, 1.0) for o in range(40) for i in range(3)]
    columns = "order_id long, order_item_id int, product_id long, seller_id long, price double, freight_value double"
    products = spark.createDataFrame([(p, f"c{p}") for p in range(7)], "product_id long, product_category_name string")
    english = spark.createDataFrame([], "product_category_name string, product_category_name_english string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for parts in (1, 3 * least):
        out = fact.item_summary(spark.createDataFrame(rows, columns).repartition(parts), products, english)
        plan = plan_of(out)
        dealt = {int(n) for n in re.findall(r"hashpartitioning\(order_id#\d+L, (?:product|seller)_id#\d+L, (\d+)\)", plan)}
        assert dealt == {max(least, fact.PAIR_PARTS * parts)}
        got = {r["order_id"]: (r["item_count"], r["distinct_product_count"], r["seller_count"], r["product_category"]) for r in out.collect()}
        assert got == {o: (3, 3, 1, max(f"c{(o + i) % 7}" for i in range(3))) for o in range(40)}


def test_joins_of_the_facts_have_a_stated_number_of_partitions(spark, no_broadcast):
    """Spark merges partitions that it numbered itself by their bytes; those of a stated number stay apart."""
    plan = plan_of(fact.fact_orders(binding.retail_tables(spark, SF_DIR)))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    stated = rf"Exchange hashpartitioning\(\w+#\d+L, {parts}\), REPARTITION_BY_NUM"
    assert len(re.findall(stated, plan)) == 2  # by customer_id and by order_id


def test_stored_facts_are_dealt_by_order_and_others_are_not_moved_again(spark, no_broadcast):
    columns = "customer_unique_id long, order_id long, order_status string, payment_value double, item_count long, is_late_delivery int, order_purchase_ts timestamp_ntz, product_category string"
    lines = [(o % 3, o, "delivered", 2.0, 1, 0, None, f"c{o % 2}") for o in range(12)] + [(None, None, "delivered", 1.0, 1, 0, None, None)] * 2
    rows = spark.createDataFrame(lines, columns)
    by_order = r"Exchange hashpartitioning\(order_id#\d+L, \d+\), REPARTITION_BY_NUM"
    counted = features.customer_features(rows)
    assert len(re.findall(by_order, plan_of(counted))) == 1 and not re.search(r"hashpartitioning\(customer_unique_id#\d+L, order_id", plan_of(counted))
    dealt = plan_of(features.customer_features(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "order_id")))
    assert len(re.findall(by_order, dealt)) == 3  # once in each of the three scans of the facts
    got = {r["customer_unique_id"]: (r["order_count"], r["category_count"], r["total_revenue"]) for r in counted.collect()}
    assert got == {0: (4, 2, 8.0), 1: (4, 2, 8.0), 2: (4, 2, 8.0), None: (0, 0, 2.0)}


def test_key_counts_have_a_stated_number_of_partitions(spark, no_broadcast):
    """Keys shrink to a few bytes on the wire; partitions merged by their bytes would hold millions of them."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    child = spark.createDataFrame([(k,) for k in [1, 1, 2, 9, 9, None, None]], "k long")
    parent = spark.createDataFrame([(k,) for k in [1, 2, 2, 3, None]], "k long")
    checks = {"2": quality.missing_parents("x", child.filter("k IS NOT NULL"), "k", parent, "d"), "4": quality.missing_parents("x", child, "k", parent, "d"),
              "3": quality.duplicate_keys("t", child, "k"), "1": quality.duplicate_keys("t", parent, "k")}
    for value, check in checks.items():
        assert len(re.findall(rf"Exchange hashpartitioning\(k#\d+L, {parts}\), REPARTITION_BY_NUM", plan_of(check))) == 1
        assert [r["value"] for r in check.collect()] == [value]
        assert "AQEShuffleRead coalesced" not in plan_of(check)
