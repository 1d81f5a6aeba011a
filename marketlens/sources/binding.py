"""Retail tables over the TPC-H-like test tables.

Every derived value is integer arithmetic on keys, so another SQL engine gets the same rows.
Timestamps are wall-clock (without time zone) throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.files import path_exists

# Part types and their English category; SMALL has none on purpose.
TRANSLATIONS = {
    "STANDARD": "health_beauty",
    "PROMO": "sports_leisure",
    "LARGE": "furniture_decor",
    "ECONOMY": "computers",
    "MEDIUM": "watches_gifts",
}

# Experiment scope that suits the test tables.
CORE_STATES = ["NATION_2", "NATION_7", "NATION_19"]
TARGET_CATEGORY = "watches_gifts"

SOURCE_OF = {
    "customers": "customer",
    "orders": "orders",
    "order_items": "lineitem",
    "order_payments": "orders",
    "products": "part",
    "category_translation": "part",
}


# Columns of the source tables that the binding uses; a stated schema saves a look at each footer.
_SOURCES = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double, l_tax double",
    "part": "p_partkey bigint, p_type string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    half_year = (F.year("o_orderdate") - 1990) * 2 + (F.month("o_orderdate") > 6).cast("int")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_orderkey").alias("customer_id"),
            (F.col("o_custkey") * 100 + half_year).alias("customer_unique_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_orderkey AS customer_id",
        "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status",
        """CASE WHEN o_orderkey % 997 <> 0
                THEN o_orderdate + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 86400)
           END AS order_purchase_timestamp""",
        """CASE WHEN o_orderkey % 997 <> 0 AND o_orderkey % 53 <> 0
                THEN o_orderdate + make_dt_interval(CAST(2 + o_orderkey * 31 % 28 AS INT), 0, 0,
                                                    o_orderkey * 7919 % 86400 + o_orderkey * 17 % 86400)
           END AS order_delivered_customer_date""",
        """CASE WHEN o_orderkey % 997 <> 0 THEN o_orderdate + INTERVAL '20' DAY
           END AS order_estimated_delivery_date""",
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
    )


def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment for most orders and a second one, a voucher, for some: one scan, exploded."""
    return (
        _read(spark, sf_dir, "orders")
        .filter("o_orderkey % 11 <> 0")
        .selectExpr(
            "o_orderkey AS order_id",
            """inline(filter(array(
                 named_struct(
                   'payment_type', CASE o_orderkey % 4 WHEN 2 THEN 'boleto' WHEN 3 THEN 'debit_card' ELSE 'credit_card' END,
                   'payment_installments', CAST(1 + o_orderkey % 10 AS INT),
                   'payment_value', o_totalprice),
                 CASE WHEN o_orderkey % 7 = 0 THEN named_struct(
                   'payment_type', 'voucher', 'payment_installments', 1, 'payment_value', 10.0D) END
               ), x -> x IS NOT NULL))""",
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "CASE WHEN p_partkey % 41 <> 0 THEN p_type END AS product_category_name",
    )


def category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct part types that have an English name."""
    english = F.lit(None).cast("string")
    for name, value in TRANSLATIONS.items():
        english = F.when(F.col("p_type") == name, value).otherwise(english)
    return (
        _read(spark, sf_dir, "part")
        .filter(F.col("p_type").isin(list(TRANSLATIONS)))
        .select("p_type")
        .distinct()
        .select(F.col("p_type").alias("product_category_name"), english.alias("product_category_name_english"))
    )


def retail_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "customers": customers(spark, sf_dir),
        "orders": orders(spark, sf_dir),
        "order_items": order_items(spark, sf_dir),
        "order_payments": order_payments(spark, sf_dir),
        "products": products(spark, sf_dir),
        "category_translation": category_translation(spark, sf_dir),
    }


def available_sources(spark: SparkSession, sf_dir: str) -> dict[str, bool]:
    return {name: path_exists(spark, f"{sf_dir}/{source}.parquet") for name, source in SOURCE_OF.items()}
