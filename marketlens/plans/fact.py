"""The order fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalars import known, late_delivery, money_sum, timestamp_or_null


#: Partitions of (order, product) and (order, seller) pairs per partition that the items are read in.
PAIR_PARTS = 8


def payment_summary(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        money_sum("payment_value").alias("payment_value"),
        F.avg("payment_installments").alias("avg_installments"),
        F.max("payment_type").alias("primary_payment_type"),
    )


def product_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """product_id with its category, English where there is a translation, and its number of copies.

    The two lookups meet before the items do, so the large side is joined once. A product that
    is listed twice counts its items twice, as a plain join would; ``copies`` carries that.
    """
    named = products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name").alias("product_category"),
    )
    return named.groupBy("product_id").agg(
        F.max("product_category").alias("product_category"), F.count(F.lit(1)).alias("copies")
    )


def _spread(items: DataFrame, *pair: str) -> DataFrame:
    """The items dealt by a pair of columns, into a number of partitions that grows with them.

    The number is stated, so Spark does not merge partitions by their bytes on the wire: pairs of ids
    shrink to a few bytes there, and millions of them would meet in the memory of one task.
    """
    least = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return items.repartition(max(least, PAIR_PARTS * items.rdd.getNumPartitions()), *pair)


def item_summary(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Per order: items, distinct products and sellers, money, largest category name.

    The distinct counts are counts of (order, product) and (order, seller) pairs. Both pair
    tables are plain hash aggregations that spread even a huge order over many tasks, and the
    category is looked up for pairs, not for items. No broadcast hint: a catalogue may be large,
    and Spark checks its size itself. Pairs are dealt into parts that do not grow with the input.
    """
    categories = product_categories(products, translation)
    copies = F.coalesce("copies", F.lit(1))
    by_product = (
        _spread(items, "order_id", "product_id")
        .groupBy("order_id", "product_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(known("price")).alias("price"),
            F.sum(known("freight_value")).alias("freight"),
        )
        .join(categories, "product_id", "left")
        .select(
            "order_id",
            (F.col("n") * copies).alias("items"),
            F.col("product_id").isNotNull().cast("long").alias("products"),
            F.lit(0).cast("long").alias("sellers"),
            (F.col("price") * copies).alias("price"),
            (F.col("freight") * copies).alias("freight"),
            "product_category",
        )
    )
    by_seller = (
        _spread(items.filter(F.col("seller_id").isNotNull()).select("order_id", "seller_id"), "order_id", "seller_id")
        .distinct()
        .select("order_id", F.lit(1).cast("long").alias("sellers"))
    )
    return (
        by_product.unionByName(by_seller, allowMissingColumns=True)
        .groupBy("order_id")
        .agg(
            F.sum("items").alias("item_count"),
            F.sum("products").alias("distinct_product_count"),
            F.sum("sellers").alias("seller_count"),
            F.sum("price").alias("item_revenue"),
            F.sum("freight").alias("freight_value"),
            F.max("product_category").alias("product_category"),
        )
    )


def fact_orders(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per order with a purchase time. Items and payments are aggregated before the join.

    The orders are dealt by each join's key into the session's shuffle partitions. It is the number that Spark would
    choose, but a stated one, so it does not merge the join's partitions by their bytes on the wire.
    """
    orders = tables["orders"].select(
        "order_id",
        "customer_id",
        "order_status",
        timestamp_or_null("order_purchase_timestamp").alias("order_purchase_ts"),
        timestamp_or_null("order_delivered_customer_date").alias("delivered_customer_ts"),
        timestamp_or_null("order_estimated_delivery_date").alias("estimated_delivery_ts"),
    ).filter(F.col("order_purchase_ts").isNotNull())
    customers = tables["customers"].select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state"
    )
    items = item_summary(tables["order_items"], tables["products"], tables["category_translation"])
    payments = payment_summary(tables["order_payments"])
    parts = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        orders.repartition(parts, "customer_id")
        .join(customers, "customer_id")
        .repartition(parts, "order_id")
        .join(items, "order_id", "left")
        .join(payments, "order_id", "left")
        .select(
            "order_id",
            "customer_unique_id",
            "customer_city",
            "customer_state",
            "order_status",
            "order_purchase_ts",
            "delivered_customer_ts",
            "estimated_delivery_ts",
            F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count"),
            F.coalesce("distinct_product_count", F.lit(0)).cast("long").alias("distinct_product_count"),
            F.coalesce("seller_count", F.lit(0)).cast("long").alias("seller_count"),
            F.coalesce("item_revenue", F.lit(0.0)).alias("item_revenue"),
            F.coalesce(items["freight_value"], F.lit(0.0)).alias("freight_value"),
            F.coalesce(
                F.col("payment_value"), F.col("item_revenue") + items["freight_value"], F.lit(0.0)
            ).alias("payment_value"),
            F.coalesce("avg_installments", F.lit(1.0)).alias("avg_installments"),
            F.coalesce("primary_payment_type", F.lit("unknown")).alias("primary_payment_type"),
            F.coalesce("product_category", F.lit("unknown")).alias("product_category"),
            late_delivery("delivered_customer_ts", "estimated_delivery_ts").alias("is_late_delivery"),
        )
    )
