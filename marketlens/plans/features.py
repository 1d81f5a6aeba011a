"""Tables derived from the order facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import (
    day_difference,
    money_sum,
    flag,
    hash_bucket,
    known,
)
from marketlens.operators.quantiles import exact_quantiles, quantile_name, with_row
from marketlens.schemas import CHURN_DAYS, VALID_STATUSES
from marketlens.sources.scratch import materialize


def valid_orders(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("order_status").isin(VALID_STATUSES))


def _orders(unique_orders: bool) -> Column:
    """COUNT(DISTINCT order_id); a plain count where the caller has checked that ids are unique."""
    return F.count("order_id") if unique_orders else F.count_distinct("order_id")


def orders_are_unique(fact: DataFrame) -> bool:
    """Whether no order id repeats: one shuffle of ids that saves one in each derived table."""
    row = fact.agg(F.count("order_id").alias("n"), F.count_distinct("order_id").alias("d")).first()
    return row["n"] == row["d"]


def customer_features(
    fact: DataFrame,
    churn_days: int = CHURN_DAYS,
    snapshot_scope: str = "all",
    day_mode: str = "calendar",
) -> DataFrame:
    """Recency, frequency, value per customer against the last purchase in the data.

    Orders and categories are counted as (customer, order) and (customer, category) pairs, so no row
    is multiplied for two distinct counts, and a hot customer's orders are spread over many tasks. Orders are dealt by
    their id into the session's shuffle partitions, a stated number, which Spark does not merge by bytes on the wire;
    order facts that were not stored are dealt that way already and are not moved again.
    """
    valid = valid_orders(fact)
    scope = {"all": fact, "valid": valid}[snapshot_scope]
    snapshot = scope.agg(F.max("order_purchase_ts").alias("snapshot_ts"))
    one = F.lit(1).cast("long")
    parts = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_order = valid.repartition(parts, "order_id").groupBy("customer_unique_id", "order_id").agg(
        money_sum("payment_value").alias("revenue"),
        F.count(known("payment_value")).alias("paid"),
        F.sum("item_count").alias("items"),
        F.sum("is_late_delivery").alias("late"),
        F.count("is_late_delivery").alias("late_rows"),
        F.min("order_purchase_ts").alias("first_ts"),
        F.max("order_purchase_ts").alias("last_ts"),
    )
    by_order = by_order.withColumn("orders", F.when(F.col("order_id").isNotNull(), one)).drop("order_id")
    by_category = valid.filter(F.col("product_category").isNotNull()).select("customer_unique_id", "product_category").distinct()
    by_category = by_category.select("customer_unique_id", one.alias("categories"))
    sums = by_order.unionByName(by_category, allowMissingColumns=True).groupBy("customer_unique_id").agg(
        F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("order_count"),
        F.sum("revenue").alias("total_revenue"),
        (F.sum("revenue") / F.sum("paid")).alias("avg_order_value"),
        F.sum("items").alias("total_items"),
        (F.sum("late") / F.sum("late_rows")).alias("late_delivery_rate"),
        F.min("first_ts").alias("first_purchase_ts"),
        F.max("last_ts").alias("last_purchase_ts"),
        F.coalesce(F.sum("categories"), F.lit(0)).cast("long").alias("category_count"),
    )
    recency = day_difference("snapshot_ts", "last_purchase_ts", day_mode)
    return with_row(sums, snapshot).select(
        *sums.columns,
        recency.alias("recency_days"),
        day_difference("last_purchase_ts", "first_purchase_ts", day_mode).alias("tenure_days"),
        flag(recency > churn_days).alias("churn_label"),
    )


def _daily(fact: DataFrame, keys: list[str], unique_orders: bool) -> DataFrame:
    return (
        valid_orders(fact)
        .groupBy(F.to_date("order_purchase_ts").alias("order_date"), *keys)
        .agg(_orders(unique_orders).alias("orders"), money_sum("payment_value").alias("revenue"))
    )


def category_daily_sales(fact: DataFrame, unique_orders: bool = False) -> DataFrame:
    return _daily(fact, ["product_category"], unique_orders)


def state_category_daily_sales(fact: DataFrame, unique_orders: bool = False) -> DataFrame:
    return _daily(fact, ["customer_state", "product_category"], unique_orders)


# First-order columns and their names in customer_repeat_features.
_FIRST = {
    "customer_state": "first_customer_state",
    "product_category": "first_product_category",
    "primary_payment_type": "first_payment_type",
    "payment_value": "first_order_value",
    "item_count": "first_item_count",
    "freight_value": "first_freight_value",
    "avg_installments": "first_avg_installments",
    "is_late_delivery": "first_late_delivery",
}


def customer_repeat_features(fact: DataFrame, day_mode: str = "calendar") -> DataFrame:
    """Each customer's first order (ties by order id) and whether another order exists.

    One aggregation: more than one distinct order id is the same as smallest id <> largest id,
    so no distinct count and no window are needed, and a hot customer is combined before the
    shuffle.
    """
    row = F.struct(*_FIRST, "delivered_customer_ts", "order_purchase_ts")
    grouped = valid_orders(fact).groupBy("customer_unique_id").agg(
        F.min_by(row, F.struct("order_purchase_ts", "order_id")).alias("f"),
        F.min("order_id").alias("lowest"),
        F.max("order_id").alias("highest"),
    )
    return grouped.select(
        "customer_unique_id",
        *[F.col(f"f.{old}").alias(new) for old, new in _FIRST.items()],
        day_difference("f.delivered_customer_ts", "f.order_purchase_ts", day_mode).alias("first_delivery_days"),
        F.month("f.order_purchase_ts").alias("first_order_month"),
        flag(F.col("lowest") != F.col("highest")).alias("repeat_purchase_label"),
    )


def first_orders_by_window(fact: DataFrame) -> DataFrame:
    """The first order of each customer by ROW_NUMBER, for comparison with the aggregate form."""
    w = Window.partitionBy("customer_unique_id").orderBy("order_purchase_ts", "order_id")
    return (
        valid_orders(fact).withColumn("order_rank", F.row_number().over(w)).filter("order_rank = 1")
        .select("customer_unique_id", "order_id", "order_purchase_ts", "payment_value")
    )


def latest_rows(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the latest time (ties: larger key), rows without a time last.

    Two small histograms, by day and then by second of the day that matters, give a time that
    about n rows reach; only those rows are sorted. Each histogram has one row per day or per
    second of one day, so its running sum is bounded work.
    """
    down = Window.orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def cutoff(slots: DataFrame, missing: Column) -> DataFrame:
        """Latest slot at which the rows from the top reach the number missing, and the rows above it."""
        running = with_row(slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")), missing)
        running = running.withColumn("cum", F.sum("n").over(down))
        return running.agg(
            F.max(F.when(F.col("cum") >= F.col("missing"), F.col("slot"))).alias("slot"),
            F.coalesce(F.max(F.when(F.col("cum") < F.col("missing"), F.col("cum"))), F.lit(0)).alias("above"),
        )

    spark = df.sparkSession
    day = F.to_date(ts)
    second = F.date_trunc("SECOND", F.col(ts)).cast("timestamp_ntz")
    timed = df.filter(F.col(ts).isNotNull())
    by_day = cutoff(timed.select(day.alias("slot")), spark.range(1).select(F.lit(n).alias("missing"))).first()
    if by_day["slot"] is None:
        untimed = df.filter(F.col(ts).isNull())
        return timed.unionByName(untimed.orderBy(F.col(key).desc()).limit(n - by_day["above"]))
    inside = timed.filter(
        (F.col(ts) >= F.lit(by_day["slot"]).cast("timestamp_ntz"))
        & (F.col(ts) < F.date_add(F.lit(by_day["slot"]), 1).cast("timestamp_ntz"))
    )
    missing = spark.range(1).select(F.lit(n - by_day["above"]).alias("missing"))
    by_second = cutoff(inside.select(second.alias("slot")), missing).first()
    reached = timed.filter(F.col(ts) >= F.lit(by_second["slot"]).cast("timestamp_ntz"))
    return reached.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def assigned_variant(key: str) -> Column:
    return F.when(hash_bucket(F.col(key)) % 2 == 0, "control").otherwise("treatment")


def ab_test_sample(fact: DataFrame, rows: int | None = None) -> DataFrame:
    """Paid valid orders with a hashed variant; converted = value at least the median.

    All of them, unless the caller asks for the latest ``rows``.
    """
    sample = valid_orders(fact).filter(known("payment_value").isNotNull()).select("order_id", "order_purchase_ts", "payment_value")
    sample = materialize(sample)
    if rows is not None:
        sample = latest_rows(sample, "order_purchase_ts", "order_id", rows)
    middle = exact_quantiles(sample, {"payment_value": [0.5]}).select(F.col(quantile_name("payment_value", 0.5)).alias("middle"))
    return with_row(sample, middle).select(
        assigned_variant("order_id").alias("variant"),
        flag(F.col("payment_value") >= F.col("middle")).alias("converted"),
        F.col("payment_value").alias("order_value"),
    )
