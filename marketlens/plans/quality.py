"""Data-quality audit: one frame of (check, status, value, value_num, detail) records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.schemas import FOREIGN_KEYS, PROCESSED_TABLES, RAW_KEYS

CHECK_SCHEMA = T.StructType(
    [
        T.StructField("check", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("detail", T.StringType()),
    ]
)
NULL_RATE_LIMIT = 0.25
NULL_RATE_COLUMNS = 5


def _record(check: Column, status: Column, value: Column, number: Column, detail: str) -> Column:
    return F.struct(
        check.alias("check"),
        status.alias("status"),
        value.cast("string").alias("value"),
        number.cast("double").alias("value_num"),
        F.lit(detail).alias("detail"),
    )


def _count_record(check: str, count: Column, detail: str, must_be_zero: bool) -> Column:
    status = F.when(count == 0, "pass").otherwise("fail") if must_be_zero else F.lit("pass")
    return _record(F.lit(check), status, count, count, detail)


def _rate_record(check: Column, status: Column, rate: Column, detail: str) -> Column:
    rounded = F.round(rate, 4)
    return _record(check, status, rounded.cast("decimal(10,4)"), rounded, detail)


def union_checks(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def presence_checks(spark: SparkSession, present: dict[str, bool], detail: str = "input file of table") -> DataFrame:
    """One record per required input, from a look at the file system."""
    rows = [
        (f"raw_file_exists__{name}", "pass" if there else "fail", str(there).lower(), float(there), f"{detail} {name}")
        for name, there in present.items()
    ]
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def table_profile(name: str, df: DataFrame) -> DataFrame:
    """Row count and the highest null rates of a raw table: one scan, one aggregation."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(c) for c in df.columns],
    )
    rates = F.array(
        *[
            F.struct(
                (-(F.col("_rows") - F.col(c)) / F.col("_rows")).alias("order_key"),
                F.lit(c).alias("column"),
                ((F.col("_rows") - F.col(c)) / F.col("_rows")).alias("rate"),
            )
            for c in df.columns
        ]
    )
    highest = F.slice(F.array_sort(rates), 1, NULL_RATE_COLUMNS)
    null_rates = F.when(
        F.col("_rows") > 0,
        F.transform(
            highest,
            lambda x: _rate_record(
                F.concat(F.lit(f"raw_null_rate__{name}__"), x["column"]),
                F.when(x["rate"] > NULL_RATE_LIMIT, "warn").otherwise("pass"),
                x["rate"],
                "largest shares of missing values",
            ),
        ),
    ).otherwise(F.array().cast("array<struct<check:string,status:string,value:string,value_num:double,detail:string>>"))
    row_count = _count_record(f"raw_row_count__{name}", F.col("_rows"), "rows read from the input", False)
    return counts.select(F.inline(F.concat(F.array(row_count), null_rates)))


def row_counts(tables: dict[str, DataFrame], prefix: str, detail: str) -> DataFrame:
    return union_checks(
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(
                F.inline(F.array(_count_record(f"{prefix}_row_count__{name}", F.col("n"), detail, False)))
            )
            for name, df in tables.items()
        ]
    )


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """The key column dealt by itself into the session's shuffle partitions: a stated number, which Spark does not merge.

    Keys take a few bytes each on the wire, so partitions merged by their bytes hold millions of them.
    """
    return df.select(key).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def duplicate_keys(name: str, df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key value; NULL is a value.

    Keys of a raw table hardly repeat, so they are not combined before the shuffle; one that does is one row in memory.
    """
    surplus = _dealt(df, key).groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return surplus.select(
        F.inline(F.array(_count_record(f"raw_duplicate_key_count__{name}", F.col("n"), f"rows beyond the first per {key}", True)))
    )


def missing_parents(check: str, child: DataFrame, key: str, parent: DataFrame, detail: str) -> DataFrame:
    """Child rows without a parent; a NULL key counts.

    Children are counted per key first, so a key that holds a third of the rows is one row in
    the anti join. Written as an anti join because NOT IN returns nothing once a parent is NULL.
    The counts meet the parents in their stated number of partitions, so neither side is merged.
    """
    keys = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    orphans = keys.join(_dealt(parent, key), key, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return orphans.select(
        F.inline(F.array(_count_record(f"referential_integrity__{check}", F.col("n"), detail, True)))
    )


def fact_checks(fact: DataFrame) -> DataFrame:
    """Share of positive payments and the purchase time range, from one scan."""
    stats = fact.agg(
        F.avg(F.when(F.col("payment_value") > 0, 1).otherwise(0)).alias("positive"),
        F.min("order_purchase_ts").alias("lo"),
        F.max("order_purchase_ts").alias("hi"),
    )
    form = "yyyy-MM-dd HH:mm:ss"
    span = F.to_json(
        F.struct(
            F.date_format("lo", form).alias("min_order_purchase_ts"),
            F.date_format("hi", form).alias("max_order_purchase_ts"),
        )
    )
    return stats.select(
        F.inline(
            F.array(
                _rate_record(
                    F.lit("fact_orders__positive_payment_rate"),
                    F.lit("pass"),
                    F.col("positive"),
                    "orders with a payment above zero",
                ),
                _record(
                    F.lit("fact_orders__date_range"),
                    F.lit("pass"),
                    span,
                    F.lit(None),
                    "first and last purchase time",
                ),
            )
        )
    )


def target_rate(repeat_features: DataFrame) -> DataFrame:
    rate = repeat_features.agg(F.avg("repeat_purchase_label").alias("rate"))
    return rate.select(
        F.inline(
            F.array(
                _rate_record(
                    F.lit("customer_repeat_features__repeat_rate"),
                    F.lit("pass"),
                    F.col("rate"),
                    "share of buyers with a second order",
                )
            )
        )
    )


def missing_processed(spark: SparkSession, names: list[str]) -> DataFrame:
    rows = [
        (f"processed_table_exists__{name}", "fail", "false", 0.0, "derived table is not there") for name in names
    ]
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def raw_checks(raw: dict[str, DataFrame]) -> DataFrame:
    """Profiles, key and reference checks of whichever raw tables are there."""
    frames = [table_profile(name, df) for name, df in raw.items()]
    frames += [duplicate_keys(name, raw[name], key) for name, key in RAW_KEYS.items() if name in raw]
    frames += [
        missing_parents(check, raw[child], key, raw[parent], detail)
        for child, key, parent, check, detail in FOREIGN_KEYS
        if child in raw and parent in raw
    ]
    return union_checks(frames)


def processed_checks(spark: SparkSession, processed: dict[str, DataFrame | None]) -> DataFrame:
    there = {name: df for name in PROCESSED_TABLES if (df := processed.get(name)) is not None}
    absent = [name for name in PROCESSED_TABLES if name not in there]
    frames = []
    if there:
        frames.append(row_counts(there, "processed", "rows of the derived table"))
    if absent:
        frames.append(missing_processed(spark, absent))
    if "fact_orders" in there:
        frames.append(fact_checks(there["fact_orders"]))
    if "customer_repeat_features" in there:
        frames.append(target_rate(there["customer_repeat_features"]))
    return union_checks(frames)


def audit(
    spark: SparkSession,
    present: dict[str, bool],
    raw: dict[str, DataFrame],
    processed: dict[str, DataFrame | None],
) -> DataFrame:
    frames = [presence_checks(spark, present)]
    if raw:
        frames.append(raw_checks(raw))
    frames.append(processed_checks(spark, processed))
    return union_checks(frames)


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def overall_status(report: DataFrame) -> DataFrame:
    """One row: checks per status and the verdict; a warning does not fail the audit."""

    def n(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))

    return report.agg(
        F.when(n("fail") > 0, "fail").otherwise("pass").alias("overall_status"),
        n("pass").alias("passed"),
        n("warn").alias("warned"),
        n("fail").alias("failed"),
        F.count(F.lit(1)).alias("checks"),
    )


def whole_report(report: DataFrame) -> DataFrame:
    """The verdict with all checks under it: one record, as an audit has a bounded number of checks."""
    checks = report.agg(F.sort_array(F.collect_list(F.struct(*CHECK_SCHEMA.fieldNames()))).alias("results"))
    return overall_status(report).crossJoin(F.broadcast(checks))
