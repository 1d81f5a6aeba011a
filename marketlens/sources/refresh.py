"""Refresh of tables stored in month folders: a digest per month decides which of them are written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.files import MONTH_COLUMN, path_exists

#: Digits of doubles that a digest sees; the last bits of a sum depend on the order of its terms.
DIGITS = 4
#: Folder of rows without a date.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Refreshed:
    """Months whose folders were written, and those whose folders went; rows without a date are month ''."""

    written: list[str]
    removed: list[str]


def month_of(date_column: str) -> Column:
    return F.coalesce(F.date_format(date_column, "yyyy-MM"), F.lit(""))


def month_digests(rows: DataFrame, date_column: str) -> dict[str, tuple]:
    """Month -> row count and two sums of row hashes: one aggregation, whatever the order of the rows.

    One line per calendar month reaches the driver.
    """
    shown = [F.round(c, DIGITS) if kind == "double" else F.col(c) for c, kind in rows.dtypes]
    # The hash skips nulls, so a flag per column says where they are.
    seen = [*shown, *[F.col(c).isNull() for c in rows.columns]]
    hashes = rows.select(month_of(date_column).alias("month"), F.xxhash64(*seen).alias("a"), F.xxhash64(F.lit(1), *seen).alias("b"))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("string")
    sums = hashes.groupBy("month").agg(F.count("*").alias("n"), total("a").alias("a"), total("b").alias("b"))
    return {r["month"]: (r["n"], r["a"], r["b"]) for r in sums.collect()}


def _recorded(spark: SparkSession, path: str) -> dict[str, tuple]:
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return {}
    return {r["month"]: (r["n"], r["a"], r["b"]) for r in spark.read.parquet(path).collect()}


def refresh_monthly(
    spark: SparkSession, data_dir: str, name: str, digests: dict[str, tuple], build: Callable[[list[str]], DataFrame], date_column: str
) -> Refreshed:
    """Bring a stored table up to its source: ``build`` gives the rows of the months whose digest moved.

    The digests are those of the source and are recorded per table once its folders are in place. A run that dies in
    between leaves the old record, and the next one writes the same months again; a lost record means all months.
    """
    path, record = f"{data_dir}/{name}", f"{data_dir}/_digests/{name}"
    before = _recorded(spark, record) if path_exists(spark, path) else {}
    changed = sorted(m for m, digest in digests.items() if before.get(m) != digest)
    gone = sorted(before.keys() - digests.keys())
    if changed:
        rows = build(changed).withColumn(MONTH_COLUMN, F.date_format(date_column, "yyyy-MM"))
        writer = rows.hint("rebalance", MONTH_COLUMN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(MONTH_COLUMN).parquet(path)
        # A changed month may have no rows left in a table that keeps some rows only.
        kept = {r[0] or "" for r in rows.select(MONTH_COLUMN).distinct().collect()} if before else set(changed)
        gone_here = [m for m in changed if m not in kept]
    else:
        gone_here = []
    for month in [*gone, *gone_here]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{MONTH_COLUMN}={month or NO_MONTH}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if changed or gone:
        lines = [(m, *digest) for m, digest in sorted(digests.items())]
        spark.createDataFrame(lines, "month string, n long, a string, b string").coalesce(1).write.mode("overwrite").parquet(record)
    return Refreshed(changed, gone)


def of_months(stored: DataFrame, months: list[str]) -> DataFrame:
    """Rows of some months of a table stored by month; only their folders are read."""
    return stored.filter(F.coalesce(F.col(MONTH_COLUMN).cast("string"), F.lit("")).isin(months)).drop(MONTH_COLUMN)
