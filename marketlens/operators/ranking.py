"""Global ranks and running totals without a single-task window.

The rows are range-sorted once (bounds are sampled on the whole key, so ties of the leading
column are spread by the next one) and written with their partition number and position. Only
one number per partition then has to be summed up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.scratch import materialize

PART, POS = "_part", "_pos"
_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def sorted_layout(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Store ``df`` in global key order with columns _part and _pos (0-based)."""
    numbered = df.orderBy(*keys).withColumn("_seq", F.monotonically_increasing_id())
    return materialize(
        numbered.withColumn(PART, F.shiftright("_seq", _LOCAL_BITS))
        .withColumn(POS, F.col("_seq").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_seq")
    )


def _offsets(laid: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Totals of all earlier partitions: one row per partition, so one task and a broadcast do."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy(PART).agg(*[total.alias(name) for name, total in totals.items()])
    return sums.select(PART, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before_{name}") for name in totals])


def global_row_number(df: DataFrame, keys: list[Column | str], name: str = "row_number") -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY keys); the keys must end in a unique column."""
    laid = sorted_layout(df, keys)
    offsets = _offsets(laid, {"rows": F.count(F.lit(1))})
    return laid.join(F.broadcast(offsets), PART).select(
        *df.columns, (F.col("_before_rows") + F.col(POS) + 1).alias(name)
    )


def running_totals(df: DataFrame, keys: list[Column | str], sums: list[str]) -> DataFrame:
    """Inclusive running totals ``cum_<x>`` of long columns in global key order.

    ``df`` must be unique by ``keys``: aggregate first, then the key space is what is sorted, and
    a value that many rows share is one row here.
    """
    laid = sorted_layout(df, keys)
    offsets = _offsets(laid, {name: F.sum(name) for name in sums})
    upto = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return laid.join(F.broadcast(offsets), PART).select(
        *df.columns,
        *[(F.col(f"_before_{name}") + F.sum(name).over(upto)).alias(f"cum_{name}") for name in sums],
    )
