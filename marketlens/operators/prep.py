"""Feature preparation: imputation, scaling, rare categories, seeded splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import uniform
from marketlens.operators.quantiles import frozen, quantile_name, quantiles, with_row
from marketlens.operators.ranking import PART, POS, sorted_layout
from marketlens.sources.scratch import materialize

# Fixed value: the name under which rare categories appear in feature tables.
RARE = "infrequent_sklearn"
UNSEEN = "__unseen__"


def fit_medians(df: DataFrame, columns: list[str], method: str = "exact") -> DataFrame:
    """One row: the median of each column, under the column's own name."""
    row = quantiles(df, {c: [0.5] for c in columns}, method)
    return row.select(*[F.col(quantile_name(c, 0.5)).alias(c) for c in columns])


def columns_with_nulls(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 0]


def fit_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the most frequent value of each column, the smallest one on a tie."""
    counts = (
        df.select(*columns)
        .unpivot([], columns, "name", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = {
        c: F.min_by(F.when(F.col("name") == c, F.col("value")),
                    F.when(F.col("name") == c, F.struct(-F.col("n"), F.col("value"))))
        for c in columns
    }
    return counts.agg(*[agg.alias(c) for c, agg in best.items()])


def fill_from(df: DataFrame, row: DataFrame) -> DataFrame:
    """Replace NULLs in the columns that ``row`` names by that row's values."""
    columns = row.columns
    fills = row.select(*[F.col(c).alias(f"_fill_{c}") for c in columns])
    return with_row(df, fills).select(
        *[F.coalesce(c, f"_fill_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def impute_median(
    df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, method: str = "exact"
) -> DataFrame:
    """Fill NULLs with medians that are computed now; columns without NULLs are left alone."""
    source = df if fit_on is None else fit_on
    gaps = columns if fit_on is not None else columns_with_nulls(df, columns)
    filled = fill_from(df, frozen(fit_medians(source, gaps, method))) if gaps else df
    return filled.select(
        *[F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in filled.columns]
    )


def impute_mode(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    return fill_from(df, fit_modes(df if fit_on is None else fit_on, columns))


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population standard deviation of each column."""
    return df.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_std_{c}") for c in columns],
    )


def apply_scaler(df: DataFrame, columns: list[str], stats: DataFrame, suffix: str = "_z") -> DataFrame:
    scaled = [
        (
            (F.col(c) - F.col(f"_mean_{c}"))
            / F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(F.lit(1.0))
        ).alias(c + suffix)
        for c in columns
    ]
    return with_row(df, stats).select(*df.columns, *scaled)


def standardize(
    df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, suffix: str = "_z"
) -> DataFrame:
    """Add (x - mean) / population std for each column; a constant column gives 0."""
    return apply_scaler(df, columns, fit_scaler(df if fit_on is None else fit_on, columns), suffix)


def category_levels(df: DataFrame, columns: list[str], min_count: int = 50) -> DataFrame:
    """(name, value, rows, level): training categories and the level that each is encoded as.

    One pass for all columns; counts combine before the shuffle.
    """
    counts = (
        df.select(*columns)
        .unpivot([], columns, "name", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return counts.withColumn(
        "level", F.when(F.col("rows") < min_count, RARE).otherwise(F.col("value"))
    )


def pool_rare_categories(
    df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, min_count: int = 50
) -> DataFrame:
    """Add ``<column>_level``: rare training categories share one level, unseen ones get another.

    The levels are stored and joined without a hint: Spark broadcasts them if their files are
    small and sorts otherwise.
    """
    levels = materialize(category_levels(df if fit_on is None else fit_on, columns, min_count))
    out = df
    for c in columns:
        lookup = levels.filter(F.col("name") == c).select(
            F.col("value").alias(f"_key_{c}"), F.col("level").alias(f"_level_{c}")
        )
        out = out.join(lookup, F.col(c) == F.col(f"_key_{c}"), "left").drop(f"_key_{c}")
    return out.select(
        *df.columns, *[F.coalesce(f"_level_{c}", F.lit(UNSEEN)).alias(f"{c}_level") for c in columns]
    )


def seeded_split(df: DataFrame, key: str, fraction: float, seed: int, name: str = "is_train") -> DataFrame:
    """Mark about ``fraction`` of the rows as test rows (``name`` = 0) by a seeded hash of the key.

    The hash is independent of any label, so each stratum is split in the same proportion
    without a shuffle, and a row keeps its side however the data is partitioned.
    """
    is_test = uniform(key, seed, "split") < fraction
    return df.withColumn(name, F.when(is_test, 0).otherwise(1))


def stratified_split(
    df: DataFrame, key: str, stratum: str, fraction: float, seed: int, name: str = "is_train"
) -> DataFrame:
    """Seeded split with an exact share of test rows in every stratum.

    The rows are sorted once by (stratum, hash, key). A row's rank inside its stratum is its place in its
    partition plus the stratum's rows in earlier partitions; those counts have one row per partition and
    stratum, so rows meet them by partition number, and a stratum that holds most rows stays spread.
    """
    drawn = df.withColumn("_u", uniform(key, seed, "split"))
    laid = sorted_layout(drawn, [F.col(stratum).asc_nulls_first(), F.col("_u"), F.col(key)])
    counts = laid.groupBy(PART, stratum).agg(F.count(F.lit(1)).alias("_n"), F.min(POS).alias("_from"))
    inside = Window.partitionBy(stratum)
    before = inside.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(PART).alias("_p"), "_from", F.col(stratum).alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(inside).alias("_total"),
    )
    joined = laid.join(counts, (F.col(PART) == F.col("_p")) & F.col(stratum).eqNullSafe(F.col("_s")))
    rank = F.col("_before") + F.col(POS) - F.col("_from") + 1
    is_test = rank <= F.round(F.col("_total") * fraction)
    return joined.select(*df.columns, F.when(is_test, 0).otherwise(1).alias(name))
