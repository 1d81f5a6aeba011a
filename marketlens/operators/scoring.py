"""Evaluation of scored rows: percentiles, bands, lift, ranking and threshold metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalars import propensity_band
from marketlens.operators.quantiles import with_row
from marketlens.operators.ranking import global_row_number, running_totals

SLICES = (0.05, 0.10, 0.20)


def add_percentile(df: DataFrame, score: str, key: str) -> DataFrame:
    """Add propensity_percentile = ascending row number / rows (ties by key) and the band."""
    ranked = global_row_number(df, [F.col(score), F.col(key)], "_rank")
    total = ranked.agg(F.count(F.lit(1)).alias("_total"))
    return (
        with_row(ranked, total)
        .withColumn("propensity_percentile", F.col("_rank") / F.col("_total"))
        .withColumn("propensity_band", propensity_band("propensity_percentile"))
        .drop("_rank", "_total")
    )


def topk_lift(
    df: DataFrame, score: str, key: str, label: str, fractions: tuple[float, ...] = SLICES
) -> DataFrame:
    """Rate and lift of the best-scored fractions: one rank, one aggregation for all slices."""
    ranked = global_row_number(
        df.select(key, score, label), [F.col(score).desc(), F.col(key)], "_rank"
    )
    totals = ranked.agg(F.count(F.lit(1)).alias("_total"), F.avg(label).alias("_baseline"))
    ranked = with_row(ranked, totals)
    aggs = []
    for i, f in enumerate(fractions):
        inside = F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(f)))
        aggs += [
            F.count(F.when(inside, 1)).alias(f"n{i}"),
            F.avg(F.when(inside, F.col(label))).alias(f"rate{i}"),
        ]
    wide = ranked.agg(F.first("_baseline").alias("_baseline"), *aggs)
    slices = F.array(
        *[
            F.struct(
                F.lit(f"Top {int(f * 100)}%").alias("population_slice"),
                F.col(f"n{i}").alias("customers"),
                F.col(f"rate{i}").alias("repeat_rate"),
                F.when(F.col("_baseline") > 0, F.col(f"rate{i}") / F.col("_baseline")).alias("lift_vs_baseline"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    return wide.select(F.inline(slices))


def classification_metrics(df: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined), target rate and rows in one pass."""
    predicted = F.col(score) >= cut
    actual = F.col(label) == 1

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counts = df.agg(
        n(predicted & actual).alias("tp"),
        n(predicted & ~actual).alias("fp"),
        n(~predicted & actual).alias("fn"),
        n(predicted == actual).alias("hits"),
        n(actual).alias("positives"),
        F.count(F.lit(1)).alias("rows"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        share(F.col("hits"), F.col("rows")).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        share(F.col("positives"), F.col("rows")).alias("target_rate"),
        F.col("rows").alias("test_rows"),
    )


def _score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    positive = F.count(F.when(F.col(label) == 1, 1))
    return df.groupBy(F.col(score).alias("score")).agg(
        positive.alias("pos"), (F.count(F.lit(1)) - positive).alias("neg")
    )


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from rank sums with average ties; NULL with one class only."""
    running = running_totals(_score_counts(df, score, label), ["score"], ["neg"])
    pairs = F.col("pos").cast("decimal(19,0)") * (2 * F.col("cum_neg") - F.col("neg")).cast("decimal(19,0)")
    sums = running.agg(F.sum(pairs).alias("pairs"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    twice = F.col("pairs").cast("double")
    possible = F.col("p").cast("double") * F.col("n").cast("double")
    return sums.select(F.when(possible > 0, twice / 2 / possible).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step-wise average precision: sum over thresholds of recall gain times precision."""
    running = running_totals(_score_counts(df, score, label), [F.col("score").desc()], ["pos", "neg"])
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = running.agg(F.sum(F.col("pos") * precision).alias("area"), F.sum("pos").alias("p"))
    return sums.select(F.when(F.col("p") > 0, F.col("area") / F.col("p")).alias("average_precision"))


def score_summary(df: DataFrame, group: str, key: str, label: str, score: str) -> DataFrame:
    """Customers, observed rate and mean score per group."""
    return df.groupBy(group).agg(
        F.count_distinct(key).alias("customers"),
        F.avg(label).alias("actual_repeat_rate"),
        F.avg(score).alias("avg_repeat_probability"),
    )
