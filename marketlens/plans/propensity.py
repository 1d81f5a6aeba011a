"""Repeat-purchase propensity: model, scores, metrics, drivers and lift."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalars import clean_feature_name, feature_label
from marketlens.operators.logistic import fit_logistic, objective
from marketlens.operators.prep import stratified_split
from marketlens.operators.quantiles import with_row
from marketlens.operators.scoring import (
    add_percentile,
    average_precision,
    classification_metrics,
    roc_auc,
    score_summary,
    topk_lift,
)
from marketlens.plans.encode import design_entries
from marketlens.schemas import REPEAT_CATEGORICAL, REPEAT_NUMERIC, REPEAT_TARGET
from marketlens.sources.scratch import materialize

KEY = "customer_unique_id"
SCORE = "repeat_probability"


class SingleClassError(ValueError):
    """The target has one class only."""


@dataclass
class PropensityResult:
    predictions: DataFrame
    metrics: DataFrame
    state_summary: DataFrame
    category_summary: DataFrame
    feature_importance: DataFrame
    topk_summary: DataFrame


def _class_counts(df: DataFrame) -> tuple[int, int]:
    row = df.agg(
        F.count(F.when(F.col(REPEAT_TARGET) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(REPEAT_TARGET) == 0, 1)).alias("neg"),
    ).first()
    return row["pos"], row["neg"]


def fit_scores(
    features: DataFrame,
    test_fraction: float = 0.25,
    seed: int = 42,
    min_count: int = 50,
    max_steps: int = 100,
    gradient: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Scored customers (with ``is_train``) and the coefficient table, on request with the objective's gradient.

    Class weights are n / (2 n_class); the summed weighted loss plus half the squared norm of the coefficients
    is brought to its only minimum by Newton steps, one scan of the training rows each.
    """
    rows = features.select(KEY, *REPEAT_NUMERIC, *REPEAT_CATEGORICAL, REPEAT_TARGET)
    rows = stratified_split(rows.filter(F.col(REPEAT_TARGET).isNotNull()), KEY, REPEAT_TARGET, test_fraction, seed)
    rows = materialize(rows)
    if 0 in _class_counts(rows):
        raise SingleClassError("Buyers with and without a second order are needed to learn from.")
    pos, neg = _class_counts(rows.filter("is_train = 1"))
    if 0 in (pos, neg):
        raise SingleClassError("All training rows have the same label.")

    matrix, entries, names = design_entries(rows, REPEAT_NUMERIC, REPEAT_CATEGORICAL, min_count=min_count)
    matrix, x = materialize(matrix), F.array(*entries)
    total = pos + neg
    weight = F.when(F.col(REPEAT_TARGET) == 1, total / (2.0 * pos)).otherwise(total / (2.0 * neg))
    train = matrix.filter("is_train = 1").select(x.alias("x"), F.col(REPEAT_TARGET).alias("y"), weight.alias("w"))
    model = fit_logistic(train, len(names), penalty=1.0, max_steps=max_steps)

    scored = matrix.select(*rows.columns, model.probability(x).alias(SCORE))
    columns = "position int, name string, coefficient double"
    lines = [(i, name, float(c)) for i, (name, c) in enumerate(zip(names, model.coefficients, strict=True))]
    if gradient:
        # Of the whole objective at the model, the intercept's beside each coefficient's.
        slope = objective(train, np.append(model.intercept, model.coefficients))[1]
        columns += ", gradient double, intercept_gradient double"
        lines = [(*line, float(g), float(slope[0])) for line, g in zip(lines, slope[1:], strict=True)]
    raw = features.sparkSession.createDataFrame(lines, columns)
    drivers = raw.withColumns({"feature": clean_feature_name("name"), "abs_coefficient": F.abs("coefficient")})
    drivers = drivers.select("position", "feature", "coefficient", "abs_coefficient", *raw.columns[3:])
    return materialize(scored), drivers.drop("position").orderBy(F.col("abs_coefficient").desc(), "feature")


def evaluate(scored: DataFrame, score: str = SCORE, label: str = REPEAT_TARGET) -> DataFrame:
    """Metrics of the rows given, one row; the caller chooses the held-out rows."""
    parts = classification_metrics(scored, score, label).drop("target_rate")
    return with_row(
        with_row(parts, roc_auc(scored, score, label)), average_precision(scored, score, label)
    )


def model_metrics(scored: DataFrame) -> DataFrame:
    """Held-out metrics and the target rate of all rows."""
    rate = scored.agg(F.avg(REPEAT_TARGET).alias("repeat_rate"))
    return with_row(evaluate(scored.filter("is_train = 0")), rate).select(
        "accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "repeat_rate", "test_rows"
    )


def predictions(scored: DataFrame) -> DataFrame:
    """Scores of all customers, training rows included, with percentile and band."""
    return add_percentile(scored, SCORE, KEY)


def summary_by(scored: DataFrame, group: str) -> DataFrame:
    return score_summary(scored, group, KEY, REPEAT_TARGET, SCORE).orderBy(
        F.col("avg_repeat_probability").desc(), group
    )


def top_drivers(importance: DataFrame, n: int = 15) -> DataFrame:
    return (
        importance.orderBy(F.col("abs_coefficient").desc(), "feature")
        .limit(n)
        .withColumn("feature_display", feature_label("feature"))
    )


def run_propensity(features: DataFrame, **options) -> PropensityResult:
    scored, drivers = fit_scores(features, **options)
    return PropensityResult(
        predictions=materialize(predictions(scored)),
        metrics=model_metrics(scored),
        state_summary=summary_by(scored, "first_customer_state"),
        category_summary=summary_by(scored, "first_product_category"),
        feature_importance=drivers,
        topk_summary=topk_lift(scored, SCORE, KEY, REPEAT_TARGET),
    )
