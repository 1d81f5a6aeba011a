"""The whole product in one call: raw tables in, processed and report tables out."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.plans import dashboard, features, forecast, quality, reports
from marketlens.plans import experiment as experiment_plans
from marketlens.plans.experiment import Scope, run_experiment
from marketlens.plans.fact import fact_orders
from marketlens.plans.propensity import run_propensity
from marketlens.plans.segments import cluster_customers, segment_customers
from marketlens.schemas import PROCESSED_TABLES
from marketlens.sources.files import (
    DEFAULT_FILES,
    MissingTableError,
    load_raw_tables,
    missing_raw_files,
    read_table,
    register_tables,
    write_csv,
    write_daily_parquet,
    write_json,
    write_parquet,
)
from marketlens.sources.refresh import Refreshed, month_digests, month_of, of_months, refresh_monthly
from marketlens.sources.scratch import materialize, scratch_run


@dataclass
class Settings:
    clusters: int = 4
    restarts: int = 20
    forecast_method: str = "sarimax"
    forecast_days: int = 30
    alpha: float = 0.2
    boosting_rounds: int = 140
    min_category_rows: int = 50
    scope: Scope = field(default_factory=Scope)


def build_tables(spark: SparkSession, raw: dict[str, DataFrame], out_dir: str) -> dict[str, DataFrame]:
    """Derive and store the processed tables. Facts are written first and read back by the others."""
    write_daily_parquet(fact_orders(raw), f"{out_dir}/fact_orders", "order_purchase_ts")
    fact = read_table(spark, out_dir, "fact_orders")
    unique = features.orders_are_unique(fact)
    write_parquet(features.customer_features(fact), f"{out_dir}/customer_features")
    write_daily_parquet(features.category_daily_sales(fact, unique), f"{out_dir}/category_daily_sales")
    write_daily_parquet(features.state_category_daily_sales(fact, unique), f"{out_dir}/state_category_daily_sales")
    write_parquet(features.customer_repeat_features(fact), f"{out_dir}/customer_repeat_features")
    write_parquet(features.ab_test_sample(fact), f"{out_dir}/ab_test_sample")
    tables = {name: read_table(spark, out_dir, name) for name in PROCESSED_TABLES}
    register_tables(tables)
    return tables


def refresh_daily(spark: SparkSession, raw: dict[str, DataFrame], out_dir: str) -> dict[str, Refreshed]:
    """Facts and daily sales after new or corrected raw rows: only months whose facts moved are written.

    Facts are computed once. A month's daily sales come from that month's facts alone, so the sales tables read
    the folders of the moved months and no others, and count orders plainly where no id repeats in those months.
    """
    fact = materialize(fact_orders(raw))
    digests = month_digests(fact, "order_purchase_ts")
    done = {
        "fact_orders": refresh_monthly(
            spark, out_dir, "fact_orders", digests, lambda months: fact.filter(month_of("order_purchase_ts").isin(months)), "order_purchase_ts"
        )
    }
    stored = read_table(spark, out_dir, "fact_orders")

    @cache
    def facts_of(*months: str) -> tuple[DataFrame, bool]:
        rows = of_months(stored, [*months])
        return rows, features.orders_are_unique(rows)

    for name, daily in (("category_daily_sales", features.category_daily_sales), ("state_category_daily_sales", features.state_category_daily_sales)):
        done[name] = refresh_monthly(spark, out_dir, name, digests, lambda months, daily=daily: daily(*facts_of(*months)), "order_date")
    return done


def build_all(
    spark: SparkSession,
    raw: dict[str, DataFrame],
    present: dict[str, bool],
    processed_dir: str,
    output_dir: str,
    settings: Settings | None = None,
) -> None:
    with scratch_run(spark):
        _build_all(spark, raw, present, processed_dir, output_dir, settings or Settings())


def _build_all(
    spark: SparkSession,
    raw: dict[str, DataFrame],
    present: dict[str, bool],
    processed_dir: str,
    output_dir: str,
    settings: Settings,
) -> None:
    tables = build_tables(spark, raw, processed_dir)

    def store(df: DataFrame, name: str) -> DataFrame:
        write_parquet(df, f"{output_dir}/{name}")
        return read_table(spark, output_dir, name)

    report = store(quality.audit(spark, present, raw, tables), "data_quality_summary")
    write_json(quality.whole_report(report), f"{output_dir}/data_quality_report")

    clustered = materialize(
        cluster_customers(tables["customer_features"], settings.clusters, settings.restarts)
    )
    segmented, summary = segment_customers(clustered)
    store(segmented, "segmented_customers")
    segment_summary = store(summary, "segment_summary")

    propensity = run_propensity(tables["customer_repeat_features"], min_count=settings.min_category_rows)
    predictions = store(propensity.predictions, "repeat_purchase_predictions")
    metrics = propensity.metrics
    write_json(metrics, f"{output_dir}/repeat_purchase_metrics")
    by_state = store(propensity.state_summary, "repeat_state_summary")
    by_category = store(propensity.category_summary, "repeat_category_summary")
    drivers = store(propensity.feature_importance, "repeat_feature_importance")
    lift = store(propensity.topk_summary, "repeat_topk_summary")

    series = forecast.daily_series(forecast.with_all_states(tables["state_category_daily_sales"]))
    sales_forecast = store(
        forecast.forecast(series, settings.forecast_method, settings.forecast_days, settings.alpha),
        "sales_forecast",
    )

    experiment = run_experiment(
        tables["customer_repeat_features"],
        predictions,
        experiment_plans.later_revenue(tables["fact_orders"]),
        settings.scope,
        rounds=settings.boosting_rounds,
        min_count=settings.min_category_rows,
    )
    sample = store(experiment.uplift.scored, "experiment_sample")
    profile = store(experiment.uplift.profile, "experiment_segment_profile")
    store(experiment.comparison, "method_comparison")
    for name, record in [
        ("experiment_summary", experiment.summary),
        ("naive_difference_in_means", experiment.naive),
        ("r_learner_aipw", experiment.uplift.result),
    ]:
        write_json(record, f"{output_dir}/{name}")

    store(
        reports.executive_summary(metrics, experiment.summary, experiment.naive, experiment.uplift.result),
        "executive_summary",
    )
    score_order = [F.col("repeat_probability").desc(), "customer_unique_id"]
    for name, df, keys in [
        ("data_quality", report, ["check"]),
        ("segment_summary", segment_summary, ["cluster"]),
        ("repeat_predictions", predictions, score_order),
        ("repeat_by_state", by_state, [F.col("avg_repeat_probability").desc(), "first_customer_state"]),
        ("repeat_by_category", by_category, [F.col("avg_repeat_probability").desc(), "first_product_category"]),
        ("repeat_drivers", drivers, [F.col("abs_coefficient").desc(), "feature"]),
        ("repeat_top_k", lift, ["customers"]),
        ("experiment_segment", profile, ["segment"]),
        ("experiment_sample", sample, [F.col("split").desc(), "customer_unique_id"]),
        ("sales_forecast", sales_forecast, ["customer_state", "product_category", "order_date"]),
    ]:
        write_csv(reports.extract(df, keys), f"{output_dir}/report", name)

    store(reports.experiment_readout(experiment.summary, experiment.naive, experiment.uplift.result), "experiment_readout")
    orders = tables["fact_orders"]
    store(dashboard.kpi_summary(orders, tables["customer_features"]), "kpi_summary")


def run_from_csv(
    spark: SparkSession,
    raw_dir: str,
    processed_dir: str,
    output_dir: str,
    files: dict[str, str] | None = None,
    settings: Settings | None = None,
    multi_line: set[str] | bool = False,
) -> None:
    """Batch run over a folder of raw CSV files; multi_line names the tables with line breaks in fields.

    If a file is missing, the audit of what is there is written before the error, so the gap is on record.
    """
    files = files or DEFAULT_FILES
    absent = set(missing_raw_files(spark, raw_dir, files))
    present = {name: file not in absent for name, file in files.items()}
    if absent:
        raw = load_raw_tables(spark, raw_dir, {n: f for n, f in files.items() if present[n]}, multi_line)
        report = quality.audit(spark, present, raw, {})
        write_parquet(report, f"{output_dir}/data_quality_summary")
        report = read_table(spark, output_dir, "data_quality_summary")
        write_json(quality.whole_report(report), f"{output_dir}/data_quality_report")
        raise MissingTableError(f"{raw_dir} lacks {', '.join(sorted(absent))}")
    build_all(spark, load_raw_tables(spark, raw_dir, files, multi_line), present, processed_dir, output_dir, settings)
