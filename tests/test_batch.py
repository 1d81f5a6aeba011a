"""The batch job end to end on the smallest scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import types as T

from marketlens.plans.batch import Settings, build_all, run_from_csv
from marketlens.plans.dashboard import filtered_orders
from marketlens.plans.experiment import Scope
from marketlens.schemas import RAW_SCHEMAS
from marketlens.sources import binding
from marketlens.sources.files import MissingTableError, path_exists, read_json, read_table
from marketlens.sources.scratch import materialize

SF_DIR = "/root/testdata/sf0.001"


def test_build_all(spark, tmp_path):
    processed, output = str(tmp_path / "processed"), str(tmp_path / "output")
    settings = Settings(
        restarts=2,
        forecast_method="ets",
        forecast_days=7,
        boosting_rounds=2,
        min_category_rows=20,
        scope=Scope(tuple(binding.CORE_STATES), binding.TARGET_CATEGORY),
    )
    raw = binding.retail_tables(spark, SF_DIR)
    kept = materialize(spark.range(7))
    build_all(spark, raw, binding.available_sources(spark, SF_DIR), processed, output, settings)

    facts = read_table(spark, processed, "fact_orders")
    assert facts.count() == 1498 and spark.table("fact_orders").count() == 1498
    march = filtered_orders(facts, "1997-03-05", "1997-03-20")
    plan = march._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*order_month#\d+ >= 1997-03", plan)
    assert march.count() == facts.filter("to_date(order_purchase_ts) BETWEEN '1997-03-05' AND '1997-03-20'").count()
    daily = read_table(spark, processed, "state_category_daily_sales")
    assert daily.agg({"orders": "sum"}).first()[0] == facts.filter("order_status <> 'canceled'").count()
    report = {r["check"]: r for r in read_table(spark, output, "data_quality_summary").collect()}
    assert report["processed_row_count__fact_orders"]["value"] == "1498"
    assert read_table(spark, output, "segment_summary").count() == 4
    predictions = read_table(spark, output, "repeat_purchase_predictions")
    sample = read_table(spark, output, "experiment_sample")
    assert predictions.count() == sample.count() == read_table(spark, processed, "customer_repeat_features").count()
    ahead = read_table(spark, output, "sales_forecast")
    assert ahead.filter("status = 'ok'").count() % 7 == 0 and ahead.filter("status <> 'ok' AND forecast_revenue IS NOT NULL").count() == 0
    summary = {r["metric"]: r["value"] for r in read_table(spark, output, "executive_summary").collect()}
    assert "Repeat purchase roc_auc" in summary and "R-learner p_value" in summary and "DIM estimate" in summary
    assert path_exists(spark, f"{output}/report/repeat_predictions")
    assert read_table(spark, output, "method_comparison").count() == 2
    # A table that another part of the session stored is still there.
    assert kept.count() == 7
    report = read_json(spark, f"{output}/data_quality_report", T.StructType.fromDDL("overall_status string, checks long, results array<struct<check: string>>")).first()
    assert report["checks"] == len(report["results"]) > 30


def test_an_incomplete_folder_is_audited(spark, tmp_path):
    raw, output = tmp_path / "raw", str(tmp_path / "output")
    raw.mkdir()
    for name, schema in RAW_SCHEMAS.items():
        if name != "products":
            (raw / f"{name}.csv").write_text(",".join(schema.fieldNames()) + "\n")
    with pytest.raises(MissingTableError, match="products"):
        run_from_csv(spark, str(raw), str(tmp_path / "processed"), output)
    report = {r["check"]: r["status"] for r in read_table(spark, output, "data_quality_summary").collect()}
    assert report["raw_file_exists__products"] == "fail" and report["raw_file_exists__orders"] == "pass"
