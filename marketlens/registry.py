"""Named queries over the test tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import scalars
from marketlens.operators import prep, scoring
from marketlens.operators.quantiles import with_row
from marketlens.operators.ranking import running_totals
from marketlens.plans import (
    batch,
    dashboard,
    experiment,
    features,
    forecast,
    propensity,
    quality,
    reports,
    segments,
)
from marketlens.plans import fact as fact_plans
from marketlens.schemas import FOREIGN_KEYS, RAW_KEYS, RAW_SCHEMAS, REPEAT_NUMERIC, SEGMENT_FEATURES, SEGMENT_LABELS
from marketlens.sources import binding, files
from marketlens.sources.scratch import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


# Sums, whose last bits depend on the order of summation: results show amounts with four digits (no amount
# has more, so none is near a rounding edge) and quotients with six.
AMOUNTS = (
    "revenue", "total_revenue", "payment_value", "item_revenue", "freight_value", "order_value", "first_order_value", "first_freight_value",
)
QUOTIENTS = ("avg_order_value", "late_delivery_rate")


def query(fn: Query) -> Query:
    @wraps(fn)
    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(_rounded(fn(spark, sf_dir), *AMOUNTS, digits=4), *QUOTIENTS)

    QUERIES[fn.__name__] = shown
    return fn


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round derived doubles, whose last bits depend on the order of summation."""
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_plans.fact_orders(binding.retail_tables(spark, sf_dir))


# --- order facts and derived tables --------------------------------------------------------------


@query
def payment_summary(spark, sf_dir):
    return fact_plans.payment_summary(binding.order_payments(spark, sf_dir))


@query
def item_summary(spark, sf_dir):
    t = binding.retail_tables(spark, sf_dir)
    return fact_plans.item_summary(t["order_items"], t["products"], t["category_translation"])


@query
def fact_orders(spark, sf_dir):
    return _fact(spark, sf_dir)


@query
def customer_features(spark, sf_dir):
    return features.customer_features(_fact(spark, sf_dir))


@query
def category_daily_sales(spark, sf_dir):
    return features.category_daily_sales(_fact(spark, sf_dir))


@query
def state_category_daily_sales(spark, sf_dir):
    return features.state_category_daily_sales(_fact(spark, sf_dir))


@query
def customer_repeat_features(spark, sf_dir):
    return features.customer_repeat_features(_fact(spark, sf_dir))


@query
def ab_test_sample(spark, sf_dir):
    return features.ab_test_sample(_fact(spark, sf_dir))


@query
def ab_test_latest(spark, sf_dir):
    """The sample of the thousand latest paid orders: the limit is the feature."""
    return _rounded(features.ab_test_sample(_fact(spark, sf_dir), 1000), "order_value", digits=4)


# --- sources and sinks ---------------------------------------------------------------------------


@query
def raw_csv_round_trip(spark, sf_dir):
    """Orders written as CSV text and read back with the fixed schema; times parsed afterwards."""
    folder = scratch_path(spark)
    path = files.write_csv(binding.orders(spark, sf_dir), folder, "orders")
    back = files.read_raw_csv(spark, path, RAW_SCHEMAS["orders"], multi_line=False)
    times = [c for c in back.columns if c not in ("order_id", "customer_id", "order_status")]
    return back.select(
        "order_id", "customer_id", "order_status", *[scalars.timestamp_or_null(c).alias(c) for c in times]
    )


@query
def daily_sales_round_trip(spark, sf_dir):
    """Daily sales stored in month folders and read back."""
    folder = scratch_path(spark)
    files.write_daily_parquet(category_daily_sales(spark, sf_dir), f"{folder}/category_daily_sales")
    back = files.read_table(spark, folder, "category_daily_sales")
    return back.select("order_date", "product_category", "orders", "revenue")


@query
def metrics_json_round_trip(spark, sf_dir):
    path = scratch_path(spark)
    record = dashboard.repeat_customer_rate(customer_features(spark, sf_dir))
    files.write_json(record, path)
    return _rounded(files.read_json(spark, path, record.schema), "repeat_customer_rate")


@query
def stored_fact_columns(spark, sf_dir):
    """Two columns of the stored order facts, by registered name and in SQL."""
    folder = scratch_path(spark)
    files.write_parquet(_fact(spark, sf_dir), f"{folder}/fact_orders")
    files.register_tables({"stored_facts": files.read_table(spark, folder, "fact_orders", ["customer_state", "payment_value"])})
    found = spark.sql("SELECT customer_state, COUNT(*) AS orders, SUM(payment_value) AS revenue FROM stored_facts GROUP BY customer_state")
    return _rounded(found, "revenue", digits=4)


# --- growth views --------------------------------------------------------------------------------


@query
def kpi_summary(spark, sf_dir):
    fact = materialize(_fact(spark, sf_dir))
    out = dashboard.kpi_summary(fact, features.customer_features(fact))
    return _rounded(out, "avg_order_value", "late_delivery_rate", "repeat_customer_rate")


@query
def approximate_customers(spark, sf_dir):
    """Distinct customers per state from merged sketches beside the exact count; within six standard errors of it."""
    fact = materialize(_fact(spark, sf_dir))
    merged = dashboard.approximate_customers(materialize(dashboard.customer_sketches(fact)), ["customer_state"])
    exact = fact.groupBy("customer_state").agg(F.count_distinct("customer_unique_id").alias("customers"))
    error = F.abs(F.col("approximate_customers") / F.col("customers") - 1)
    joined = merged.join(exact.withColumnRenamed("customer_state", "_state"), F.col("customer_state").eqNullSafe(F.col("_state")))
    return joined.select("customer_state", "order_rows", "customers", (error < 6 * 1.04 / 2**7).alias("error_in_bound"))


@query
def monthly_refresh(spark, sf_dir):
    """Daily sales of a store that first lacked the newest month and was then refreshed with all orders."""
    folder, raw = scratch_path(spark), binding.retail_tables(spark, sf_dir)
    newest = F.date_format(F.max("order_purchase_timestamp"), "yyyy-MM").alias("newest")
    earlier = with_row(raw["orders"], raw["orders"].agg(newest)).filter(F.date_format("order_purchase_timestamp", "yyyy-MM") < F.col("newest"))
    batch.refresh_daily(spark, raw | {"orders": earlier.select(*raw["orders"].columns)}, folder)
    done = batch.refresh_daily(spark, raw, folder)["category_daily_sales"]
    sales = files.read_table(spark, folder, "category_daily_sales").drop(files.MONTH_COLUMN)
    return sales.withColumn("was_written", F.date_format("order_date", "yyyy-MM").isin(done.written))


@query
def insight_lines(spark, sf_dir):
    fact = materialize(_fact(spark, sf_dir))
    return dashboard.insight_lines(dashboard.kpi_summary(fact, features.customer_features(fact)))


@query
def repeat_customer_rate(spark, sf_dir):
    return _rounded(dashboard.repeat_customer_rate(customer_features(spark, sf_dir)), "repeat_customer_rate")


@query
def filter_choices(spark, sf_dir):
    return dashboard.filter_choices(_fact(spark, sf_dir))


@query
def filtered_orders(spark, sf_dir):
    return dashboard.filtered_orders(
        _fact(spark, sf_dir), "1996-01-01", "1998-12-31", binding.CORE_STATES, ["watches_gifts", "sports_leisure"]
    )


@query
def daily_revenue(spark, sf_dir):
    return dashboard.daily_revenue(_fact(spark, sf_dir))


@query
def top_categories(spark, sf_dir):
    return dashboard.top_categories(_fact(spark, sf_dir))


@query
def top_states(spark, sf_dir):
    return dashboard.top_states(_fact(spark, sf_dir))


@query
def state_category_mix(spark, sf_dir):
    return _rounded(dashboard.state_category_mix(_fact(spark, sf_dir)), "revenue_share")


@query
def state_category_rollup(spark, sf_dir):
    out = dashboard.state_category_rollup(dashboard.state_category_mix(_fact(spark, sf_dir)))
    return _rounded(out, "revenue_share")


@query
def first_orders(spark, sf_dir):
    return features.first_orders_by_window(_fact(spark, sf_dir))


@query
def feature_labels(spark, sf_dir):
    """Display names of every encoded category that occurs."""
    fact = _fact(spark, sf_dir).select("product_category", "customer_state", "primary_payment_type").distinct()
    names = fact.select(
        F.explode(
            F.array(
                F.concat(F.lit("categorical__first_product_category_"), "product_category"),
                F.concat(F.lit("categorical__first_customer_state_"), "customer_state"),
                F.concat(F.lit("categorical__first_payment_type_"), "primary_payment_type"),
            )
        ).alias("encoded")
    ).distinct()
    clean = names.withColumn("feature", scalars.clean_feature_name("encoded"))
    return clean.withColumn("feature_display", scalars.feature_label("feature"))


# --- audit ---------------------------------------------------------------------------------------


def _processed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    fact = materialize(_fact(spark, sf_dir))
    return {
        "fact_orders": fact,
        "customer_features": features.customer_features(fact),
        "category_daily_sales": features.category_daily_sales(fact),
        "state_category_daily_sales": features.state_category_daily_sales(fact),
        "customer_repeat_features": features.customer_repeat_features(fact),
        "ab_test_sample": features.ab_test_sample(fact),
    }


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = binding.available_sources(spark, sf_dir)
    return quality.audit(spark, present, binding.retail_tables(spark, sf_dir), _processed(spark, sf_dir))


@query
def dq_row_counts(spark, sf_dir):
    raw = quality.row_counts(binding.retail_tables(spark, sf_dir), "raw", "rows read from the input")
    derived = quality.row_counts(_processed(spark, sf_dir), "processed", "rows of the derived table")
    return raw.unionByName(derived)


@query
def dq_duplicate_keys(spark, sf_dir):
    raw = binding.retail_tables(spark, sf_dir)
    return quality.union_checks([quality.duplicate_keys(n, raw[n], k) for n, k in RAW_KEYS.items()])


@query
def dq_null_rates(spark, sf_dir):
    raw = binding.retail_tables(spark, sf_dir)
    profiles = quality.union_checks([quality.table_profile(n, df) for n, df in raw.items()])
    return profiles.filter(F.col("check").startswith("raw_null_rate__"))


@query
def dq_referential_integrity(spark, sf_dir):
    raw = binding.retail_tables(spark, sf_dir)
    return quality.union_checks(
        [quality.missing_parents(check, raw[c], k, raw[p], d) for c, k, p, check, d in FOREIGN_KEYS]
    )


@query
def dq_fact_checks(spark, sf_dir):
    fact = _fact(spark, sf_dir)
    return quality.fact_checks(fact).unionByName(quality.target_rate(features.customer_repeat_features(fact)))


@query
def dq_report(spark, sf_dir):
    return _audit(spark, sf_dir)


@query
def dq_report_files(spark, sf_dir):
    """The report written as JSON and as CSV, both read back."""
    report, folder = materialize(_audit(spark, sf_dir)), scratch_path(spark)
    files.write_json(report, f"{folder}/report.json")
    path = files.write_csv(report, folder, "report")
    found = {"json": files.read_json(spark, f"{folder}/report.json", report.schema), "csv": files.read_raw_csv(spark, path, report.schema, multi_line=False)}
    return reduce(DataFrame.unionByName, [df.withColumn("format", F.lit(name)) for name, df in found.items()])


@query
def dq_status_rollup(spark, sf_dir):
    return quality.overall_status(_audit(spark, sf_dir))


@query
def dq_status_counts(spark, sf_dir):
    return quality.status_counts(_audit(spark, sf_dir))


@query
def dq_filtered_checks(spark, sf_dir):
    return dashboard.checks_with_status(_audit(spark, sf_dir), ["pass", "warn"])


# --- forecasts -----------------------------------------------------------------------------------


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(state_category_daily_sales(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.daily_series(forecast.with_all_states(_daily(spark, sf_dir)))


@query
def forecast_scope(spark, sf_dir):
    return forecast.default_scope(state_category_daily_sales(spark, sf_dir))


@query
def forecast_scope_choices(spark, sf_dir):
    return forecast.scope_choices(state_category_daily_sales(spark, sf_dir), "NATION_7")


@query
def daily_series(spark, sf_dir):
    return _series(spark, sf_dir)


@query
def series_status(spark, sf_dir):
    return forecast.series_status(_series(spark, sf_dir))


@query
def rolling_residuals(spark, sf_dir):
    out = forecast.moving_average_residuals(_series(spark, sf_dir))
    # A little more than nothing keeps means that end in a half off the rounding edge.
    return _rounded(out.withColumn("rolling_mean", F.col("rolling_mean") + 3e-8), "rolling_mean").select(
        "order_date", "customer_state", "product_category", "revenue", "width", "rolling_mean"
    )


@query
def forecast_moving_average(spark, sf_dir):
    out = forecast.forecast(_series(spark, sf_dir), "moving_average")
    return _rounded(out, "forecast_revenue", "lower_revenue", "upper_revenue", digits=4)


@query
def forecast_overlay(spark, sf_dir):
    """History and forecast of the largest category over all states."""
    daily = _daily(spark, sf_dir)
    series = forecast.daily_series(forecast.select_scope(daily, binding.TARGET_CATEGORY))
    out = forecast.overlay(series, forecast.forecast(series, "moving_average"))
    return _rounded(out, "revenue", "lower_revenue", "upper_revenue", digits=4)


def _bounds_hold(out: DataFrame) -> DataFrame:
    """Dates of a model's forecast; numbers are there, not negative, and inside their interval."""
    low, mean, high = F.col("lower_revenue"), F.col("forecast_revenue"), F.col("upper_revenue")
    return out.select("order_date", "customer_state", "product_category", "status", ((low >= 0) & (low <= mean) & (mean <= high)).alias("in_bounds"))


@query
def forecast_ets(spark, sf_dir):
    return _bounds_hold(forecast.forecast(_series(spark, sf_dir), "ets"))


@query
def forecast_sarima(spark, sf_dir):
    return _bounds_hold(forecast.forecast(_series(spark, sf_dir), "sarimax"))


@query
def forecast_ets_values(spark, sf_dir):
    """Smoothing forecasts of every series, to cents."""
    return _rounded(forecast.forecast(_series(spark, sf_dir), "ets"), "forecast_revenue", "lower_revenue", "upper_revenue", digits=2)


@query
def forecast_sarima_values(spark, sf_dir):
    return forecast.forecast(_series(spark, sf_dir), "sarimax")


@query
def forecast_ets_scope(spark, sf_dir):
    """Smoothing forecast of the largest category over all states, in the digits that its SQL fold shows."""
    series = forecast.daily_series(forecast.select_scope(_daily(spark, sf_dir), binding.TARGET_CATEGORY))
    return _rounded(forecast.forecast(series, "ets"), "forecast_revenue", "lower_revenue", "upper_revenue", digits=4)


@query
def arima_orthogonality(spark, sf_dir):
    return forecast.arima_orthogonality(_series(spark, sf_dir))


@query
def scope_forecast(spark, sf_dir):
    """One state, all states, and the table without states that is used where the other is absent."""
    fact = materialize(_fact(spark, sf_dir))
    by_state, by_category = materialize(features.state_category_daily_sales(fact)), materialize(features.category_daily_sales(fact))
    scopes = {
        "state": (forecast.daily_sales(by_state, by_category), "NATION_7"),
        "all states": (forecast.daily_sales(by_state, by_category), None),
        "category table": (forecast.daily_sales(None, by_category), None),
    }
    parts = [
        forecast.scope_forecast(daily, binding.TARGET_CATEGORY, state, method="moving_average").withColumn("scope", F.lit(name))
        for name, (daily, state) in scopes.items()
    ]
    return _rounded(reduce(DataFrame.unionByName, parts), "forecast_revenue", "lower_revenue", "upper_revenue", digits=4)


# --- feature preparation -------------------------------------------------------------------------


def _repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(customer_repeat_features(spark, sf_dir))


@query
def impute_median(spark, sf_dir):
    out = prep.impute_median(_repeat(spark, sf_dir), REPEAT_NUMERIC)
    return out.select("customer_unique_id", *[F.col(c).cast("double").alias(c) for c in REPEAT_NUMERIC])


@query
def impute_mode(spark, sf_dir):
    """Payment types of first orders, where unknown counts as missing."""
    known = F.when(F.col("first_payment_type") != "unknown", F.col("first_payment_type"))
    rows = _repeat(spark, sf_dir).select(
        "customer_unique_id", known.alias("first_payment_type"), "first_customer_state"
    )
    return prep.impute_mode(rows, ["first_payment_type", "first_customer_state"])


@query
def standardize(spark, sf_dir):
    rows = prep.impute_median(_repeat(spark, sf_dir), ["first_delivery_days"])
    out = prep.standardize(rows, REPEAT_NUMERIC)
    zs = [f"{c}_z" for c in REPEAT_NUMERIC]
    return _rounded(out.select("customer_unique_id", *zs), *zs)


@query
def pool_rare_categories(spark, sf_dir):
    rows = prep.seeded_split(_repeat(spark, sf_dir), "customer_unique_id", 0.25, 42)
    out = prep.pool_rare_categories(
        rows, ["first_product_category", "first_customer_state"], rows.filter("is_train = 1"), min_count=250
    )
    return out.select(
        "customer_unique_id", "first_product_category_level", "first_customer_state_level"
    )


@query
def stratified_split(spark, sf_dir):
    rows = customer_repeat_features(spark, sf_dir).select("customer_unique_id", "repeat_purchase_label")
    return prep.stratified_split(rows, "customer_unique_id", "repeat_purchase_label", 0.25, 42)


@query
def seeded_split(spark, sf_dir):
    rows = prep.seeded_split(customer_repeat_features(spark, sf_dir), "customer_unique_id", 0.25, 42)
    return rows.select("customer_unique_id", "repeat_purchase_label", "is_train")


# --- evaluation of given scores ------------------------------------------------------------------


def _scored_rows(rows: DataFrame) -> DataFrame:
    """First orders with a score derived from id and label: coarse, so that ties are common."""
    u = scalars.uniform("customer_unique_id", 7, "score")
    score = F.floor((0.8 * u + 0.2 * F.col("repeat_purchase_label")) * 1000) / F.lit(1000.0)
    return materialize(rows.withColumn("repeat_probability", score))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_rows(customer_repeat_features(spark, sf_dir))


@query
def propensity_bands(spark, sf_dir):
    return scoring.add_percentile(
        _scored(spark, sf_dir).select("customer_unique_id", "repeat_probability"), "repeat_probability", "customer_unique_id"
    )


@query
def band_counts(spark, sf_dir):
    return dashboard.band_counts(propensity_bands(spark, sf_dir))


@query
def topk_lift(spark, sf_dir):
    out = scoring.topk_lift(
        _scored(spark, sf_dir), "repeat_probability", "customer_unique_id", "repeat_purchase_label"
    )
    return _rounded(out, "repeat_rate", "lift_vs_baseline")


@query
def classification_metrics(spark, sf_dir):
    out = scoring.classification_metrics(_scored(spark, sf_dir), "repeat_probability", "repeat_purchase_label")
    return _rounded(out, "accuracy", "precision", "recall", "f1", "target_rate")


@query
def roc_auc(spark, sf_dir):
    return _rounded(scoring.roc_auc(_scored(spark, sf_dir), "repeat_probability", "repeat_purchase_label"), "roc_auc")


@query
def average_precision(spark, sf_dir):
    out = scoring.average_precision(_scored(spark, sf_dir), "repeat_probability", "repeat_purchase_label")
    return _rounded(out, "average_precision")


@query
def score_by_state(spark, sf_dir):
    out = propensity.summary_by(_scored(spark, sf_dir), "first_customer_state")
    return _rounded(out, "actual_repeat_rate", "avg_repeat_probability")


@query
def score_by_category(spark, sf_dir):
    out = propensity.summary_by(_scored(spark, sf_dir), "first_product_category")
    return _rounded(out, "actual_repeat_rate", "avg_repeat_probability")


@query
def propensity_by_state(spark, sf_dir):
    return dashboard.propensity_by_state(score_by_state(spark, sf_dir))


@query
def propensity_by_category(spark, sf_dir):
    return dashboard.propensity_by_category(score_by_category(spark, sf_dir))


@query
def state_summary_display(spark, sf_dir):
    return dashboard.display_table(score_by_state(spark, sf_dir), ["first_customer_state"])


@query
def best_prospects(spark, sf_dir):
    out = dashboard.best_prospects(_scored(spark, sf_dir))
    return out.select("customer_unique_id", "first_product_category", "repeat_probability")


# --- models --------------------------------------------------------------------------------------


@query
def propensity_model_predictions(spark, sf_dir):
    """Fitted score, percentile and band of every customer."""
    return propensity.predictions(propensity.fit_scores(_repeat(spark, sf_dir))[0])


@query
def propensity_metric_values(spark, sf_dir):
    return propensity.model_metrics(propensity.fit_scores(_repeat(spark, sf_dir))[0])


@query
def feature_coefficients(spark, sf_dir):
    return propensity.fit_scores(_repeat(spark, sf_dir))[1]


@query
def top_driver_names(spark, sf_dir):
    return propensity.top_drivers(propensity.fit_scores(_repeat(spark, sf_dir))[1])


@query
def propensity_model_scores(spark, sf_dir):
    """Who is scored and on which side of the split; scores are probabilities and bands follow their percentiles."""
    scored = propensity.predictions(propensity.fit_scores(_repeat(spark, sf_dir))[0])
    band = scalars.propensity_band("propensity_percentile")
    return scored.select(
        "customer_unique_id", "repeat_purchase_label", "is_train",
        ((F.col("repeat_probability") > 0) & (F.col("repeat_probability") < 1)).alias("is_probability"),
        (F.col("propensity_band") == band).alias("band_fits"),
    )


@query
def propensity_model_metrics(spark, sf_dir):
    """Held-out metrics, checked against a second computation from the same scores."""
    scored = propensity.fit_scores(_repeat(spark, sf_dir))[0]
    test = scored.filter("is_train = 0").select(F.col("repeat_probability").alias("p"), F.col("repeat_purchase_label").alias("y"))
    counts = test.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # A positive wins against the negatives below it and ties with those at its score.
    auc = running_totals(counts, ["p"], ["neg"]).agg(F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg"))).alias("won"))
    again = test.agg(
        F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")).alias("hit"), F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros")
    ).crossJoin(auc)
    row = propensity.model_metrics(scored).crossJoin(again)
    close = lambda x, y: F.abs(x - y) < 1e-9
    return row.select(
        "test_rows",
        F.round("repeat_rate", 6).alias("repeat_rate"),
        close(F.col("accuracy"), F.col("hit")).alias("accuracy_agrees"),
        close(F.col("roc_auc"), F.col("won") / F.col("ones") / F.col("zeros")).alias("roc_auc_agrees"),
    )


@query
def feature_importance(spark, sf_dir):
    """Encoded features of the training rows, and whether the objective is flat there in every direction."""
    drivers = propensity.fit_scores(_repeat(spark, sf_dir), gradient=True)[1]
    steepest = F.greatest(F.abs("gradient"), F.abs("intercept_gradient"))
    return drivers.select("feature", (steepest < 1e-6).alias("is_stationary"))


@query
def top_drivers(spark, sf_dir):
    """The fifteen largest coefficients: in order, and with display names that follow the rule."""
    found = propensity.top_drivers(propensity.fit_scores(_repeat(spark, sf_dir))[1])
    order = Window.orderBy(F.col("abs_coefficient").desc(), "feature")
    ranked = found.select("*", F.row_number().over(order).alias("position"), F.lag("abs_coefficient").over(order).alias("before"))
    return ranked.select(
        "position",
        (F.coalesce("before", F.col("abs_coefficient")) >= F.abs("coefficient")).alias("in_order"),
        (F.col("feature_display") == scalars.feature_label("feature")).alias("name_fits"),
    )


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(segments.cluster_customers(materialize(customer_features(spark, sf_dir))))


@query
def segment_assignments(spark, sf_dir):
    return segments.segment_customers(_clustered(spark, sf_dir))[0]


@query
def segment_profiles(spark, sf_dir):
    return segments.segment_customers(_clustered(spark, sf_dir))[1]


@query
def segment_customers(spark, sf_dir):
    """Each customer with a segment, and whether no other segment's centre is nearer on the scaled features."""
    named = segments.segment_customers(_clustered(spark, sf_dir))[0]
    scaled = materialize(prep.standardize(named, SEGMENT_FEATURES))
    zs = [f"{c}_z" for c in SEGMENT_FEATURES]
    centres = scaled.groupBy("cluster").agg(*[F.avg(z).alias(f"c_{z}") for z in zs])
    # One row per segment, four in all.
    listed = centres.agg(F.collect_list(F.struct("cluster", *[f"c_{z}" for z in zs])).alias("centres"))
    distance = lambda c: sum((F.col(z) - c[f"c_{z}"]) * (F.col(z) - c[f"c_{z}"]) for z in zs)
    joined = with_row(scaled, listed)
    own = F.filter("centres", lambda c: c["cluster"] == F.col("cluster"))
    nearest = F.array_min(F.transform("centres", distance))
    return joined.select(
        "customer_unique_id",
        F.col("segment_name").isin(SEGMENT_LABELS).alias("has_name"),
        (distance(own[0]) <= nearest + 1e-3).alias("nearest_centre"),
    )


@query
def segment_summary(spark, sf_dir):
    """The segments by name; each profile equals one computed from the assignments."""
    named, summary = segments.segment_customers(_clustered(spark, sf_dir))
    again = named.groupBy("segment_name").agg(F.count("*").alias("n"), F.avg("total_revenue").alias("r"), F.avg("churn_label").alias("c"))
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) < 1e-6 * (1 + F.abs(F.col(y)))
    return summary.join(again, "segment_name").select("segment_name", (close("customers", "n") & close("total_revenue", "r") & close("churn_rate", "c")).alias("profile_agrees"))


@query
def segment_names(spark, sf_dir):
    """Naming and profile of groups that are given by the year of the last purchase."""
    grouped = customer_features(spark, sf_dir).withColumn("cluster", F.year("last_purchase_ts"))
    out = segments.assign_segment_names(segments.cluster_profile(grouped))
    return _rounded(
        out, "recency_days", "order_count", "total_revenue", "avg_order_value", "churn_rate", digits=4
    )


# --- experiments ---------------------------------------------------------------------------------

_SCOPE = experiment.Scope(tuple(binding.CORE_STATES), binding.TARGET_CATEGORY)


def _frame_of(scored: DataFrame) -> DataFrame:
    """Features with given scores; customers without a first delivery have none."""
    predictions = scored.filter(F.col("first_delivery_days").isNotNull())
    return experiment.experiment_frame(scored.drop("repeat_probability"), predictions)


def _participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = materialize(_fact(spark, sf_dir))
    scored = _scored_rows(features.customer_repeat_features(fact))
    return materialize(experiment.experiment_rows(_frame_of(scored), experiment.later_revenue(fact), _SCOPE))


def _holdout(rows: DataFrame) -> DataFrame:
    """Held-out half with given predictions of outcome and effect."""
    split = prep.seeded_split(rows, "customer_unique_id", 0.5, experiment.SEED)
    u = scalars.uniform("customer_unique_id", 11, "tau")
    v = scalars.uniform("customer_unique_id", 11, "m")
    given = (
        split.filter("is_train = 0")
        .withColumn("tau_hat", F.floor(u * 50 * 100) / F.lit(100.0))
        .withColumn("m_hat", F.floor(v * 30000) / F.lit(100.0))
    )
    return experiment.aipw_scores(experiment.select_segment(materialize(given)))


def _uplift(rows: DataFrame) -> DataFrame:
    train = prep.seeded_split(rows, "customer_unique_id", 0.5, experiment.SEED).filter("is_train = 1")
    return experiment.uplift_result(train, materialize(_holdout(rows)), learner=experiment.GIVEN)


@query
def experiment_frame(spark, sf_dir):
    return _frame_of(_scored(spark, sf_dir)).select(
        "customer_unique_id", "repeat_probability", "first_order_value", "repeat_purchase_label"
    )


@query
def experiment_rows(spark, sf_dir):
    out = _participants(spark, sf_dir).select("customer_unique_id", "treatment", "core_market", "target_category_affinity", "outcome")
    return _rounded(out, "outcome", digits=4)


@query
def experiment_covariates(spark, sf_dir):
    out = experiment.covariates(_participants(spark, sf_dir))
    return _rounded(out, "log_items", "bounded_value", "score_z", "score_logistic", "centred_outcome", digits=4)


@query
def experiment_summary(spark, sf_dir):
    out = experiment.experiment_summary(_participants(spark, sf_dir), _SCOPE, experiment.GIVEN)
    return _rounded(out, "target_rate", "average_outcome", digits=4)


@query
def welch_test(spark, sf_dir):
    out = experiment.with_p_value(experiment.welch_statistics(_participants(spark, sf_dir)))
    out = _rounded(out, "estimate", "standard_error", "statistic", "freedom", digits=4)
    return _rounded(out, "p_value")


@query
def one_sample_test(spark, sf_dir):
    chosen = _holdout(_participants(spark, sf_dir)).filter("selected_segment = 1")
    out = experiment.with_p_value(experiment.mean_statistics(chosen, "aipw_score"))
    out = _rounded(out, "estimate", "standard_error", "statistic", "freedom", digits=4)
    return _rounded(out, "p_value")


@query
def uplift_cutoff(spark, sf_dir):
    return _holdout(_participants(spark, sf_dir)).select(
        "customer_unique_id", "tau_hat", F.round("cate_cutoff", 6).alias("cate_cutoff"), "selected_segment"
    )


@query
def aipw_scores(spark, sf_dir):
    out = _holdout(_participants(spark, sf_dir)).select("customer_unique_id", "treatment", "tau_hat", "aipw_score")
    return _rounded(out, "aipw_score", digits=4)


@query
def pseudo_outcomes(spark, sf_dir):
    out = experiment.pseudo_outcomes(_holdout(_participants(spark, sf_dir)))
    return _rounded(out.select("customer_unique_id", "pseudo_tau", "r_weight"), "pseudo_tau", digits=4)


@query
def uplift_segment_profile(spark, sf_dir):
    out = experiment.segment_profile(_holdout(_participants(spark, sf_dir)))
    return _rounded(out, "treatment_rate", "average_outcome", "predicted_cate", digits=4)


def _run_experiment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, experiment.ExperimentResult]:
    """The whole chain as in the batch job: fitted propensity scores, then the fitted R-learner."""
    fact = materialize(_fact(spark, sf_dir))
    rows = materialize(features.customer_repeat_features(fact))
    scored = propensity.fit_scores(rows)[0]
    return scored, experiment.run_experiment(rows, scored, experiment.later_revenue(fact), _SCOPE)


@query
def fitted_method_comparison(spark, sf_dir):
    """Both tests side by side, the second one on the segment that the fitted R-learner selects."""
    return _run_experiment(spark, sf_dir)[1].comparison


@query
def fitted_lesson_flags(spark, sf_dir):
    found = _run_experiment(spark, sf_dir)[1]
    return experiment.lesson_flags(found.naive, found.uplift.result)


@query
def method_comparison(spark, sf_dir):
    """Both tests side by side, on given predictions: hashes of the id, no learner (see fitted_method_comparison)."""
    rows = _participants(spark, sf_dir)
    return experiment.method_comparison(experiment.welch_test(rows), _uplift(rows))


@query
def lesson_flags(spark, sf_dir):
    """On given predictions, as in method_comparison."""
    rows = _participants(spark, sf_dir)
    return experiment.lesson_flags(experiment.welch_test(rows), _uplift(rows))


@query
def r_learner_predictions(spark, sf_dir):
    """The fitted learner's predictions, scores and segment, with its cutoff."""
    found = experiment.r_learner(_participants(spark, sf_dir))
    return with_row(found.scored, found.result.select("cate_cutoff"))


@query
def r_learner_scores(spark, sf_dir):
    """Rows of the fitted learner: who is in which half, and whether effect, segment and score fit together."""
    found = experiment.r_learner(_participants(spark, sf_dir))
    cut = found.result.select("cate_cutoff")
    e = experiment.TREATMENT_PROBABILITY
    tau, y, w = F.col("tau_hat"), F.col("outcome"), F.col("treatment")
    low = F.col("m_hat") - e * tau
    score = tau + w / e * (y - low - tau) - (1 - w) / (1 - e) * (y - low)
    test = F.col("split") == "test"
    return with_row(found.scored, cut).select(
        "customer_unique_id", "split", "treatment",
        (tau.isNotNull() == test).alias("effect_on_test_only"),
        F.coalesce((F.col("selected_segment") == 1) == (tau >= F.col("cate_cutoff")), F.col("selected_segment") == 0).alias("segment_fits"),
        F.coalesce(F.abs(F.col("aipw_score") - score) < 1e-6 * (1 + F.abs(score)), ~test).alias("score_fits"),
    )


@query
def fitted_experiment_readout(spark, sf_dir):
    found = _run_experiment(spark, sf_dir)[1]
    return reports.experiment_readout(found.summary, found.naive, found.uplift.result)


@query
def experiment_readout(spark, sf_dir):
    """On given predictions, as in method_comparison."""
    rows = _participants(spark, sf_dir)
    return reports.experiment_readout(experiment.experiment_summary(rows, _SCOPE, experiment.GIVEN), experiment.welch_test(rows), _uplift(rows))


# --- reports -------------------------------------------------------------------------------------


@query
def fitted_executive_summary(spark, sf_dir):
    """Summary of the fitted models: held-out propensity metrics and the R-learner's segment."""
    scored, found = _run_experiment(spark, sf_dir)
    return reports.executive_summary(propensity.model_metrics(scored), found.summary, found.naive, found.uplift.result)


@query
def executive_summary(spark, sf_dir):
    """Summary of records computed from given scores and given predictions."""
    rows = _participants(spark, sf_dir)
    return reports.executive_summary(
        scoring.classification_metrics(rows, "repeat_probability", "repeat_purchase_label"),
        experiment.experiment_summary(rows, _SCOPE, experiment.GIVEN),
        experiment.welch_test(rows),
        _uplift(rows),
    )


@query
def report_extracts(spark, sf_dir):
    """All scored customers in report order."""
    scored = _scored(spark, sf_dir).select(
        "customer_unique_id", "first_customer_state", "first_product_category", "repeat_probability"
    )
    return reports.extract(scored, [F.col("repeat_probability").desc(), "customer_unique_id"])
