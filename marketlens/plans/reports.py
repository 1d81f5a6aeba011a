"""Report tables: the executive summary, the experiment readout and ordered extracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the summary shows of each record.
EXPERIMENT_KEYS = ["target_category_display", "customers", "target_rate", "average_outcome"]
NAIVE_KEYS = ["estimate", "p_value", "is_significant_05"]
UPLIFT_KEYS = ["estimate", "p_value", "is_significant_05"]


def _as_text(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "double":
        return F.format_string("%.6f", F.col(name))
    return F.col(name).cast("string")


def metric_lines(record: DataFrame, prefix: str, keys: list[str] | None = None) -> DataFrame:
    """Unpivot a one-row record to (metric, value); keys the record lacks are left out."""
    shown = [c for c in record.columns if keys is None or c in keys]
    return record.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{prefix} {c}").alias("metric"),
                        F.when(F.col(c).isNotNull(), _as_text(record, c)).alias("value"),
                    )
                    for c in shown
                ]
            )
        )
    )


def executive_summary(
    metrics: DataFrame | None, experiment: DataFrame | None, naive: DataFrame | None, uplift: DataFrame | None
) -> DataFrame:
    parts = [
        (metrics, "Repeat purchase", None),
        (experiment, "Experiment", EXPERIMENT_KEYS),
        (naive, "DIM", NAIVE_KEYS),
        (uplift, "R-learner", UPLIFT_KEYS),
    ]
    frames = [metric_lines(record, prefix, keys) for record, prefix, keys in parts if record is not None]
    if not frames:
        raise ValueError("No records to summarise.")
    return reduce(DataFrame.unionByName, frames)


def extract(df: DataFrame, keys: list[Column | str], rows: int | None = None) -> DataFrame:
    """A report table in a stated order; all of it, unless the caller wants the first ``rows``."""
    ordered = df.orderBy(*keys)
    return ordered if rows is None else ordered.limit(rows)


def experiment_readout(summary: DataFrame, naive: DataFrame, uplift: DataFrame) -> DataFrame:
    """The experiment's key figures as formatted (metric, value) lines, and whether the two tests disagree."""
    tests = naive.select(*[F.col(c).alias(f"naive_{c}") for c in NAIVE_KEYS]).crossJoin(
        F.broadcast(uplift.select(*[F.col(c).alias(f"uplift_{c}") for c in NAIVE_KEYS]).limit(1))
    )

    def line(metric: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"))

    def number(name: str, form: str) -> Column:
        return F.coalesce(F.format_string(form, F.col(name)), F.lit("n/a"))

    def yes(condition: Column) -> Column:
        return F.when(condition, "yes").otherwise("no")

    return summary.crossJoin(F.broadcast(tests.limit(1))).select(
        F.inline(
            F.array(
                line("Customers", F.format_number("customers", 0)),
                line("Treated customers", F.format_number("treated_customers", 0)),
                line("Control customers", F.format_number("control_customers", 0)),
                line("Customers in the target", F.concat(F.format_string("%.2f", 100 * F.coalesce("target_rate", F.lit(0.0))), F.lit("%"))),
                line("Average outcome", number("average_outcome", "%.2f")),
                line("Difference in means", number("naive_estimate", "%.2f")),
                line("Difference in means, p", number("naive_p_value", "%.4f")),
                line("Selected segment", number("uplift_estimate", "%.2f")),
                line("Selected segment, p", number("uplift_p_value", "%.4f")),
                line("Only the segment test rejects", yes(F.col("uplift_is_significant_05") & ~F.col("naive_is_significant_05"))),
                line("Base learner", F.col("base_learner")),
            )
        )
    )
