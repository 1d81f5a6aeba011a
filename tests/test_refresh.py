"""Monthly refresh of stored tables, and mergeable counts of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.plans import dashboard
from marketlens.plans.batch import build_tables, refresh_daily
from marketlens.sources import binding
from marketlens.sources.files import read_table
from marketlens.sources.refresh import month_digests, month_of, of_months, refresh_monthly

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "id int, at timestamp_ntz, amount double, note string"
_TABLES = ("fact_orders", "category_daily_sales", "state_category_daily_sales")


def _frame(spark, lines):
    rows = [(i, at, amount, note) for i, at, amount, note in lines]
    return spark.createDataFrame(rows, "id int, at string, amount double, note string").withColumn("at", F.col("at").cast("timestamp_ntz"))


LINES = [(1, "2020-01-05", 1.0, "a"), (2, "2020-01-06", 2.0, None), (3, "2020-02-01", 3.0, "c"), (4, None, 4.0, "d"), (5, "2020-04-01", 5.0, "")]


def _refresh(spark, folder, rows):
    return refresh_monthly(spark, folder, "t", month_digests(rows, "at"), lambda months: rows.filter(month_of("at").isin(months)), "at")


def _content(spark, folder):
    rows = read_table(spark, folder, "t").select("id", F.col("at").cast("string"), "amount", "note")
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_only_moved_months_are_written(spark, tmp_path):
    folder, rows = str(tmp_path), _frame(spark, LINES)
    assert _refresh(spark, folder, rows).written == ["", "2020-01", "2020-02", "2020-04"]
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("t/*/*.parquet")}
    first = files()
    again = _refresh(spark, folder, rows.repartition(4).orderBy(F.desc("id")))
    assert again.written == again.removed == [] and files() == first
    # A new month, a corrected row, a value that moves from one column's null, a month that vanishes, undated rows change.
    lines = [LINES[0], (2, "2020-01-06", 2.0, "b"), LINES[2], (4, None, 4.5, "d"), (6, "2020-05-09", 6.0, "e")]
    grown = _frame(spark, lines)
    done = _refresh(spark, folder, grown)
    assert done.written == ["", "2020-01", "2020-05"] and done.removed == ["2020-04"]
    kept = [p for p in first if "2020-02" in str(p)]
    assert kept and all(files()[p] == first[p] for p in kept)
    whole = str(tmp_path / "whole")
    _refresh(spark, whole, grown)
    assert _content(spark, folder) == _content(spark, whole) and len(_content(spark, folder)) == 5
    assert sorted(r["id"] for r in of_months(read_table(spark, folder, "t"), ["", "2020-05"]).collect()) == [4, 6]


def test_a_lost_record_or_an_empty_table(spark, tmp_path):
    folder, rows = str(tmp_path), _frame(spark, LINES)
    _refresh(spark, folder, rows)
    before = _content(spark, folder)
    (tmp_path / "_digests" / "t" / "_SUCCESS").unlink()
    assert len(_refresh(spark, folder, rows).written) == 4 and _content(spark, folder) == before
    none = _refresh(spark, folder, rows.limit(0))
    assert none.written == [] and len(none.removed) == 4


def test_digests_see_nulls_and_repeats(spark):
    digest = lambda lines: month_digests(_frame(spark, lines), "at")["2020-01"]
    one = (1, "2020-01-01", 1.0, "x")
    found = [digest([one]), digest([one, one]), digest([(1, "2020-01-01", None, "x")]), digest([(None, "2020-01-01", 1.0, "x")])]
    assert len(set(found)) == 4 and digest([(1, "2020-01-01", 1.0 + 1e-9, "x")]) == found[0]


def test_a_grown_order_table_equals_a_full_run(spark, tmp_path):
    raw, grown, whole = binding.retail_tables(spark, SF_DIR), str(tmp_path / "grown"), str(tmp_path / "whole")
    cut = F.col("order_purchase_timestamp") < F.lit("1997-06-10").cast("timestamp_ntz")
    refresh_daily(spark, raw | {"orders": raw["orders"].filter(cut)}, grown)
    done = refresh_daily(spark, raw, grown)
    build_tables(spark, raw, whole)
    for name in _TABLES:
        assert done[name].written[0] == "1997-06" and done[name].removed == []
        a, b = (read_table(spark, folder, name) for folder in (grown, whole))
        shown = [F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in a.dtypes]
        a, b = a.select(shown), b.select(*[c for c in a.columns]).select(shown)
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_sketches_merge_for_any_filter(spark):
    rows = spark.range(60000).select(
        (F.col("id") % 20000).alias("customer_unique_id"),
        F.element_at(F.array(*[F.lit(s) for s in "AB"]), (F.col("id") % 2 + 1).cast("int")).alias("customer_state"),
        F.when(F.col("id") % 5 > 0, "toys").alias("product_category"),
        F.expr("timestamp_ntz'2020-01-15' + make_ym_interval(0, cast(id % 3 as int))").alias("order_purchase_ts"),
    )
    sketches = dashboard.customer_sketches(rows).persist()
    merged = dashboard.approximate_customers(sketches, ["customer_state"]).collect()
    assert {r["customer_state"] for r in merged} == {"A", "B"} and all(abs(r["approximate_customers"] / 10000 - 1) < 0.05 and r["order_rows"] == 30000 for r in merged)
    few = dashboard.approximate_customers(sketches, [], "2020-02", "2020-03", ["A"], ["toys"]).first()
    exact = rows.filter("customer_state = 'A' AND product_category = 'toys' AND month(order_purchase_ts) > 1")
    assert few["order_rows"] == exact.count()
    assert abs(few["approximate_customers"] / exact.select("customer_unique_id").distinct().count() - 1) < 0.05
    assert dashboard.approximate_customers(sketches, [], states=["C"]).first()["approximate_customers"] == 0
