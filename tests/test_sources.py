"""Files in and out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketlens.schemas import RAW_SCHEMAS
from marketlens.sources import files
from marketlens.sources.scratch import checkpoint_root, materialize, scratch_run


def _write_raw(folder):
    texts = {name: ",".join(f.name for f in schema) + "\n" for name, schema in RAW_SCHEMAS.items()}
    texts["customers"] = (
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        'c1,u1,01234,"sao ""x"", paulo",SP\n'
        'c2,u2,5,"two\nlines",RJ\n'
    )
    texts["order_payments"] += "o1,voucher,1,NaN\no2,boleto,2,3.50\n"
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)


def test_raw_csv(spark, tmp_path):
    _write_raw(tmp_path)
    assert files.raw_files_available(spark, str(tmp_path))
    raw = files.load_raw_tables(spark, str(tmp_path), multi_line={"customers"})
    assert [r["customer_city"] for r in raw["customers"].collect()] == ['sao "x", paulo', "two\nlines"]
    assert raw["customers"].columns == [f.name for f in RAW_SCHEMAS["customers"]]
    assert [r["payment_value"] for r in raw["order_payments"].orderBy("order_id").collect()] == [None, 3.5]
    assert spark.table("orders").count() == 0


def test_large_flat_files_are_split(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    columns = RAW_SCHEMAS["orders"].fieldNames()
    for part in range(2):
        rows = "".join(f"o{part}-{i},c{i},delivered,2018-01-01 00:00:00,,\n" for i in range(20_000))
        (folder / f"part-{part}.csv").write_text(",".join(columns) + "\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = files.read_raw_csv(spark, str(folder), RAW_SCHEMAS["orders"])
        assert df.rdd.getNumPartitions() > 4 and df.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_missing_raw_files_are_named(spark, tmp_path):
    _write_raw(tmp_path)
    renamed = files.DEFAULT_FILES | {"products": "catalogue.csv"}
    with pytest.raises(files.MissingTableError, match="catalogue.csv"):
        files.load_raw_tables(spark, str(tmp_path), renamed)
    with pytest.raises(ValueError, match="lacks"):
        files.read_raw_csv(spark, str(tmp_path / "orders.csv"), RAW_SCHEMAS["products"])


def test_tables_round_trip(spark, tmp_path):
    base = str(tmp_path)
    with pytest.raises(files.MissingTableError):
        files.read_table(spark, base, "t")
    assert files.read_optional_table(spark, base, "t") is None
    df = spark.sql("SELECT id, date_add(DATE'2018-01-01', CAST(id * 20 AS INT)) AS order_date FROM range(10)")
    for _ in range(2):
        files.write_daily_parquet(df, f"{base}/t")
    assert files.read_table(spark, base, "t").count() == 10
    assert files.read_table(spark, base, "t", ["id"]).columns == ["id"]
    plan = files.read_table(spark, base, "t").filter("order_month = '2018-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan
    files.write_csv(df.select(F.lit('a "b",\nc').alias("s")).limit(1), base, "c")
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{base}/c").first()[0] == 'a "b",\nc'
    files.write_json(df.limit(1), f"{base}/j")
    assert files.read_json(spark, f"{base}/j", df.schema).count() == 1
    assert files.read_json(spark, f"{base}/absent", df.schema).count() == 0


def test_a_run_removes_its_own_tables_only(spark):
    before = materialize(spark.range(3))
    with scratch_run(spark):
        inside = materialize(spark.range(4))
        assert inside.count() == 4
    assert before.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|FAILED_READ_FILE"):
        inside.count()


def test_scratch_tables_use_the_configured_folder(spark):
    assert spark.conf.get("spark.checkpoint.dir").split(":")[-1] in checkpoint_root(spark)
    stored = materialize(spark.range(5))
    assert checkpoint_root(spark).split("file:")[-1] in stored.inputFiles()[0]
    assert stored.count() == 5
