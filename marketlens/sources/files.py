"""CSV, Parquet and JSON sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.schemas import RAW_SCHEMAS

MONTH_COLUMN = "order_month"
DEFAULT_FILES = {name: f"{name}.csv" for name in RAW_SCHEMAS}


class MissingTableError(FileNotFoundError):
    """A required input or table does not exist."""


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).exists(target)


def missing_raw_files(spark: SparkSession, raw_dir: str, files: dict[str, str] | None = None) -> list[str]:
    files = files or DEFAULT_FILES
    return [name for name in files.values() if not path_exists(spark, f"{raw_dir}/{name}")]


def raw_files_available(spark: SparkSession, raw_dir: str, files: dict[str, str] | None = None) -> bool:
    return not missing_raw_files(spark, raw_dir, files)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is a missing value, whatever the source."""
    return df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def read_raw_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Read the named columns of a CSV with a header and a fixed schema.

    Columns are matched by header name, so files may hold more columns or another order.
    A path may be a folder of files. Files are split over tasks unless ``multi_line`` is set, which
    allows line breaks in quoted fields and keeps each file in one task.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )
    header = reader.option("inferSchema", False).csv(path).columns
    types = {field.name: field.dataType for field in schema}
    absent = [name for name in types if name not in header]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    full = T.StructType([T.StructField(name, types.get(name, T.StringType())) for name in header])
    df = reader.schema(full).option("enforceSchema", True).csv(path)
    return without_nan(df.select(*types))


def load_raw_tables(
    spark: SparkSession,
    raw_dir: str,
    files: dict[str, str] | None = None,
    multi_line: set[str] | bool = False,
) -> dict[str, DataFrame]:
    """Raw tables by name; multi_line: all tables, none, or the names of those with line breaks in fields."""
    files = files or DEFAULT_FILES
    missing = missing_raw_files(spark, raw_dir, files)
    if missing:
        raise MissingTableError(f"Missing raw files in {raw_dir}: {', '.join(missing)}")
    tables = {
        name: read_raw_csv(spark, f"{raw_dir}/{file}", RAW_SCHEMAS[name], multi_line if isinstance(multi_line, bool) else name in multi_line)
        for name, file in files.items()
    }
    register_tables(tables)
    return tables


def register_tables(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet directory; the rebalance hint lets AQE choose even file sizes."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_daily_parquet(df: DataFrame, path: str, date_column: str = "order_date") -> None:
    """Write a dated table in month folders, so that date filters prune partitions."""
    month = F.date_format(date_column, "yyyy-MM").alias(MONTH_COLUMN)
    write_parquet(df.select("*", month), path, [MONTH_COLUMN])


def write_csv(df: DataFrame, out_dir: str, name: str) -> str:
    path = f"{out_dir}/{name}"
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, data_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read a processed table from its one location, with only the named columns."""
    path = f"{data_dir}/{name}"
    if not path_exists(spark, path):
        raise MissingTableError(f"Could not find table '{name}' at {path}.")
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_optional_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame | None:
    try:
        return read_table(spark, data_dir, name)
    except MissingTableError:
        return None


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read stored metrics; an absent path gives an empty frame."""
    if path_exists(spark, path):
        return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)
