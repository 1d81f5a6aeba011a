"""Run registered queries against DuckDB by hand: python tests/check_queries.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from __spark_entry__ import oracle_sql, queries
from tests.oracle_check import connect, differences


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                found = differences(df, con, oracles[name])
                verdict = "ok" if not found else "DIFF " + " | ".join(found)
            else:
                rows = df.collect()
                verdict = f"rows {len(rows)} {rows[:2]}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__} {str(error)[:1500]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
