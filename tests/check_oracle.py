"""Command line: python tests/check_oracle.py SF_DIR [name ...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, n, took = compare(spark, con, build, sql.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem, n, took = f"{type(exc).__name__}: {str(exc)[:1500]}", 0, 0.0
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:24} {n:8} {took:6.2f}s "
              f"{'' if name in sql else '(rows only)'} {problem}", flush=True)
    print("failures:", bad)
