"""Compare all registered queries with their SQL: run_oracle.py FOLDER [NAME ...]"""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from oracle import connect, differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main(folder, *names):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(folder), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = differences(query(spark, folder), con, oracles[name])
            else:
                problem = None if query(spark, folder).count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {time.time() - start:6.2f}s {name}{kind}", problem or "", flush=True)
        failed += [name] if problem else []
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(*sys.argv[1:])
