"""python tests/try_queries.py SF NAME...: run queries on local[8], compare with their SQL, print times."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    q, sql, con = entry.queries(), entry.oracle_sql(), connect(sf)
    for name in sys.argv[2:] or q:
        t = time.time()
        df = q[name](spark, sf)
        if name in sql:
            print(name, differences(df, con, sql[name])[:1500] or "same", f"{time.time() - t:.1f} s", flush=True)
        else:
            print(name, f"{len(df.collect())} rows, no SQL, {time.time() - t:.1f} s", flush=True)
