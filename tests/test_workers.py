"""Queries in a process that only has the driver's path, and stored tables."""

import os
import subprocess
import sys

from loomlog.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.queries()["pearson_visit"](spark, "/root/testdata/sf0.001").count())
rows = entry.queries()["pearson_visit"](spark, "/root/testdata/sf0.001").collect()
print("P", all(r.p_value is not None for r in rows))
"""


def test_p_values_without_the_package_on_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "P True" in done.stdout, done.stderr[-2000:]


def test_stored_tables_follow_their_input_and_settings(spark):
    made = [tables.stored(spark, "t", "in", lambda: spark.range(n), settings=(n,)).count() for n in (3, 5)]
    assert made == [3, 5]
    assert tables.table_path(spark, "t", "in", (3,)) != tables.table_path(spark, "t", "in", (5,))
