"""Run registered queries beside their SQL and compare whole results.

Usage: python tests/checker.py [sf_dir] [name ...]
CHECK_EXACT=1 compares doubles bit by bit instead of to 9 digits.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EXACT = os.environ.get("CHECK_EXACT") == "1"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def make_session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomlog-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_duckdb(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        if math.isnan(value):
            return (0, "nan")
        return (1, repr(value) if EXACT else f"{value:.9g}" if value else "0")
    return (1, repr(value))


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*columns))


def _types(table):
    fix = {"large_string": "string", "timestamp[us]": "timestamp", "timestamp[ns]": "timestamp"}
    return {n: fix.get(str(table.schema.field(n).type), str(table.schema.field(n).type)) for n in table.column_names}


def compare(spark, con, name, query, sql, sf_dir) -> list[str]:
    """Differences between both results; empty when they agree."""
    mine = query(spark, sf_dir).toArrow()
    con.execute(f"CREATE OR REPLACE TEMP VIEW wanted AS {sql}")
    theirs = con.sql("SELECT * FROM wanted").to_arrow_table()
    problems = []
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return [f"columns {sorted(mine.column_names)} != {sorted(theirs.column_names)}"]
    if _types(mine) != _types(theirs):
        a, b = _types(mine), _types(theirs)
        problems.append("types " + ", ".join(f"{n}: {a[n]} != {b[n]}" for n in a if a[n] != b[n]))
    if mine.num_rows != theirs.num_rows:
        problems.append(f"rows {mine.num_rows} != {theirs.num_rows}")
    a, b = _rows(mine), _rows(theirs)
    if a != b:
        left, right = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        problems.append(f"values spark={left} sql={right}")
    return problems


def main(argv) -> int:
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:]
    spark, con = make_session(), make_duckdb(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problems = compare(spark, con, name, query, oracles[name], sf_dir) if name in oracles else ["no sql"]
        except Exception as exc:  # report and go on with the next query
            problems = [f"{type(exc).__name__}: {str(exc)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '}{name} {time.time() - start:.2f}s {'; '.join(problems)[:900]}", flush=True)
    print(f"{len(queries)} queries, {bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
