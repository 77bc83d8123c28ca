"""Runs registered queries next to their SQL in DuckDB.

    python tests/oracle.py SF [name ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, bool):
        return int(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name, function, statement, sf_dir):
    """(ok, text) for one query."""
    t0 = time.time()
    frame = function(spark, sf_dir)
    got = [tuple(row) for row in frame.collect()]
    t1 = time.time()
    if statement is None:
        return True, f"{name}: {len(got)} rows, no SQL, {t1 - t0:.1f}s"
    relation = con.execute(statement)
    names = [d[0] for d in relation.description]
    want = relation.fetchall()
    timing = f"{t1 - t0:.1f}s/{time.time() - t1:.1f}s"
    if sorted(frame.columns) != sorted(names):
        return False, f"{name}: columns {sorted(frame.columns)} vs {sorted(names)}"
    a, b = _rows(frame.columns, got), _rows(names, want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        lacking = [r for r in b if r not in set(a)][:2]
        return False, f"{name}: {len(a)} vs {len(b)} rows; only Spark {extra}; only SQL {lacking} ({timing})"
    return True, f"{name}: {len(a)} rows equal ({timing})"


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .appName("logbraid-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main():
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        try:
            ok, text = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{name}: {type(error).__name__} {str(error)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", text, flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
