"""Runs named queries and their SQL on the same tables and compares the rows."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def connection(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, folder):
    """None if equal, else what differs."""
    frame = entry.queries()[name](spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if ours else "no rows"
    found = con.execute(sql)
    theirs_names = [c[0] for c in found.description]
    if sorted(theirs_names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(theirs_names)}"
    theirs = rows_of(theirs_names, found.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} against {b}"
    return None


def main():
    from pyspark.sql import SparkSession

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{scale}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    wanted = sys.argv[2:] or sorted(entry.queries())
    bad = 0
    for name in wanted:
        start = time.time()
        problem = compare(spark, con, name, folder)
        bad += problem is not None
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{name:40s} {kind:4s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print(f"{len(wanted)} queries, {bad} differ")


if __name__ == "__main__":
    main()
