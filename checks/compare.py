"""Run queries on Spark and their SQL on DuckDB and compare all rows.

    python -m checks.compare [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import time

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import CATALOG

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hearken")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # the test tables are small: do not merge their partitions below the number of cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        tuple(repr(r[i]) if not isinstance(r[i], float) else f"{r[i]:.9g}" for i in order)
        for r in rows
    )


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, float, float]:
    make, sql = CATALOG[name]
    start = time.time()
    df = make(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_seconds = time.time() - start
    if sql is None:
        return f"{len(got)} rows, no SQL", spark_seconds, 0.0
    start = time.time()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    wanted = result.fetchall()
    sql_seconds = time.time() - start
    if sorted(df.columns) != sorted(columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}", spark_seconds, sql_seconds
    a, b = _canonical(got, df.columns), _canonical(wanted, columns)
    if a == b:
        return f"ok {len(a)} rows", spark_seconds, sql_seconds
    differing = [(x, y) for x, y in zip(a, b) if x != y][:1]
    return f"DIFFER {len(a)} / {len(b)} rows {str(differing)[:600]}", spark_seconds, sql_seconds


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark, con = local_session(), duck(args.sf)
    for name in args.names or CATALOG:
        try:
            verdict, s, q = compare(spark, con, args.sf, name)
        except Exception as problem:  # a broken query must not hide the others
            verdict, s, q = f"ERROR {type(problem).__name__}: {str(problem)[:500]}", 0.0, 0.0
        print(f"{name:32} {verdict}   spark {s:.1f}s sql {q:.1f}s", flush=True)


if __name__ == "__main__":
    main()
