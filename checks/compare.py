"""Runs registered queries beside their SQL: python -m checks.compare [sf dir] [name ...]."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


# DuckDB's names of Spark's types, as far as results use them.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_differences(df, con, sql: str) -> str:
    described = con.execute(f"DESCRIBE {sql}" if not sql.startswith("WITH RECURSIVE") else f"DESCRIBE SELECT * FROM ({sql})")
    want = {row[0]: row[1] for row in described.fetchall()}
    got = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    return ", ".join(f"{c}: {got.get(c)} for {want[c]}" for c in want if got.get(c) != want[c])


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), [tuple(row[i] for i in order) for row in cursor.fetchall()]


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(row[n] for n in names) for row in df.collect()]


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: [(v is not None, v) for v in row])


def differences(got, want) -> str:
    """Empty if both hold the same columns and rows."""
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows instead of {len(want[1])}"
    for a, b in zip(_sorted(got[1]), _sorted(want[1])):
        if a != b:
            return f"row {str(a)[:300]} instead of {str(b)[:300]}"
    return ""


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = spark_rows(df)
            middle = time.time()
            verdict = differences(got, oracle_rows(con, ORACLES[name])) if name in ORACLES else "no SQL"
            if name in ORACLES and not verdict:
                verdict = type_differences(df, con, ORACLES[name])
            print(f"{name:24} {middle - start:7.2f}s {time.time() - middle:7.2f}s {len(got[1]):7} {verdict or 'equal'}", flush=True)
        except Exception as error:
            print(f"{name:24} {type(error).__name__}: {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
