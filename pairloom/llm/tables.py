"""What the operators of this package share: reading a table, guarding column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns that a result is about to add; names match whatever their case."""
    taken = {name.lower() for name in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case: ``name`` with underscores before it as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a string's UTF-8 bytes, which it has no function for: eight rounds a byte."""
    shift = "list_reduce(range(0, 8), lambda c, r: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(a, b))"
    byte = f"CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT)"
    bytes_ = f"list_transform(range(0, CAST(strlen({text}) AS BIGINT)), lambda i: {byte})"
    return f"xor(list_reduce({bytes_}, lambda a, b: {shift}, CAST(4294967295 AS BIGINT)), 4294967295)"
