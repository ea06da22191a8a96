"""Tables and files a run writes and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.workspace import new_path

RUN_BUCKETS = 64


def write_corpus_text(df: DataFrame, column: str, path: str) -> None:
    """One sentence per line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def write_vocab(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/merges")


def read_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    schema = "id INT, piece STRING, freq BIGINT, kind STRING, lang STRING"
    vocab = spark.read.schema(schema).parquet(f"{path}/vocab")
    schema = "rank INT, l STRING, r STRING, freq BIGINT, lang STRING"
    merges = spark.read.schema(schema).parquet(f"{path}/merges")
    return vocab.select("lang", "id", "piece", "freq", "kind"), merges.select("lang", "rank", "l", "r", "freq")


def write_csv(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    # Blanks at the ends belong to the text.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_epoch_comparison(df: DataFrame, path: str) -> None:
    """The losses of two runs by epoch, in epoch order."""
    write_csv(df.orderBy("epoch"), path)


def write_translation_comparison(df: DataFrame, path: str) -> None:
    """The sample sentences of two runs side by side, in sample order."""
    write_csv(df.orderBy("sample_id"), path)


def write_run(df: DataFrame, table: str, buckets: int = RUN_BUCKETS) -> DataFrame:
    """The translations of a run as a table dealt into buckets by ``sample_id``, one file each; returns it read back.

    Runs written with as many buckets are compared without moving a row.
    """
    spark = df.sparkSession
    writer = df.repartition(buckets, "sample_id").write.mode("overwrite").option("path", new_path(spark, f"run-{table}"))
    # Whole texts, mostly: a third of the bytes less than by the default codec.
    writer = writer.option("compression", "zstd")
    writer.bucketBy(buckets, "sample_id").sortBy("sample_id").saveAsTable(table)
    return spark.table(table)
