"""Inputs of the registered queries: pairs, logs and samples derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_id(group: str, within: Column) -> Column:
    """A number for a row of a group: the group above bit 32, the place below."""
    return F.shiftleft(F.col(group), 32) + within


def bitext_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents, line by line: (pair_id, en, vi)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = docs.select(F.col("doc_id").alias("left_id"), F.col("text").alias("left_text"))
    right = docs.select(F.col("doc_id").alias("right_id"), F.col("text").alias("right_text"))
    couple = (F.col("left_id") + 1 == F.col("right_id")) & (
        F.expr("left_id div 2") == F.expr("right_id div 2")
    )
    sides = F.arrays_zip(F.split("left_text", "\n").alias("en"), F.split("right_text", "\n").alias("vi"))
    lines = left.join(right, couple).select("left_id", F.posexplode(sides))
    return lines.where(F.col("col.en").isNotNull() & F.col("col.vi").isNotNull()).select(
        (_row_id("left_id", F.col("pos") + 1)).alias("pair_id"), "col.en", "col.vi"
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: (line_id, text)."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select(_row_id("doc_id", F.col("pos") + 1).alias("line_id"), "text")


# What is put in place of plain text, so that normalising has something to do:
# a letter and its accent, blanks and controls of other kinds, a wide letter.
DIRT = (("é", "e\u0301"), (" the ", "\u00a0 the\u001c "), (" de ", "\t de \u2003"), ("and", "ａnd"))


def dirtied(text: Column) -> Column:
    for plain, dirt in DIRT:
        text = F.replace(text, F.lit(plain), F.lit(dirt))
    return text


def bitext_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn after it: (pair_id, en, vi)."""
    turns = _table(spark, sf_dir, "conversations")
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("en"))
    answer = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("vi")
    )
    return user.join(answer, ["conv_id", "turn"]).select(
        (_row_id("conv_id", F.col("turn"))).alias("pair_id"), "en", "vi"
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch log: event types as runs, days as epochs. (run, epoch, val_loss)."""
    daily = (
        _table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("day"))
        .agg(F.round(F.avg("value"), 6).alias("val_loss"))
    )
    by_day = Window.partitionBy("run").orderBy("day")
    return daily.select("run", F.row_number().over(by_day).alias("epoch"), "val_loss")


def ragged_metrics(spark: SparkSession, sf_dir: str, short_run: str) -> DataFrame:
    """The same log with NaN in the first epoch, one run that ends after 20 epochs, and train_loss."""
    log = run_metrics(spark, sf_dir).where((F.col("run") != short_run) | (F.col("epoch") <= 20))
    loss = F.when(F.col("epoch") == 1, F.lit(float("nan"))).otherwise(F.col("val_loss"))
    return log.select("run", "epoch", (F.col("val_loss") / 2).alias("train_loss"), loss.alias("val_loss"))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single events as training steps: (run, epoch, loss)."""
    epoch = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), epoch.alias("epoch"), F.col("value").alias("loss")
    )


def _without_every(text: Column, nth: int) -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w, i: (i + 1) % nth != 0), " ")


def scored_lines(spark: SparkSession, sf_dir: str, nth: int = 5) -> DataFrame:
    """Lines and what is left of them without every nth word: (sample_id, source, reference, translation)."""
    lines = (
        _table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.col("line") != "")
    )
    return lines.select(
        (_row_id("doc_id", F.col("pos") + 1)).alias("sample_id"),
        F.col("line").alias("source"),
        F.col("line").alias("reference"),
        _without_every(F.col("line"), nth).alias("translation"),
    )
