"""Epoch logs and translation samples of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def epoch_mean(steps: DataFrame, by: tuple[str, ...] = ("run", "epoch"), loss: str = "loss") -> DataFrame:
    """Plain mean of the step losses of every epoch."""
    return steps.groupBy(*by).agg(F.avg(loss).alias("mean_loss"), F.count("*").alias("n_steps"))


def _number(column: str) -> Column:
    """Null in place of NaN."""
    return F.when(~F.isnan(column), F.col(column))


def best_so_far(log: DataFrame) -> DataFrame:
    """Adds ``earlier_best`` and ``improved``: strictly below every earlier validation loss.

    The search starts from infinity, so a loss that is NaN, null or infinite
    never improves; NaN and null do not count as earlier losses.
    """
    earlier = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(_number("val_loss")).over(earlier)
    below = F.col("val_loss") < F.coalesce("earlier_best", F.lit(float("inf")))
    return log.withColumn("earlier_best", best).withColumn("improved", F.coalesce(below, F.lit(False)))


def patience_counter(log: DataFrame) -> DataFrame:
    """Adds ``waited``: the number of logged epochs since the last improvement, or since the start."""
    in_order = Window.partitionBy("run").orderBy("epoch")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = best_so_far(log).withColumn("_nth", F.row_number().over(in_order))
    last = F.max(F.when(F.col("improved"), F.col("_nth"))).over(so_far)
    return numbered.withColumn("waited", F.col("_nth") - F.coalesce(last, F.lit(0))).drop("_nth")


def early_stop_epoch(log: DataFrame, patience: int = 5) -> DataFrame:
    """Per run: the epoch at which training stops (null if it never does) and the epoch it keeps."""
    waited = patience_counter(log)
    stop = F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).over(Window.partitionBy("run"))
    ran = waited.withColumn("stop_epoch", stop).where(
        F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))
    )
    return ran.groupBy("run").agg(
        F.max("stop_epoch").alias("stop_epoch"),
        F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
        F.min(_number("val_loss")).alias("best_val_loss"),
    )


def run_summary(log: DataFrame) -> DataFrame:
    """Per run: lowest and last validation loss, and the number of epochs."""
    return log.groupBy("run").agg(
        F.min("val_loss").alias("min_val_loss"),
        F.max_by("val_loss", "epoch").alias("last_val_loss"),
        F.count("*").alias("epochs"),
    )


def compare_epochs(log: DataFrame, first: str, second: str, columns: tuple[str, ...] = ("val_loss",)) -> DataFrame:
    """The losses of two runs side by side; where one run ended earlier its side is null."""
    sides = [(run, c) for run in (first, second) for c in columns]
    return (
        log.where(F.col("run").isin(first, second))
        .groupBy("epoch")
        .agg(*[F.max(F.when(F.col("run") == run, F.col(c))).alias(f"{run}_{c}") for run, c in sides])
    )


def verdict_by_loss(log: DataFrame, first: str, second: str) -> DataFrame:
    """The run with the lower minimum of validation loss; a tie goes to the second.

    A run that is not in the log, or has no loss but NaN and null there, loses;
    if both are missing the winner is null.
    """
    lowest = log.agg(
        F.min(F.when(F.col("run") == first, _number("val_loss"))).alias("a"),
        F.min(F.when(F.col("run") == second, _number("val_loss"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    winner = F.when(a.isNull() & b.isNull(), F.lit(None)).when(b.isNull() | (a < b), first).otherwise(second)
    return lowest.select(winner.cast("string").alias("winner"))


def verdict_by_bleu(scores: DataFrame, first: str, second: str) -> DataFrame:
    """The run with the higher BLEU, or ``tie``; ``scores`` holds (run, bleu). A missing run scores 0."""
    scored = scores.agg(
        *[
            F.coalesce(F.max(F.when(F.col("run") == run, F.col("bleu"))), F.lit(0.0)).alias(side)
            for run, side in ((first, "a"), (second, "b"))
        ]
    )
    return scored.select(
        F.when(F.col("a") > F.col("b"), first).when(F.col("b") > F.col("a"), second).otherwise("tie").alias("winner")
    )


def compare_translations(a: DataFrame, b: DataFrame, first: str, second: str, in_order: bool = False) -> DataFrame:
    """Samples both runs translated: source, reference and one column per run.

    With ``in_order`` both runs are dealt out together by ranges of ``sample_id``
    in place of a join, so that sorting the result by it moves no row again.
    To find the ranges both are read once more.
    """
    left = a.select("sample_id", "source", "reference", F.col("translation").alias(first))
    if not in_order:
        return left.join(b.select("sample_id", F.col("translation").alias(second)), "sample_id")
    right = b.select("sample_id", F.struct(F.col("translation").alias(second)).alias("_other"))
    both = left.withColumn("_left", F.lit(True)).unionByName(right, allowMissingColumns=True)
    dealt = both.where(F.col("sample_id").isNotNull()).repartitionByRange("sample_id")
    others = F.collect_list("_other").over(Window.partitionBy("sample_id"))
    return dealt.withColumn("_others", others).where("_left").select(*left.columns, F.inline("_others"))


def compare_stored(spark: SparkSession, first: str, second: str) -> DataFrame:
    """The same of two runs that ``write_run`` stored under their names: bucket meets bucket where they lie."""
    return compare_translations(spark.table(first).hint("merge"), spark.table(second), first, second)


def head(df: DataFrame, n: int = 3, key: str = "sample_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def pick_examples(df: DataFrame, per_batch: int = 3, total: int = 10) -> DataFrame:
    """The first rows of every batch, in batch order, ``total`` at most.

    The position in the batch is a column, so no window is needed.
    """
    return df.where(F.col("batch_pos") < per_batch).orderBy("batch_id", "batch_pos").limit(total)
