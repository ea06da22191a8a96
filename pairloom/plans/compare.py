"""Comparing two training runs by their logs and by their translations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.config import PipelineConfig
from pairloom.operators.encode import decode_ids, load_model
from pairloom.operators.evaluate import Translator, eval_sample, evaluate_run
from pairloom.operators.runs import (
    compare_epochs,
    compare_translations,
    run_summary,
    verdict_by_bleu,
    verdict_by_loss,
)
from pairloom.plans.loaders import encode_split
from pairloom.sources.tables import read_splits, read_vocab, write_epoch_comparison, write_translation_comparison
from pairloom.workspace import materialize, temporary


def compare_models(log: DataFrame, first: str, second: str, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Write the losses of two runs side by side; returns their summaries and the winner."""
    losses = compare_epochs(log, first, second, ("train_loss", "val_loss"))
    write_epoch_comparison(losses, f"{out_dir}/model_comparison")
    both = log.where(F.col("run").isin(first, second))
    return run_summary(both), verdict_by_loss(both, first, second)


def evaluation_sample(spark: SparkSession, out_dir: str, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """The rows to translate: source text, and the reference as its ids give it back."""
    vocab, merges = read_vocab(spark, f"{out_dir}/subwords")
    target = load_model(vocab, merges, config.tgt_lang)
    sample = eval_sample(read_splits(spark, f"{out_dir}/splits", "test"), config.eval_rows, config.batch_size, ("pair_key",))
    return encode_split(spark, sample, out_dir, config).select(
        "sample_id",
        "batch_id",
        "batch_pos",
        F.col("src").alias("source"),
        decode_ids(F.col("tgt_ids"), target).alias("reference"),
    )


def evaluate_and_compare(
    spark: SparkSession,
    out_dir: str,
    translators: dict[str, Callable[[], Translator] | None],
    config: PipelineConfig = PipelineConfig(),
    resume: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Score two translators on the same sample, write their examples side by side.

    Returns (run, bleu) and the winner. A translator that is missing (None)
    scores 0, and then no examples are written. With ``resume`` translations are
    kept under ``out_dir``, and those that an earlier call left there are used.
    """
    first, second = translators
    with temporary(spark):
        sample = materialize(evaluation_sample(spark, out_dir, config), "evaluation-sample")
        scores, examples = [], []
        for run in (first, second):
            if translators[run] is None:
                scores.append((run, 0.0))
                continue
            score, picked = evaluate_run(sample, translators[run], f"{out_dir}/translations/{run}" if resume else None)
            scores.append((run, score.first()["bleu"]))
            examples.append(picked)
        if len(examples) == 2:
            both = compare_translations(examples[0], examples[1], first, second)
            write_translation_comparison(both, f"{out_dir}/translation_comparison")
    table = spark.createDataFrame(scores, "run string, bleu double")
    return table, verdict_by_bleu(table, first, second)
