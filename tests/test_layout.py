"""Results do not depend on how rows are partitioned."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import batches, bleu, evaluate, pairs, runs, split, subword

TEXT = ["the cat sat", "a dog, ran 3.5 km", "", "Hà  Nội đẹp", "the cat sat", "x" * 120, "một hai"]


def _pairs(spark):
    rows = [(i, TEXT[i % 7], TEXT[(i * 3 + i // 7) % 7]) for i in range(150)]
    return spark.createDataFrame(rows, "pair_id bigint, en string, vi string")


def _prepared(df):
    return pairs.filter_pairs(pairs.measure_pairs(pairs.clean_pairs(pairs.dedup_pairs(df))))


def _ids(df):
    return df.withColumns({"src_ids": F.array(F.length("en")), "tgt_ids": F.array(F.length("vi"), F.lit(5))})


def _scored(df):
    return df.select(F.col("pair_id").alias("sample_id"), F.col("en").alias("translation"), F.col("vi").alias("reference"))


def _log(df):
    return df.select(
        (F.col("pair_id") % 3).cast("string").alias("run"),
        F.col("pair_id").alias("epoch"),
        (F.length("en") * 7 % 11 * 1.0).alias("val_loss"),
    )


OPERATORS = {
    "prepared": _prepared,
    "union": lambda df: pairs.union_sources(df, df),
    "reasons": lambda df: pairs.reject_reason(pairs.measure_pairs(pairs.clean_pairs(df))),
    "split": split.split_pairs,
    "split exact": lambda df: split.split_pairs(df, exact=True),
    "words": lambda df: subword.word_counts(df, "vi", ("Hà Nội",)),
    "pair counts": lambda df: subword.pair_counts(subword.word_counts(df, "en")),
    "vocabulary": lambda df: subword.learn_bpe(subword.word_counts(df, "en"), 40)[0],
    "batches": lambda df: batches.pad_batches(batches.assign_batches(_ids(df), 8)),
    "shuffled batches": lambda df: batches.pad_batches(batches.assign_batches(_ids(df), 8, seed=3)),
    "shapes": lambda df: batches.batch_shape(batches.assign_batches(_ids(df), 8, seed=3)),
    "sample": lambda df: evaluate.eval_sample(df, 20, 8),
    "examples": lambda df: runs.pick_examples(batches.assign_batches(df, 8)),
    "bleu": lambda df: bleu.corpus_bleu(_scored(df)),
    "early stop": lambda df: runs.early_stop_epoch(_log(df), 2),
    "summary": lambda df: runs.run_summary(_log(df)),
    "epochs": lambda df: runs.compare_epochs(_log(df), "0", "1"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_same_rows_at_one_and_seven_partitions(spark, name):
    results = []
    for parts in (1, 7):
        df = OPERATORS[name](_pairs(spark).repartition(parts))
        columns = sorted(df.columns)
        results.append(sorted(str([row[c] for c in columns]) for row in df.collect()))
    assert results[0] == results[1]
    assert results[0]
