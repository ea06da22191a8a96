"""From splits and vocabularies to padded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.config import PipelineConfig
from pairloom.operators.batches import assign_batches, pad_batches
from pairloom.operators.encode import encode_pairs, load_model
from pairloom.operators.pairs import orient
from pairloom.sources.tables import read_splits, read_vocab
from pairloom.workspace import temporary


def encode_split(
    spark: SparkSession, pairs: DataFrame, out_dir: str, config: PipelineConfig = PipelineConfig()
) -> DataFrame:
    """Adds the ids of both sides to cleaned pairs."""
    vocab, merges = read_vocab(spark, f"{out_dir}/subwords")
    src, tgt = (load_model(vocab, merges, lang) for lang in (config.src_lang, config.tgt_lang))
    return encode_pairs(orient(pairs, config.src_lang, config.tgt_lang), src, tgt, config.max_ids)


def write_batches(spark: SparkSession, out_dir: str, config: PipelineConfig = PipelineConfig()) -> str:
    """Encode every split once and write its batches: training rows shuffled, the others in the order of their keys.

    Batches are assigned first, while rows are cheap to read twice.
    """
    path = f"{out_dir}/batches"
    for split in ("train", "val", "test"):
        seed = config.seed if split == "train" else None
        with temporary(spark):
            batched = assign_batches(read_splits(spark, f"{out_dir}/splits", split), config.batch_size, seed, ("pair_key",))
            batches = pad_batches(encode_split(spark, batched, out_dir, config))
            batches.write.mode("overwrite").parquet(f"{path}/split={split}")
    return path


def read_batches(spark: SparkSession, out_dir: str, split: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/batches").where(F.col("split") == split).drop("split")
