"""From two pair files to cleaned splits and subword vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairloom.config import PipelineConfig
from pairloom.functions.terms import VIETNAMESE_TERMS
from pairloom.operators.pairs import (
    REASONS,
    clean_pairs,
    content_key,
    dedup_pairs,
    measure_pairs,
    reject_reason,
    stage_counts,
    union_sources,
)
from pairloom.operators.split import split_pairs
from pairloom.operators.subword import learn_bpe, word_counts
from pairloom.sources.pairs import read_pairs_csv, read_pairs_tsv
from pairloom.sources.tables import read_splits, write_splits, write_vocab
from pairloom.workspace import discard, materialize, temporary


def load_pairs(spark: SparkSession, csv_path: str, tsv_path: str) -> DataFrame:
    """Distinct raw pairs of both files, each with the key of its content; malformed records stay, without texts."""
    both = union_sources(read_pairs_csv(spark, csv_path, keep_malformed=True), read_pairs_tsv(spark, tsv_path))
    return content_key(dedup_pairs(both))


def prepare_pairs(
    raw: DataFrame, out_dir: str, config: PipelineConfig = PipelineConfig(), exact_split: bool = False
) -> DataFrame:
    """Clean, measure, filter, split and write ``raw``; returns the rows per stage.

    One pass: the reject counts are observed while the kept pairs are written.
    The split depends on the two texts of a pair alone, so it survives any new
    layout of the input files, and pairs that differ in other columns only stay
    together. Exact sizes follow ``pair_key`` and need the kept pairs written
    once before.
    """
    bounds = (config.min_len, config.max_chars, config.length_ratio)
    labelled = reject_reason(measure_pairs(clean_pairs(raw, term_mode=config.term_mode)), *bounds)
    seen = Observation("reasons")
    labelled = labelled.observe(seen, *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    kept = labelled.where(F.col("reason") == "kept").drop("reason")
    key = ["pair_key"] if exact_split else ["en", "vi"]
    if exact_split:
        kept = materialize(kept, "kept-pairs")
    write_splits(split_pairs(kept, config.held_out, config.seed, key, exact_split), f"{out_dir}/splits")
    if exact_split:
        discard(kept)

    spark = raw.sparkSession
    reasons = spark.createDataFrame(list(seen.get.items()), "stage string, n_rows bigint")
    return reasons.unionByName(stage_counts(read_splits(spark, f"{out_dir}/splits"), "split"))


def learn_vocabularies(spark: SparkSession, out_dir: str, config: PipelineConfig = PipelineConfig()) -> None:
    """Learn and write the vocabularies of both languages from the written splits."""
    pairs = read_splits(spark, f"{out_dir}/splits", None if config.fit_on == "all" else "train")
    learned = []
    for lang, symbols in (("en", ()), ("vi", VIETNAMESE_TERMS)):
        words = word_counts(pairs, f"{lang}_normalized", symbols)
        learned.append(learn_bpe(words, config.vocab_size, lang, symbols, min_freq=config.min_pair_freq))
    (en_vocab, en_merges), (vi_vocab, vi_merges) = learned
    write_vocab(en_vocab.unionByName(vi_vocab), en_merges.unionByName(vi_merges), f"{out_dir}/subwords")


def process(
    spark: SparkSession,
    csv_path: str,
    tsv_path: str,
    out_dir: str,
    config: PipelineConfig = PipelineConfig(),
    exact_split: bool = False,
) -> DataFrame:
    """The whole preparation; returns the rows per stage."""
    with temporary(spark):  # what reading and deduplication have written goes with it
        counts = prepare_pairs(load_pairs(spark, csv_path, tsv_path), out_dir, config, exact_split)
    learn_vocabularies(spark, out_dir, config)
    return counts
