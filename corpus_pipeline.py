"""From raw documents to a training mix: language, near-duplicates, benchmark leaks, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.decontaminate import decontaminate
from pairloom.llm.language import UNKNOWN, learn_from_documents, predict
from pairloom.llm.mixing import drawn_corpus
from pairloom.llm.simhash import near_dedup
from pairloom.llm.tables import fresh, read_table
from pairloom.workspace import discard, new_path, temporary

MIN_LANGUAGE_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; ``lang`` stays as it was.

    Rejected are texts that are null or have no letter, and those for which no
    language is likelier than all others together.
    """
    lang, score = fresh(docs, "judged_lang"), fresh(docs, "judged_score")
    judged = predict(docs, learn_from_documents(docs), lang_out=lang, score_out=score)
    kept = judged.where((F.col(lang) != UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints link: the one with the smallest id."""
    return near_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, whole, with the words it takes of each and their places in the shards."""
    return drawn_corpus(docs)


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

# The language stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each result is written and read back."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with temporary(spark):  # what the stage itself has written goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(before)
        docs = before = spark.read.parquet(path)
    return docs
