"""Translating a sample and scoring it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.bleu import corpus_bleu
from pairloom.operators.runs import pick_examples
from pairloom.workspace import exists, temporary_path

Translator = Callable[[list[str]], list[str]]


def eval_sample(df: DataFrame, n: int = 100, batch: int = 32, key: Sequence[str] = ("pair_id",)) -> DataFrame:
    """The first rows in key order, in whole batches until ``n`` is reached, with their batch and place.

    Every task keeps its own first rows, so nothing is sorted as a whole.
    """
    first = df.orderBy(*key).limit(math.ceil(n / batch) * batch)
    # Numbers the rows of the limit alone, a fixed count.
    place = F.row_number().over(Window.orderBy(*key)) - 1
    return (
        first.withColumn("sample_id", place)
        .withColumn("batch_id", F.floor(F.col("sample_id") / batch))
        .withColumn("batch_pos", F.col("sample_id") % batch)
    )


def translate_batches(
    df: DataFrame, make_translator: Callable[[], Translator], column: str = "source", batch: int = 32
) -> DataFrame:
    """Adds ``translation`` of a text column.

    ``make_translator`` runs once per task and returns a function from a list
    of texts to as many translations; it gets ``batch`` texts at a time.
    """

    def translate(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        translator = make_translator()
        for array in arrays:
            texts = array.to_pylist()
            out: list[str] = []
            for start in range(0, len(texts), batch):
                part = texts[start : start + batch]
                done = translator(part)
                if len(done) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(done)} translations")
                out += done
            yield pa.array(out, pa.string())

    return df.withColumn("translation", F.arrow_udf(translate, "string").asNondeterministic()(column))


_MOST_TASKS = 10_000


def translate_into(
    path: str, df: DataFrame, make_translator: Callable[[], Translator], column: str = "source", batch: int = 32
) -> DataFrame:
    """``df`` with ``translation``, written to ``path`` batch by batch; what is there already is not translated again.

    All rows of a ``batch_id`` lie in one task, and a task's file appears when
    the task ends, not with the job: a batch is there whole or not at all. So
    after a failure the next call translates only batches that are missing.
    There is a task for each batch, up to 10,000; beyond that tasks take
    several. ``path`` belongs to one sample and one translator.
    """
    spark = df.sparkSession
    schema = df.withColumn("translation", F.lit(None).cast("string")).schema
    missing = df
    if exists(spark, path):
        there = spark.read.schema(schema).parquet(path).select("batch_id").distinct()
        missing = df.join(there, "batch_id", "left_anti")
    ids = missing.agg(F.count_distinct("batch_id").alias("n")).first()["n"]
    if ids:
        tasks = min(ids, _MOST_TASKS)
        spread = missing.repartitionById(tasks, F.pmod("batch_id", F.lit(tasks)).cast("int"))
        done = translate_batches(spread, make_translator, column, batch).select(*schema.names)
        # Version 2 moves a task's file to its place when the task commits.
        done.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return spark.read.schema(schema).parquet(path)


def evaluate_run(
    sample: DataFrame, make_translator: Callable[[], Translator], path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """BLEU of a translator on a sample with ``source`` and ``reference``, and some examples.

    Batches are spread over tasks, translated once and written, so that the
    examples are those that were scored. With a ``path`` the translations stay
    there, and a run that failed goes on where it stopped.
    """
    translated = translate_into(path or temporary_path(sample.sparkSession, "translated"), sample, make_translator)
    return corpus_bleu(translated), pick_examples(translated)
