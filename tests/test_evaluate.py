import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate


@pytest.fixture
def upper():
    def make():
        return lambda texts: [t.upper() for t in texts]

    return make


@pytest.mark.parametrize("rows,n,batch,want", [(500, 100, 32, 128), (500, 96, 32, 96), (50, 100, 32, 50), (500, 1, 32, 32)])
def test_sample_is_whole_batches(spark, rows, n, batch, want):
    df = spark.range(rows).withColumnRenamed("id", "pair_id").repartition(5)
    got = evaluate.eval_sample(df, n, batch).orderBy("sample_id").collect()
    assert [r.pair_id for r in got] == list(range(want))
    assert [(r.batch_id, r.batch_pos) for r in got] == [(i // batch, i % batch) for i in range(want)]


def test_translate(spark, upper):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "sample_id int, source string").repartition(3)
    got = evaluate.translate_batches(df, upper, batch=7).collect()
    assert {r.sample_id: r.translation for r in got} == {i: f"TEXT {i}" for i in range(100)}


def test_translator_sees_small_batches(spark):
    def sized():
        return lambda texts: [str(len(texts))] * len(texts)

    df = spark.range(100, numPartitions=1).select(F.lit("x").alias("source"))
    assert {r.translation for r in evaluate.translate_batches(df, sized, batch=32).collect()} == {"32", "4"}


def test_wrong_number_of_translations_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "source string")
    with pytest.raises(Exception, match="translations"):
        evaluate.translate_batches(df.coalesce(1), lambda: lambda texts: texts[:1], batch=2).collect()


def test_evaluate_run(spark, upper):
    df = spark.range(50).withColumnRenamed("id", "pair_id").withColumn("source", F.lit("a b c d e"))
    sample = evaluate.eval_sample(df).withColumn("reference", F.lit("A B C D E"))
    score, examples = evaluate.evaluate_run(sample, upper)
    assert score.first().bleu == pytest.approx(100)
    assert examples.count() == 6


def test_every_text_is_translated_once_and_in_several_tasks(spark):
    from pyspark import TaskContext

    seen = spark.sparkContext.accumulator(0)

    def counting():
        task = str(TaskContext.get().partitionId())

        def translate(texts):
            seen.add(len(texts))
            return [task] * len(texts)

        return translate

    rows = spark.range(500).select(F.col("id").alias("pair_id"), F.concat(F.lit("text "), "id").alias("source"))
    sample = evaluate.eval_sample(rows).withColumn("reference", F.col("source"))
    score, examples = evaluate.evaluate_run(sample, counting)
    score.collect()
    assert len({r.translation for r in examples.collect()}) > 1
    assert seen.value == 128


def test_a_failed_run_goes_on_where_it_stopped(spark, tmp_path):
    """One batch kills the job; the rerun translates only what is missing."""
    path, calls, mended = str(tmp_path / "out"), tmp_path / "calls", tmp_path / "mended"
    calls.mkdir()

    def make():
        import os
        import time
        import uuid

        def translate(texts):
            if "text 7" in texts and not os.path.exists(mended):
                time.sleep(6)  # the other batches get done
                raise RuntimeError("lost")
            (calls / uuid.uuid4().hex).write_text("\n".join(texts))
            return [t.upper() for t in texts]

        return translate

    def translated():
        return sorted(t for f in calls.iterdir() for t in f.read_text().split("\n"))

    df = spark.range(60).select((F.col("id") % 6).alias("batch_id"), F.concat(F.lit("text "), "id").alias("source"))
    with pytest.raises(Exception, match="lost"):
        evaluate.translate_into(path, df, make, batch=10)
    before = translated()
    lost = {f"text {i}" for i in range(1, 60, 6)}
    assert len(before) == 50 and not lost & set(before)
    mended.touch()
    rows = evaluate.translate_into(path, df, make, batch=10).collect()
    assert sorted((r.batch_id, r.translation) for r in rows) == sorted((i % 6, f"TEXT {i}") for i in range(60))
    assert sorted(set(translated())) == sorted(before + sorted(lost)) and len(translated()) == 60
    evaluate.translate_into(path, df, make, batch=10).collect()
    assert len(translated()) == 60


def test_evaluate_run_keeps_its_translations(spark, upper, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("pair_id"), F.lit("a b c d e").alias("source"))
    sample = evaluate.eval_sample(rows).withColumn("reference", F.lit("A B C D E"))
    evaluate.evaluate_run(sample, upper, str(tmp_path / "kept"))

    def never():
        raise RuntimeError("not asked again")

    score, _ = evaluate.evaluate_run(sample, never, str(tmp_path / "kept"))
    assert score.first().bleu == pytest.approx(100)
