import pytest

from pyspark.sql import functions as F

from pairloom.operators import runs

LOG = "run string, epoch int, val_loss double"


def log(spark, **losses):
    rows = [(run, e, float(v)) for run, values in losses.items() for e, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, LOG).repartition(3)


def loop(losses, patience):
    """Early stopping as a loop over epochs: (stop epoch, kept epoch)."""
    best, waited, kept = float("inf"), 0, None
    for epoch, loss in enumerate(losses, 1):
        if loss < best:
            best, waited, kept = loss, 0, epoch
        else:
            waited += 1
        if waited >= patience:
            return epoch, kept
    return None, kept


SERIES = {
    "a": [5, 4, 4, 4.5, 3, 3.2, 3.1, 3.3, 3.4, 3.5],
    "b": [2, 1, 1, 1, 1, 1, 0.5],
    "c": [3, 2, 1],
    "d": [1, 1, 1, 1, 0],
}
EXPECTED = {("a", 2): 4, ("a", 3): 8, ("a", 5): 10, ("b", 2): 4, ("b", 3): 5, ("b", 5): None}


@pytest.mark.parametrize("patience", [1, 2, 3, 5])
def test_early_stop(spark, patience):
    got = {r.run: r for r in runs.early_stop_epoch(log(spark, **SERIES), patience).collect()}
    for run, losses in SERIES.items():
        stop, kept = loop(losses, patience)
        assert (got[run].stop_epoch, got[run].best_epoch) == (stop, kept)
        assert got[run].best_val_loss == losses[kept - 1]
        if (run, patience) in EXPECTED:
            assert stop == EXPECTED[run, patience]


def test_improvement_is_strict(spark):
    rows = runs.patience_counter(log(spark, b=SERIES["b"])).orderBy("epoch").collect()
    assert [r.improved for r in rows] == [True, True, False, False, False, False, True]
    assert [r.waited for r in rows] == [0, 0, 1, 2, 3, 4, 0]
    assert [r.earlier_best for r in rows] == [None, 2, 1, 1, 1, 1, 1]


def test_epoch_mean_is_unweighted(spark):
    steps = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 5.0)], "run string, epoch int, loss double")
    assert sorted(map(tuple, runs.epoch_mean(steps).collect())) == [("a", 1, 1.5, 2), ("a", 2, 5.0, 1)]


def test_summary_and_verdicts(spark):
    both = log(spark, x=[3, 1, 2], y=[1, 4])
    assert sorted(map(tuple, runs.run_summary(both).collect())) == [("x", 1.0, 2.0, 3), ("y", 1.0, 4.0, 2)]
    assert runs.verdict_by_loss(both, "x", "y").first().winner == "y"
    assert runs.verdict_by_loss(log(spark, x=[0.5], y=[1]), "x", "y").first().winner == "x"


@pytest.mark.parametrize("scores,winner", [([("x", 2.0), ("y", 1.0)], "x"), ([("x", 1.0), ("y", 2.0)], "y"), ([("x", 1.0), ("y", 1.0)], "tie"), ([("y", 1.0)], "y"), ([("x", 0.0)], "tie")])
def test_verdict_by_bleu(spark, scores, winner):
    assert runs.verdict_by_bleu(spark.createDataFrame(scores, "run string, bleu double"), "x", "y").first().winner == winner


def test_epochs_of_unequal_runs(spark):
    rows = runs.compare_epochs(log(spark, x=[3, 1, 2], y=[1, 4]), "x", "y").orderBy("epoch").collect()
    assert [tuple(r) for r in rows] == [(1, 3, 1), (2, 1, 4), (3, 2, None)]


def test_translations_side_by_side(spark):
    schema = "sample_id int, source string, reference string, translation string"
    a = spark.createDataFrame([(i, f"s{i}", f"r{i}", f"a{i}") for i in range(5)], schema)
    b = spark.createDataFrame([(i, f"s{i}", f"r{i}", f"b{i}") for i in range(4)], schema)
    compared = runs.compare_translations(a, b, "one", "two")
    assert compared.count() == 4
    assert [tuple(r) for r in runs.head(compared).collect()] == [(i, f"s{i}", f"r{i}", f"a{i}", f"b{i}") for i in range(3)]


def test_examples(spark):
    rows = spark.createDataFrame([(b, p) for b in range(5) for p in range(4 if b != 1 else 2)], "batch_id int, batch_pos int")
    got = [tuple(r) for r in runs.pick_examples(rows.repartition(4)).collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1)]


def test_losses_that_are_no_numbers_never_improve(spark):
    nan, inf = float("nan"), float("inf")
    rows = runs.patience_counter(log(spark, a=[nan, 3, nan, 2, inf], b=[nan, inf, nan])).orderBy("run", "epoch").collect()
    assert [r.improved for r in rows] == [False, True, False, True, False, False, False, False]
    assert [r.waited for r in rows] == [1, 0, 1, 0, 1, 1, 2, 3]
    got = {r.run: r for r in runs.early_stop_epoch(log(spark, a=[nan, 3, nan, 2, inf], b=[nan, inf, nan]), 3).collect()}
    assert (got["a"].stop_epoch, got["a"].best_epoch, got["a"].best_val_loss) == (None, 4, 2.0)
    assert (got["b"].stop_epoch, got["b"].best_epoch) == (3, None)


def test_waiting_counts_logged_epochs(spark):
    rows = [("a", 1, 2.0), ("a", 5, 3.0), ("a", 9, 3.0)]
    waited = runs.patience_counter(spark.createDataFrame(rows, LOG)).orderBy("epoch").collect()
    assert [r.waited for r in waited] == [0, 1, 2]


def test_a_missing_run_loses(spark):
    both = log(spark, x=[3, 1], y=[float("nan")])
    assert [runs.verdict_by_loss(both, *two).first().winner for two in (("x", "z"), ("z", "x"), ("x", "y"), ("y", "x"), ("y", "z"))] == ["x", "x", "x", "x", None]


def test_stored_runs_are_compared_without_an_exchange(spark):
    from pairloom.sources.tables import write_run

    rows = spark.range(500).select(F.col("id").alias("sample_id"), F.lit("s").alias("source"), F.lit("r").alias("reference"))
    for name, factor in (("stored_one", 2), ("stored_two", 3)):
        write_run(rows.withColumn("translation", (F.col("sample_id") * factor).cast("string")).where(f"sample_id % {factor + 2} > 0"), name, 8)
    both = runs.compare_stored(spark, "stored_one", "stored_two")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert {(r.sample_id, r.stored_one, r.stored_two) for r in both.collect()} == {
        (i, str(2 * i), str(3 * i)) for i in range(500) if i % 4 and i % 5
    }
    for name in ("stored_one", "stored_two"):
        spark.sql(f"DROP TABLE {name}")


def test_translations_in_order_are_those_of_the_join(spark):
    """ids that repeat or are null, null texts, samples of one run only; one exchange, with the sort too."""
    rows = [(3, "c", "c"), (1, "a", None), (1, "a", "x"), (None, "n", "n"), (2, "b", "b"), (5, "e", "e")]
    kind = "sample_id bigint, source string, translation string"
    a = spark.createDataFrame(rows, kind).selectExpr("sample_id", "source", "source AS reference", "translation")
    b = spark.createDataFrame([(1, "-", "p"), (1, "-", None), (2, "-", "q"), (3, "-", "r"), (4, "-", "s"), (None, "-", "t")], kind)
    joined = runs.compare_translations(a, b, "x", "y")
    ordered = runs.compare_translations(a, b, "x", "y", in_order=True)
    assert ordered.columns == joined.columns
    assert sorted(map(str, ordered.collect())) == sorted(map(str, joined.collect())) and ordered.count() == 6
    by_id = ordered.orderBy("sample_id")
    assert by_id._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [r.sample_id for r in by_id.collect()] == [1, 1, 1, 1, 2, 3]


def test_stored_runs_are_packed(spark):
    """stored runs took a third more bytes."""
    from pairloom.sources import tables

    df = spark.createDataFrame([(1, "a", "a", "a")], "sample_id bigint, source string, reference string, translation string")
    stored = tables.write_run(df, "packed_run", 2)
    assert all(name.endswith(".zstd.parquet") or ".zstd." in name for name in stored.inputFiles())
    spark.sql("DROP TABLE packed_run")
