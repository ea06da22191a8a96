import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pairloom.operators import rank, split


def hashed(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1003])
@pytest.mark.parametrize("parts", [1, 7])
def test_exact_sizes(spark, n, parts):
    df = spark.range(n).withColumnRenamed("id", "pair_id").repartition(parts)
    rows = split.split_pairs(df, exact=True).collect()
    held = math.ceil(0.2 * n)
    test = math.ceil(held / 2)
    sizes = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
    assert sizes == {"train": n - held, "val": held - test, "test": test}
    order = [i for _, i in sorted((hashed(i), i) for i in range(n))]
    assert {r.pair_id for r in rows if r.split == "train"} == set(order[: n - held])


def test_by_hash_needs_no_shuffle_and_ignores_layout(spark):
    df = spark.range(1000).withColumnRenamed("id", "pair_id")
    one = {r.pair_id: r.split for r in split.split_pairs(df.repartition(1)).collect()}
    seven = {r.pair_id: r.split for r in split.split_pairs(df.repartition(7)).collect()}
    assert one == seven and len(one) == 1000
    for i, name in one.items():
        head = hashed(i)[:8]
        assert name == ("train" if head < "cccccccc" else "val" if head < "e6666666" else "test")
    assert "Exchange" not in split.split_pairs(df)._jdf.queryExecution().executedPlan().toString()


def test_seed_and_key_change_the_split(spark):
    df = spark.range(500).select(F.col("id").alias("pair_id"), F.md5(F.col("id").cast("string")).alias("en"))
    base = [r.split for r in split.split_pairs(df).orderBy("pair_id").collect()]
    assert base != [r.split for r in split.split_pairs(df, seed=7).orderBy("pair_id").collect()]
    assert base != [r.split for r in split.split_pairs(df, key=["en"]).orderBy("pair_id").collect()]


@pytest.mark.parametrize("digits", [1, 4])
def test_rank_by_hash(spark, digits):
    df = spark.range(777).withColumnRenamed("id", "pair_id").repartition(5)
    rows = rank.rank_by_hash(df, 42, hex_digits=digits).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(777))
    assert [r.pair_id for r in rows] == [i for _, i in sorted((hashed(i), i) for i in range(777))]
    assert {r.n_total for r in rows} == {777}


def test_rank_by_key_with_uneven_keys(spark):
    keys = [i if i < 700 else 10**12 + i**3 for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "pair_id bigint").repartition(7)
    rows = rank.rank_by_key(df).orderBy("rank").collect()
    assert [r.pair_id for r in rows] == sorted(keys)
    assert [r.rank for r in rows] == list(range(1000))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, most", [(1, 1), (300, 1), (5000, 3), (5000, 1000)])
def test_rows_at_any_rank(spark, n, most):
    df = spark.range(n).select(F.col("id").alias("pair_id"), F.md5(F.col("id").cast("string")).alias("h")).repartition(5)
    order = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(n))
    ranks = sorted({0, 1, n // 3, n // 2, n - 1, n, n + 7})
    got = rank.rows_at(df, ["h", "pair_id"], ranks, "h", most)
    assert [r and tuple(r) for r in got] == [order[r] if r < n else None for r in ranks]


def test_rows_at_among_equal_hashes(spark):
    rows = [(None if i == 3 else f"k{i}", i % 3 or None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, m int").withColumn("h", F.lit("ab" * 16))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    got = rank.rows_at(df, ["h", "k", "m"], [0, 5, 39], "h", most=2)
    assert [tuple(r)[1:] for r in got] == [order[0], order[5], order[39]]
    row = got[1]
    before = df.where(rank.comes_before(["h", "k", "m"], row, df)).count()
    assert before == 5


def test_exact_split_moves_no_rows(spark):
    df = spark.range(2000).select(F.col("id").alias("pair_id"), F.repeat(F.lit("x"), 50).alias("en"))
    plan = _plan(split.split_pairs(df, exact=True))
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


@pytest.mark.parametrize("held_out", [0.0, 0.2, 1.0])
def test_exact_split_by_two_keys_that_read_alike(spark, held_out):
    """("a|b", "c") and ("a", "b|c") have one hash; nulls are keys like others."""
    rows = [("a|b", "c"), ("a", "b|c"), (None, "a|b|c"), ("a|b|c", None), *((str(i), "x") for i in range(46))]
    df = spark.createDataFrame(rows, "en string, vi string").repartition(3)
    got = [r.split for r in split.split_pairs(df, held_out, key=["en", "vi"], exact=True).collect()]
    held = math.ceil(held_out * 50)
    assert (got.count("train"), got.count("test")) == (50 - held, math.ceil(held / 2))


def test_shuffle_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(500).withColumnRenamed("id", "pair_id").mapInPandas(count, "pair_id bigint")
    ranked = rank.rank_by_hash(df, 3)
    assert _plan(ranked).count("FileScan") == 1
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(500)) and seen.value == 500
