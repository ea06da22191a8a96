"""Every registered query against its SQL on the smallest tables."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from checks.oracles import ORACLES
from checks.queries import QUERIES
from checks.compare import connect, differences, oracle_rows, spark_rows, type_differences

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert {r.stage for r in rows} <= {"train", "val", "test"} and rows


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    sql = driver.oracle_sql()[name]
    assert not differences(spark_rows(df), oracle_rows(duck, sql))
    assert not type_differences(df, duck, sql)


def test_library_never_holds_whole_tables():
    root = Path(__file__).resolve().parents[1] / "pairloom"
    for path in root.rglob("*.py"):
        source = path.read_text(encoding="utf-8")
        for word in ("toPandas", "crossJoin", "localCheckpoint", ".rdd"):
            assert word not in source, f"{word} in {path}"


def test_inputs_that_stand_for_untidy_text_are_untidy(spark):
    """Normalising must have something to do in the queries about it."""
    from checks import views
    from pairloom.functions.text import nfc, squeeze, subword_normalize

    lines = views.document_lines(spark, SF_DIR).select(views.dirtied(F.col("text")).alias("t"))
    for step in (nfc, squeeze, subword_normalize):
        assert lines.where(step(F.col("t")) != F.col("t")).count() > 50
