import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.operators import batches


@pytest.fixture
def encoded(spark):
    rows = [(i, [2, *([7] * (i % 5)), 3], [2, *([8] * (i % 3)), 3]) for i in range(101)]
    return spark.createDataFrame(rows, "pair_id bigint, src_ids array<int>, tgt_ids array<int>").repartition(7)


def test_batches_in_order(encoded):
    rows = batches.assign_batches(encoded, 32).collect()
    assert {r.pair_id: (r.batch_id, r.batch_pos) for r in rows} == {i: (i // 32, i % 32) for i in range(101)}


def test_batches_shuffled(encoded):
    order = sorted(range(101), key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
    rows = batches.assign_batches(encoded, 10, seed=7).orderBy("batch_id", "batch_pos").collect()
    assert [r.pair_id for r in rows] == order
    assert [r.batch_pos for r in rows] == [k % 10 for k in range(101)]


def test_padding(encoded):
    rows = batches.pad_batches(batches.assign_batches(encoded, 32)).orderBy("batch_id").collect()
    assert [len(r.src) for r in rows] == [32, 32, 32, 5]
    for r in rows:
        for matrix, lengths in ((r.src, r.src_lengths), (r.tgt, r.tgt_lengths)):
            width = max(lengths)
            for ids, n in zip(matrix, lengths):
                assert len(ids) == width and all(ids[:n]) and not any(ids[n:])
        assert r.src_lengths == [2 + (32 * r.batch_id + k) % 5 for k in range(len(r.src))]


def test_shape_agrees_with_padding(encoded):
    batched = batches.assign_batches(encoded, 32, seed=1)
    shape = {r.batch_id: r for r in batches.batch_shape(batched).collect()}
    for r in batches.pad_batches(batched).collect():
        s = shape[r.batch_id]
        assert (s.n_rows, s.src_width, s.tgt_width) == (len(r.src), len(r.src[0]), len(r.tgt[0]))
        zeros = sum(ids.count(0) for ids in r.src + r.tgt)
        cells = sum(map(len, r.src + r.tgt))
        assert s.n_ids == cells - zeros and s.padding_share == pytest.approx(zeros / cells) and 0 <= s.padding_share < 1


def test_masks_and_shifts(encoded):
    padded = batches.pad_batches(batches.assign_batches(encoded, 32))
    for r in batches.teacher_forcing_columns(batches.pad_masks(padded)).collect():
        assert r.src_mask == [[i != 0 for i in ids] for ids in r.src]
        assert r.decoder_input == [ids[:-1] for ids in r.tgt]
        assert r.label == [ids[1:] for ids in r.tgt]


@pytest.mark.parametrize("seed", [None, 5])
@pytest.mark.parametrize("least, most", [(1, 4096), (40, 3), (7, 1)])
def test_batches_across_stretches(spark, monkeypatch, seed, least, most):
    """Stretches of any length give the same batches."""
    monkeypatch.setattr(batches, "_LEAST_ROWS", least)
    monkeypatch.setattr(batches, "_MOST_CHUNKS", most)
    df = spark.range(523).select((F.col("id") * 7 - 1000).alias("pair_id")).repartition(6)
    rows = batches.assign_batches(df, 10, seed=seed).orderBy("batch_id", "batch_pos").collect()
    ids = [i * 7 - 1000 for i in range(523)]
    if seed is not None:
        ids.sort(key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())
    assert [r.pair_id for r in rows] == ids
    assert [(r.batch_id, r.batch_pos) for r in rows] == [(k // 10, k % 10) for k in range(523)]


def test_batches_by_two_keys_with_nulls(spark):
    keys = [(a, b) for a in (None, "", "x", "é") for b in (None, 1, 2, 30)]
    df = spark.createDataFrame(keys, "a string, b int").repartition(3)
    rows = batches.assign_batches(df, 3, key=["a", "b"]).orderBy("batch_id", "batch_pos").collect()
    assert [(r.a, r.b) for r in rows] == sorted(keys, key=lambda k: (k[0] is not None, k[0] or "", k[1] is not None, k[1] or 0))


def test_no_batches_of_no_rows(spark, encoded):
    assert batches.pad_batches(batches.assign_batches(encoded.limit(0))).count() == 0


@pytest.mark.parametrize("seed", [None, 5])
def test_a_batch_is_built_where_its_rows_lie(spark, encoded, seed, monkeypatch):
    """The input is evaluated once, and full rows are exchanged once."""
    monkeypatch.setattr(batches, "_LEAST_ROWS", 32)
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    padded = batches.pad_batches(batches.assign_batches(encoded.mapInArrow(count, encoded.schema), 32, seed))
    assert padded._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert padded.count() == 4 and seen.value == 101
