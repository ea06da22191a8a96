"""Batches of encoded pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.ids import decoder_input, decoder_label, pad_mask, pad_right, token_length
from pairloom.operators.rank import rank_by_hash, rank_by_key, seeded_hash
from pairloom.workspace import materialize


def shuffle(df: DataFrame, seed: int = 42, key: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Rows in a seeded random order, given as ``rank``."""
    return rank_by_hash(df, seed, key).drop("n_total")


_MOST_CHUNKS = 4096  # stretches of batches; their first keys are what a task looks rows up in
_LEAST_ROWS = 4096  # of a stretch


def _chunk(order: Column, cuts: list[Column]) -> Column:
    """The number of cuts, which ascend, at or before a row: binary search in a literal array."""
    table, steps = F.array(*cuts), len(cuts).bit_length()

    def halve(state: Column, _: Column) -> Column:
        middle = ((state["low"] + state["high"]) / 2).cast("int")
        # 0-based middle < high <= the number of cuts, so the cut exists until low meets high.
        past = (state["low"] < state["high"]) & (F.get(table, middle) <= order)
        low = F.when(past, middle + 1).otherwise(state["low"])
        high = F.when(past | (state["low"] >= state["high"]), state["high"]).otherwise(middle)
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, halve, lambda state: state["low"])


def assign_batches(
    df: DataFrame, size: int = 32, seed: int | None = None, key: Sequence[str] = ("pair_id",)
) -> DataFrame:
    """Adds ``batch_id`` and ``batch_pos``: consecutive groups of ``size`` rows, the last maybe short.

    With a seed the rows are shuffled first, without one they stay in key order.
    ``key`` must be unique. ``df`` is evaluated once and written. Only its keys
    are ranked; the keys at which stretches of whole batches begin, 4,096 at
    most, then deal the rows out, in one exchange, so that every batch lies
    within a task. ``batch_chunk`` names its stretch: grouped by it as well,
    batches are built where their rows are.
    """
    rows = df if seed is None else df.withColumn("_hash", seeded_hash(seed, key))
    order = [*key] if seed is None else ["_hash", *key]
    rows = materialize(rows, "batch-rows")
    total = rows.count()
    per_chunk = math.ceil(max(_LEAST_ROWS, total / _MOST_CHUNKS) / size)
    ranked = rank_by_key(rows.select(*order), order)
    firsts = ranked.where((F.col("rank") % (per_chunk * size) == 0) & (F.col("rank") > 0)).orderBy("rank").collect()
    kinds = rows.schema
    cuts = [F.struct(*[F.lit(row[c]).cast(kinds[c].dataType).alias(c) for c in order]) for row in firsts]
    chunk = _chunk(F.struct(*order), cuts) if cuts else F.lit(0)
    within = Window.partitionBy("batch_chunk").orderBy(*order)
    placed = rows.withColumn("batch_chunk", chunk).withColumn("_pos", F.row_number().over(within) - 1)
    return placed.withColumns(
        {
            "batch_id": F.col("batch_chunk").cast("bigint") * per_chunk + F.expr(f"_pos div {int(size)}"),
            "batch_pos": (F.col("_pos") % size).cast("int"),
        }
    ).drop("_pos", *(["_hash"] if seed is not None else []))


def _batch_keys(df: DataFrame) -> list[str]:
    """What to group the rows of a batch by: with its stretch, where there is one, they need not move."""
    return ["batch_chunk", "batch_id"] if "batch_chunk" in df.columns else ["batch_id"]


def pad_batches(df: DataFrame) -> DataFrame:
    """One row per batch: ids of both sides padded to the longest of the batch, and the true lengths."""
    rows = F.array_sort(F.collect_list(F.struct("batch_pos", "src_ids", "tgt_ids")))
    grouped = df.groupBy(*_batch_keys(df)).agg(rows.alias("rows"))
    lengths = grouped.withColumns(
        {
            "src_lengths": F.transform("rows", lambda r: token_length(r["src_ids"])),
            "tgt_lengths": F.transform("rows", lambda r: token_length(r["tgt_ids"])),
        }
    )
    return lengths.select(
        "batch_id",
        F.transform("rows", lambda r: pad_right(r["src_ids"], F.array_max("src_lengths"))).alias("src"),
        F.transform("rows", lambda r: pad_right(r["tgt_ids"], F.array_max("tgt_lengths"))).alias("tgt"),
        "src_lengths",
        "tgt_lengths",
    )


def batch_shape(df: DataFrame) -> DataFrame:
    """Rows, padded widths and the share of padding of every batch."""
    src, tgt = token_length(F.col("src_ids")), token_length(F.col("tgt_ids"))
    cells = F.col("n_rows") * (F.col("src_width") + F.col("tgt_width"))
    return (
        df.groupBy(*_batch_keys(df))
        .agg(
            F.count("*").alias("n_rows"),
            F.max(src).alias("src_width"),
            F.max(tgt).alias("tgt_width"),
            F.sum(src + tgt).alias("n_ids"),
        )
        .withColumn("padding_share", 1 - F.col("n_ids") / cells)
        .drop("batch_chunk")
    )


def pad_masks(batches: DataFrame) -> DataFrame:
    """Adds the source mask of every padded batch."""
    return batches.withColumn("src_mask", F.transform("src", pad_mask))


def teacher_forcing_columns(batches: DataFrame) -> DataFrame:
    """Adds decoder inputs and labels: the padded targets without their last and first column."""
    return batches.withColumns(
        {
            "decoder_input": F.transform("tgt", decoder_input),
            "label": F.transform("tgt", decoder_label),
        }
    )
