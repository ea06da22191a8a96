"""Reproducible train, validation and test parts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.rank import comes_before, rows_at, seeded_hash
from pairloom.workspace import materialize


def split_by_hash(
    df: DataFrame, held_out: float = 0.2, seed: int = 42, key: Sequence[str] = ("pair_id",)
) -> DataFrame:
    """Adds ``split`` from where the seeded hash of the key falls: no shuffle, sizes about right."""
    head = F.substring(seeded_hash(seed, key), 1, 8)

    def below(share: float):
        return head < f"{int(share * 2**32):08x}"

    return df.withColumn(
        "split",
        F.when(below(1 - held_out), "train").when(below(1 - held_out / 2), "val").otherwise("test"),
    )


def split_exact(
    df: DataFrame, held_out: float = 0.2, seed: int = 42, key: Sequence[str] = ("pair_id",)
) -> DataFrame:
    """Adds ``split`` with exact sizes: ceil(held_out * n) rows held out, the larger half of them test.

    ``key`` must be unique. Its hashes are written once; the two rows at which
    the parts begin are selected from them by histograms. Then each row is told
    its part by itself: no row is ranked or shuffled.
    """
    order = ["_hash", *key]
    keys = materialize(df.select(*key).withColumn("_hash", seeded_hash(seed, key)), "split-keys")
    total = keys.count()
    held = math.ceil(held_out * total)
    val, test = rows_at(keys, order, [total - held, total - math.ceil(held * 0.5)], "_hash")
    hashed = df.withColumn("_hash", seeded_hash(seed, key))
    part = F.lit("train") if val is None else F.when(comes_before(order, val, hashed), "train").otherwise("val")
    if test is not None:
        part = F.when(comes_before(order, test, hashed), part).otherwise("test")
    return hashed.withColumn("split", part).drop("_hash")


def split_pairs(
    df: DataFrame,
    held_out: float = 0.2,
    seed: int = 42,
    key: Sequence[str] = ("pair_id",),
    exact: bool = False,
) -> DataFrame:
    return (split_exact if exact else split_by_hash)(df, held_out, seed, key)
