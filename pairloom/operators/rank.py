"""Gapless global row numbers without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from pairloom.workspace import materialize


def seeded_hash(seed: int, key: Sequence[str]) -> Column:
    """32 hex digits that depend on the seed and the key columns only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def _with_offsets(placed: DataFrame, buckets: DataFrame, bucket: str) -> DataFrame:
    """Adds the rows before each bucket and the rows in total.

    ``buckets`` has one row per bucket, a number bounded by the caller and
    independent of the data, so one task may accumulate it and every task may
    hold it.
    """
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        bucket,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
        F.sum("n").over(Window.partitionBy()).alias("_total"),
    )
    return placed.join(F.broadcast(offsets), bucket)


def rank_by_hash(df: DataFrame, seed: int, key: Sequence[str] = ("pair_id",), hex_digits: int = 4) -> DataFrame:
    """Adds ``rank`` (from 0) in the order of the seeded hash, and ``n_total``.

    ``key`` must be unique. ``df`` is evaluated once and written with its
    hashes. Rows spread evenly over 16^hex_digits buckets by the head of the
    hash; each bucket is numbered on its own and shifted by the sizes of those
    before it, which are counted first, so the result reads the written rows
    once. It depends on the rows alone, not on how they are partitioned.
    """
    if not 1 <= hex_digits <= 4:
        raise ValueError("hex_digits must lie between 1 and 4")
    hashed = df.withColumn("_hash", seeded_hash(seed, key))
    hashed = materialize(hashed.withColumn("_bucket", F.substring("_hash", 1, hex_digits)), "hashed")
    # 65,536 counts at most, whatever the number of rows.
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("n")).collect()
    buckets = df.sparkSession.createDataFrame(counts, "_bucket string, n bigint")
    within = Window.partitionBy("_bucket").orderBy("_hash", *key)
    placed = hashed.withColumn("_pos", F.row_number().over(within) - 1)
    return (
        _with_offsets(placed, buckets, "_bucket")
        .withColumn("rank", F.col("_before") + F.col("_pos"))
        .withColumnRenamed("_total", "n_total")
        .drop("_hash", "_bucket", "_pos", "_before")
    )


def rows_at(df: DataFrame, order: Sequence[str], ranks: Sequence[int], hex_column: str, most: int = 1000) -> list[Row | None]:
    """The rows that stand at the given ranks (from 0) in ascending ``order``, None beyond the last row.

    ``hex_column``, the first of ``order``, holds lowercase hex digits that
    spread evenly. A histogram of four digits, 65,536 counts, tells which
    bucket holds a rank; only that bucket is looked into by the next four,
    until one of at most ``most`` rows is left, or one value. So the driver
    holds bounded counts and rows, and no row is shuffled.
    """
    if order[0] != hex_column:
        raise ValueError("the hex column comes first in the order")
    wanted = {rank: ("", rank) for rank in ranks}  # a prefix and the rank among the rows that have it
    found: dict[int, Row | None] = {}
    width = 0
    while wanted:
        head = F.substring(hex_column, 1, width + 4)
        below = {prefix for prefix, _ in wanted.values()}
        inside = df.where(F.substring(hex_column, 1, width).isin(sorted(below))) if width else df
        counts: dict[str, list] = {prefix: [] for prefix in below}
        for row in inside.groupBy(head.alias("head")).agg(F.count("*").alias("n")).orderBy("head").collect():
            counts[row["head"][:width]].append(row)
        width += 4
        for rank, (prefix, place) in list(wanted.items()):
            for bucket in counts[prefix]:
                if place < bucket["n"]:
                    break
                place -= bucket["n"]
            else:
                found[rank] = None
                del wanted[rank]
                continue
            wanted[rank] = (bucket["head"], place)
            if bucket["n"] <= most or width >= 32:
                of_bucket = df.select(*order).where(F.substring(hex_column, 1, width) == bucket["head"])
                found[rank] = of_bucket.orderBy(*order).limit(place + 1).collect()[-1]
                del wanted[rank]
    return [found[rank] for rank in ranks]


def comes_before(order: Sequence[str], row: Row, df: DataFrame) -> Column:
    """Whether a row of ``df`` stands before the given one; nulls come first, as in a sort."""
    kinds = df.select(*order).schema
    values = F.struct(*[F.lit(row[name]).cast(kinds[name].dataType).alias(name) for name in order])
    return F.struct(*[F.col(name) for name in order]) < values


def rank_by_key(df: DataFrame, key: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Adds ``rank`` (from 0) in the order of the unique ``key``, and ``n_total``.

    Finding the ranges runs the input once more, so add costly columns after.
    A range shuffle lays the rows out in order whatever the spread of the key;
    the layout is written once, so positions and part sizes come from the same
    rows.
    """
    laid = (
        df.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    laid = materialize(laid, "ranked")
    # monotonically_increasing_id: partition above bit 33, position below.
    placed = laid.withColumns(
        {"_part": F.shiftright("_place", 33), "_pos": F.col("_place").bitwiseAND((1 << 33) - 1)}
    )
    parts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    return (
        _with_offsets(placed, parts, "_part")
        .withColumn("rank", F.col("_before") + F.col("_pos"))
        .withColumnRenamed("_total", "n_total")
        .drop("_place", "_part", "_pos", "_before")
    )
