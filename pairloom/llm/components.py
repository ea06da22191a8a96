"""Connected components of a large graph by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.workspace import discard, materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a vertex to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low"))
    lowest = lowest.select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the smallest of them; edges lead from large to small."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("low").alias("v")))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (u, v): root is the smallest vertex reachable.

    Alternates the two star operations, which end in a star around each root
    after a number of rounds that grows with the logarithm of the graph. Every
    round is written to the shared folder, so a lost executor costs a re-read;
    the driver sees one row per round. Self-loops and repeated edges are
    ignored; a root is returned as its own member.
    """
    current = materialize(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = _signature(current)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        moved = materialize(_small_star(_large_star(current).distinct()).distinct(), "edges")
        discard(current)
        current, after = moved, _signature(moved)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
