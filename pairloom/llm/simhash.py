"""SimHash near-duplicates, found by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Two fingerprints at most two
bits apart either differ by at most one bit in the high segment or agree in
the low one. So each probes the table of the high segment with the small ball
of radius one around its own value, and the table of the low segment with its
own value; what the tables return is checked on all 64 bits.

A bucket with more than ``MAX_BUCKET`` different fingerprints would make the
pairs within it grow with the square of its size. Fingerprints in or next to
such a bucket take an exact other way: any two of them at most two bits apart
share a point of the radius-one balls around their whole values, and such a
point gathers 65 fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.tables import fresh, read_table
from pairloom.workspace import materialize

SHINGLE_WORDS = 3
HASH_SEED = 42
SEGMENT_BITS = 32
MAX_DISTANCE = 2
MAX_BUCKET = 256


def _hasher():
    import numpy as np
    from functools import partial

    from xxhash import xxh64_intdigest

    hash64 = partial(xxh64_intdigest, seed=HASH_SEED)
    rows = 4096  # hashes whose bits are unpacked at a time

    def fingerprint(text: str | None) -> int:
        # bytes.lower() and bytes.split() know ASCII letters and the six ASCII blanks only.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return 0
        if len(words) < SHINGLE_WORDS:
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
        n = max(1, len(words) - SHINGLE_WORDS + 1)
        hashes = np.fromiter(map(hash64, shingles), "<u8", n)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, rows):
            part = hashes[at : at + rows].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        bits = np.packbits(2 * ones > n, bitorder="little")
        return int(bits.view("<i8")[0])

    return fingerprint


def simhash(text: Column) -> Column:
    """The 64-bit SimHash of a text's word shingles as a bigint; null and blank texts give 0."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fingerprint = _hasher()
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return run(text)


def as_hex(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _masks(bits: int) -> Column:
    one = F.lit(1).cast("bigint")
    return F.explode(F.array(F.lit(0).cast("bigint"), *[F.shiftleft(one, i) for i in range(bits)]))


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_links(fingerprints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(u, v) over different fingerprints ``fp``: every pair at most two bits apart is joined by a chain of links.

    Outside crowded buckets each such pair is a link of its own. ``fp`` must be
    unique and not null; an empty table gives no links.
    """
    low_bits = F.lit((1 << SEGMENT_BITS) - 1)
    keyed = fingerprints.select(
        "fp",
        F.shiftrightunsigned("fp", SEGMENT_BITS).alias("high"),
        F.col("fp").bitwiseAND(low_bits).alias("low"),
    )

    def crowded(segment: str) -> DataFrame:
        return materialize(keyed.groupBy(segment).count().where(F.col("count") > max_bucket).select(segment), "crowded")

    high_crowds, low_crowds = crowded("high"), crowded("low")

    table = keyed.join(high_crowds, "high", "left_anti").select("fp", "high")
    # Of two values one bit apart, the one whose bit is 0 probes; the mask 0 probes the own bucket.
    probes = (
        table.withColumn("mask", _masks(SEGMENT_BITS))
        .where(F.col("high").bitwiseAND(F.col("mask")) == 0)
        .select(F.col("fp").alias("u"), F.col("high").bitwiseOR(F.col("mask")).alias("high"), "mask")
    )
    by_high = (
        probes.join(table.withColumnRenamed("fp", "v"), "high")
        .where((_differing("u", "v") <= MAX_DISTANCE) & ((F.col("mask") != 0) | (F.col("u") < F.col("v"))))
        .select("u", "v")
    )
    table = keyed.join(low_crowds, "low", "left_anti")
    by_low = (
        table.select(F.col("fp").alias("u"), "low")
        .join(table.select(F.col("fp").alias("v"), "low"), "low")
        .where((F.col("u") < F.col("v")) & (_differing("u", "v") <= MAX_DISTANCE))
        .select("u", "v")
    )
    around = high_crowds.withColumn("mask", _masks(SEGMENT_BITS)).select(
        F.col("high").bitwiseXOR(F.col("mask")).alias("high")
    )
    packed = (
        keyed.join(around.distinct(), "high", "left_semi").select("fp")
        .unionByName(keyed.join(low_crowds, "low", "left_semi").select("fp"))
        .distinct()
    )
    shared = (
        packed.withColumn("mask", _masks(2 * SEGMENT_BITS))
        .groupBy(F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
        .agg(F.collect_list("fp").alias("members"))  # 65 at most
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
        .where((F.col("u") != F.col("v")) & (_differing("u", "v") <= MAX_DISTANCE))
    )
    return by_high.unionByName(by_low).unionByName(shared)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(id, fp, component_id): one row per row of ``docs``; component_id is the smallest id reachable by links.

    Rows with equal fingerprints are linked, those of blank or null texts
    (fingerprint 0) included. Repeated rows stay repeated. Null ids count for
    the smallest id only if a component has no other; then it is null.
    """
    printed = materialize(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp")), "simhash")
    # Copies collapse here, before any join: one row per fingerprint.
    unique = materialize(printed.groupBy("fp").agg(F.min("id").alias("first_id")), "fingerprints")
    rooted = components(near_links(unique.select("fp"), max_bucket)).withColumnRenamed("vertex", "fp")
    classes = unique.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return printed.join(classes.join(named, "root").select("fp", "component_id"), "fp")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One document of each group, that with the smallest id; all its columns stay as they are.

    Blank and null texts form one group. If an id names several rows, each is
    judged by its own text, and equal ones count as one. A group without any
    id keeps one row.
    """
    return one_of_each(docs, near_groups(docs, id_col, text_col, max_bucket), simhash(F.col(text_col)), id_col, text_col)


def one_of_each(docs: DataFrame, groups: DataFrame, fingerprint: Column, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``groups`` (id, fp, component_id) keeps; ``fingerprint`` gives fp from the text."""
    groups = materialize(groups, "near-groups")
    is_first = F.col("id").eqNullSafe(F.col("component_id"))
    repeated = materialize(groups.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    own, kept_id, kept_fp, nth = (fresh(docs, name) for name in ("own_fp", "kept_id", "kept_fp", "nth"))
    same_id = docs[id_col].eqNullSafe(F.col(kept_id))
    # The ids that go are fewer than those that stay; written, their size tells Spark how to join.
    gone = groups.where(~is_first).select("id").unionByName(repeated).distinct().withColumnRenamed("id", kept_id)
    stay = docs.join(materialize(gone, "near-copies"), same_id, "left_anti")
    if repeated.isEmpty():
        return stay
    again = docs.join(repeated.select(F.col("id").alias(kept_id)), same_id, "left_semi")
    again = again.withColumn(own, fingerprint)
    again = again.join(
        groups.where(is_first).select(F.col("id").alias(kept_id), F.col("fp").alias(kept_fp)),
        F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_fp)),
        "left_semi",
    )
    first = Window.partitionBy(id_col, own).orderBy(text_col)
    again = again.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth, own)
    return stay.unionByName(again)


def op9_simhash_groups(spark, sf_dir):
    groups = near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"), "component_id")
