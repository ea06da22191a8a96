"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In every round each shingle of a set falls
into one bin by a hash of that round, and a bin keeps the least value of the
first round that reached it; in the last ``BINS`` rounds all shingles fall into
the bin of the round, so every coordinate is filled, however small the set.
Two sketches agree in a coordinate with a chance equal to the Jaccard
similarity, as closely concentrated as under independent hash functions, for
one pass over the set and a few rounds.

Texts that agree in a band of coordinates are candidates. The pairs within a
bucket are never listed: its leader is compared with each other text L, by
full sets. For the rest this is exact, with D(x) the symmetric difference of x
and the leader: two texts that are both alike to the leader are one component
already; for any other pair, being alike means that |D(x) ^ D(y)| is small,
and since one of the two is far from the leader, D(x) and D(y) have to share
elements. So the pairs left are found by a prefix join on the rarest elements
of the differences. Texts that have only a passage in common differ by
elements of their own and meet nobody there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.tables import read_table
from pairloom.workspace import materialize

SHINGLE_WORDS = 5
PERCENT = 85  # Jaccard similarity of a link, in hundredths
BINS, ROWS = 256, 8  # 32 bands; a pair at 0.85 shares none with chance 4e-5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COMPARED = "u bigint, v bigint, u_size int, v_size int, shared int, difference array<bigint>"


def plain_words(text: Column) -> Column:
    """A-Z lower-cased, runs of the six ASCII blanks as one space; empty for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.btrim(F.regexp_replace(lowered, r"[\x09-\x0D ]+", " "))


def shingles(text: str, width: int = SHINGLE_WORDS) -> set[bytes]:
    """The word stretches of a text of ``plain_words``; all of it if it has fewer words, none if it is empty."""
    words = text.encode("utf-8", "surrogatepass").split(b" ") if text else []
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def alike(shared: int, a: int, b: int, percent: int = PERCENT) -> bool:
    """Whether sets of sizes a and b with so many common elements reach the similarity."""
    return 100 * shared >= percent * (a + b - shared)


def _sketcher(bins: int):
    """A function from the 64-bit hashes of a set, not empty, to its sketch."""
    import numpy as np

    bits = bins.bit_length() - 1
    if bins != 1 << bits:
        raise ValueError("the number of bins must be a power of two")
    round_bits = bits + 1  # rounds 0 to 2 * bins - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)

    def mixed(hashes, rounds):
        """Hashes of the elements (columns) in each round (rows)."""
        with np.errstate(over="ignore"):
            x = hashes ^ (rounds[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

    def sketch(hashes):
        least = np.full(bins, empty, np.uint64)
        at_once, start = max(1, 4096 // len(hashes)), 0
        while start < bins and (least == empty).any():
            rounds = np.arange(start, min(start + at_once, bins), dtype=np.uint64)
            for at in range(0, len(hashes), 1 << 16):
                values = mixed(hashes[at : at + (1 << 16)], rounds)
                # The round stands above the value: an earlier one wins.
                keys = (rounds[:, None] << np.uint64(64 - round_bits)) | (values >> np.uint64(round_bits))
                np.minimum.at(least, (values & np.uint64(bins - 1)).ravel().astype(np.int64), keys.ravel())
            start += at_once
        for bin_ in np.flatnonzero(least == empty):
            last = np.array([bins + bin_], np.uint64)
            least[bin_] = (last[0] << np.uint64(64 - round_bits)) | (mixed(hashes, last) >> np.uint64(round_bits)).min()
        return least

    return sketch


def sketch_bands(text: Column, width: int = SHINGLE_WORDS, bins: int = BINS, rows: int = ROWS) -> Column:
    """struct(n_shingles, bands) of a text of ``plain_words``: the size of its set and a hash for each band, none if it is empty."""

    @F.pandas_udf("struct<n_shingles:bigint,bands:array<bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from xxhash import xxh64_intdigest

        sketch = _sketcher(bins)
        for texts in batches:
            sizes, bands = [], []
            for text in texts:
                parts = shingles(text, width)
                sizes.append(len(parts))
                if not parts:
                    bands.append([])
                    continue
                hashes = np.fromiter(map(xxh64_intdigest, parts), np.uint64, len(parts))
                coordinates = sketch(hashes).reshape(-1, rows)
                bands.append([xxh64_intdigest(part.tobytes(), seed=b) - (1 << 63) for b, part in enumerate(coordinates)])
            yield pd.DataFrame({"n_shingles": pd.Series(sizes, dtype="int64"), "bands": pd.Series(bands, dtype=object)})

    return run(text)


def _comparer(width: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sizes, overlap and, where the sets differ, the hashes of what only one of them has."""
        from xxhash import xxh64_intdigest

        of, own = None, set()
        for batch in batches:
            rows = []
            for u, v, u_words, v_words in batch.itertuples(index=False, name=None):
                if of != u:  # rows come ordered by u, as the join leaves them
                    of, own = u, shingles(u_words, width)
                other = shingles(v_words, width)
                odd = [xxh64_intdigest(s) - (1 << 63) for s in own ^ other]
                rows.append((u, v, len(own), len(other), len(own & other), odd))
            yield pd.DataFrame(rows, columns=["u", "v", "u_size", "v_size", "shared", "difference"])

    return compare


def _compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) of keys of ``texts`` with the sizes of both sets, their overlap and their difference."""
    left, right = (texts.select(F.col("key").alias(x), F.col("words").alias(f"{x}_words")) for x in "uv")
    # The text of v moves to u, whose text, maybe met by many, is not copied before the task that compares.
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "u_words", "v_words")
    return both.mapInPandas(_comparer(width), COMPARED)


def _similar(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("u_size") + F.col("v_size") - F.col("shared"))


def _rest_pairs(stars: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of texts with a common leader that may be alike though one of them is not alike to the leader.

    ``stars`` is (star, u, v, v_size, difference, near): v compared with its
    leader u. With H the largest symmetric difference that alike texts of the
    two sizes may have, they need an overlap of (|D(x)| + |D(y)| - H) / 2
    elements of the differences, rounded up, so in one order of all elements
    the first |D| - overlap + 1 of both have one in common. The order is by
    the number of the leader's texts that have the element, rare ones first.
    """
    crowd = stars.groupBy("u").agg(F.count("*").alias("n"), F.min("near").alias("all_near")).where("n > 1 AND NOT all_near")
    # Written, its size is known before the join: while it is small, the texts of a large leader stay where they are.
    crowd = materialize(crowd.select("u"), "open-leaders")
    tokens = stars.join(crowd, "u").select(
        "u", "star", F.col("v_size").alias("size"), F.size("difference").alias("odd"), "near", F.explode("difference").alias("token")
    )
    # Elements of one text only meet nobody; they just take the first places in its order.
    counts = tokens.groupBy("u", "token").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    own = Window.partitionBy("star")
    placed = tokens.join(counts, ["u", "token"]).withColumns(
        {"place": F.row_number().over(own.orderBy("n", "token")), "met": F.count("*").over(own)}
    ).withColumn("place", F.col("odd") - F.col("met").cast("int") + F.col("place"))
    # The most places that any partner can ask for. A far text needs a partner within H of it, H being (1-t)/t of its
    # size at most; the partner of a near one is far, so more than (1-t)/(1+t) of both sizes away from the leader.
    far_limit = F.floor(F.col("size") * (100 - percent) / percent) + 1
    limit = F.when(F.col("near"), F.ceil(F.col("odd") * 100 / (100 + percent))).otherwise(far_limit)
    placed = materialize(placed.where(F.col("place") <= limit).select("u", "star", "size", "odd", "near", "token", "place"), "odd-elements")
    x = placed.where("NOT near").select("u", "token", *[F.col(c).alias(f"x_{c}") for c in ("star", "size", "odd", "place")])
    y = placed.select("u", "token", "near", *[F.col(c).alias(f"y_{c}") for c in ("star", "size", "odd", "place")])
    # |x ^ y| = |x| + |y| - 2 * overlap, and alike means overlap >= t / (1 + t) * (|x| + |y|).
    sizes = F.col("x_size") + F.col("y_size")
    least = F.ceil(sizes * percent / (100 + percent))
    overlap = F.ceil((F.col("x_odd") + F.col("y_odd") - (sizes - 2 * least)) / 2)
    fits = (F.col("x_place") <= F.col("x_odd") - overlap + 1) & (F.col("y_place") <= F.col("y_odd") - overlap + 1)
    fits = fits & (overlap <= F.least("x_odd", "y_odd")) & (least <= F.least("x_size", "y_size"))
    once = F.col("near") | (F.col("x_star") < F.col("y_star"))
    pairs = x.join(y, ["u", "token"]).where(once & (F.col("x_star") != F.col("y_star")) & fits).select("x_star", "y_star").distinct()
    for side in "xy":
        pairs = pairs.join(stars.select(F.col("star").alias(f"{side}_star"), F.col("v").alias(side)), f"{side}_star")
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct()


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE_WORDS,
    bins: int = BINS, rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id): one row per row of ``docs``; component_id is the smallest id reachable by links.

    A link is a Jaccard similarity of the shingle sets of ``percent`` hundredths
    or more, confirmed on the full sets. Texts without words have an empty set
    and are linked with nothing: each is its own component. Repeated rows stay
    repeated. Null ids count for the smallest id only if a component has no
    other; then it is null.
    """
    words = plain_words(F.col(f"`{text_col}`").cast("string"))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), words.alias("words"))
    digest = F.unhex(F.md5("words")).alias("fp")
    printed = read.select("id", digest, sketch_bands(F.col("words"), width, bins, rows).alias("s"))
    printed = materialize(printed.select("id", "fp", "s.n_shingles", "s.bands"), "sketches")
    full = printed.where("n_shingles > 0")
    # Texts of the same words collapse here, before any join; a number stands for each.
    unique = full.groupBy("fp").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"))
    unique = materialize(unique.withColumn("key", F.monotonically_increasing_id()), "sketched-texts")

    # Buckets of one text hold no candidate.
    banded = unique.select("key", F.explode("bands").alias("band"))
    crowds = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(banded.join(crowds, "band"), "buckets")
    # The leader of a bucket is its text of the most company: others are likeliest alike to it.
    company = met.groupBy("key").agg(F.sum("n").alias("company"))
    ranked = materialize(met.select("band", "key").join(company, "key"), "ranked-buckets")
    leaders = ranked.groupBy("band").agg(F.max(F.struct("company", "key")).alias("top")).select("band", F.col("top.key").alias("u"))
    stars = ranked.join(leaders, "band").where("key <> u").select("u", F.col("key").alias("v")).distinct()
    stars = materialize(stars, "stars")
    named = stars.select(F.col("u").alias("key")).unionByName(stars.select(F.col("v").alias("key"))).distinct()
    named = materialize(unique.select("key", "fp", "first_id").join(named, "key"), "candidates")
    # One row of each text, found by its id too, so that copies do not meet; always a merge, as the candidates grow
    # with the input and cannot be broadcast.
    same = (F.col("fp") == F.col("own")) & F.col("id").eqNullSafe(F.col("first_id"))
    texts = read.select("id", digest.alias("own"), "words").join(named.hint("merge"), same)
    texts = materialize(texts.groupBy("key").agg(F.first("words").alias("words")), "candidate-texts")

    compared = _compared(stars, texts, width).select("u", "v", "v_size", "difference", _similar(percent).alias("near"))
    compared = materialize(compared.withColumn("star", F.monotonically_increasing_id()), "compared")
    links = compared.where("near").select("u", "v")
    rooted = materialize(components(links).withColumnRenamed("vertex", "key"), "star-roots")
    rest = _rest_pairs(compared, percent)
    for side in ("u", "v"):
        root = rooted.select(F.col("key").alias(side), F.col("root").alias(f"{side}_root"))
        rest = rest.join(root, side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    rest = materialize(rest.where("u_root <> v_root").select("u", "v"), "rest-pairs")
    more = _compared(rest, texts, width).where(_similar(percent)).select("u", "v")
    links = materialize(links.unionByName(more), "links")

    classes = unique.select("key", "fp", "first_id").join(components(links).withColumnRenamed("vertex", "key"), "key", "left")
    classes = materialize(classes.withColumn("root", F.coalesce("root", "key")), "classes")
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = full.select("id", "fp", "n_shingles").join(classes.join(smallest, "root").select("fp", "component_id"), "fp")
    alone = printed.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return groups.select("id", "n_shingles", "component_id").unionByName(alone)


def op12_minhash_groups(spark, sf_dir):
    """The near-duplicate component of every document, and whether it is the one to keep."""
    groups = near_duplicate_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
