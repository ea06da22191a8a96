"""Importance resampling towards a target distribution of hashed n-grams, with CRCs of prefixes.

A document becomes its words joined by one separator and is scanned once: the
running CRC-32 before and after every word is kept. The CRC of any stretch of
words follows from two of them: appending k bytes to a prefix multiplies its
CRC by x^(8k) over GF(2), so multiplying the CRC before the stretch and
adding the one after it cancels the prefix. No n-gram is ever built as a
string. A feature's bucket is its CRC modulo the number of buckets; gains per
bucket compare target and raw counts, a document weighs the mean gain of its
features, and Gumbel noise from its id turns top weights into a sample without
replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import read_table, sql_crc32
from pairloom.operators.rank import rank_by_key
from pairloom.workspace import materialize

MAX_WORDS = 1  # longest run of words that is a feature
BUCKETS = 10_000
MIN_WORDS = 20
SHARE_PERCENT = 10
SEED = 2024
POLYNOMIAL = 0xEDB88320  # CRC-32, bits reversed


def _reader(max_words: int, buckets: int):
    """A function from a text to the buckets of its features, as an array, and its number of words."""
    import zlib
    from itertools import accumulate

    import numpy as np

    # A-Z lower-cased; what cannot stand in a word becomes a blank. Bytes from 128 on belong to letters beyond ASCII.
    word_byte = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

    def times_x(value: int) -> int:
        return (value >> 1) ^ (POLYNOMIAL if value & 1 else 0)

    def tables(images: list[int]):
        """A linear map of 32 bits, given by the images of the single bits, as four tables by byte."""
        out = np.zeros((4, 256), np.uint32)
        for place in range(4):
            for bit in range(8):
                half = 1 << bit
                out[place, half : 2 * half] = out[place, :half] ^ np.uint32(images[8 * place + bit])
        return out

    def apply(table, values):
        return (
            table[0][values & 255] ^ table[1][(values >> 8) & 255] ^ table[2][(values >> 16) & 255] ^ table[3][values >> 24]
        )

    images = []
    for bit in range(32):
        value = 1 << bit
        for _ in range(8):
            value = times_x(value)
        images.append(value)
    powers = [tables(images)]  # multiplication by x^8, x^16, x^32, ...: by 1, 2, 4, ... bytes

    def shifted(crcs, lengths):
        """The CRCs multiplied by x^8 as often as the lengths say."""
        longest, k = int(lengths.max(initial=0)), 0
        while longest >> k:
            if k == len(powers):
                squares = apply(powers[-1], apply(powers[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)))
                powers.append(tables([int(v) for v in squares]))
            hit = (lengths >> k) & 1 == 1
            crcs = np.where(hit, apply(powers[k], crcs), crcs)
            k += 1
        return crcs

    def scan(text: str | None):
        words = (text or "").encode("utf-8", "surrogatepass").translate(word_byte).split()
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), 0
        parts = [b" "] * (2 * n - 1)
        parts[::2] = words
        running = np.fromiter(accumulate(parts, lambda crc, part: zlib.crc32(part, crc), initial=0), np.uint32, 2 * n)
        before, after = running[::2], running[1::2]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        found = []
        for k in range(1, min(max_words, n) + 1):
            crcs = after[k - 1 :] ^ shifted(before[: n - k + 1], ends[k - 1 :] - starts[: n - k + 1])
            found.append(crcs.astype(np.int64) % buckets)
        return np.concatenate(found), n

    return scan


def bucket_counts(texts: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts by bucket, those that occur. Each task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        scan = _reader(max_words, buckets)
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(scan(text.as_py())[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the counts (bucket, n) of both sides: log ratio of the shares, smoothed by one, in floored thousandths."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(
        target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t"))
    )
    every = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))
    sums = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    share = lambda n, total: (F.col(n) + 1).cast("double") * float(total + buckets)
    ratio = share("t", totals["S"]) / share("s", totals["T"])
    return sums.select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def weights(text: Column, gains: list[int], max_words: int = MAX_WORDS) -> Column:
    """struct(n_words, n_features, weight) of a text: weight is the floored mean of its features' gains, 0 without any."""

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def weigh(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        scan, gain = _reader(max_words, len(gains)), np.array(gains, np.int64)
        for array in arrays:
            rows = []
            for value in array:
                found, n_words = scan(value.as_py())
                rows.append((n_words, len(found), int(gain[found].sum()) // len(found) if len(found) else 0))
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.StructArray.from_arrays(columns, ["n_words", "n_features", "weight"])

    return weigh(text)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a key, in floored thousandths: the same for the same key and seed."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    uniform = (head.cast("bigint") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("bigint")


def resample(
    raw: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    max_words: int = MAX_WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, share_percent: int = SHARE_PERCENT, seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank): one row per row of ``raw``, the drawn ones ranked from 1.

    Drawn are the highest scores among the rows of at least ``min_words``
    words, ``share_percent`` of these, rounded down; ties go to the smaller id.
    Rank is null for all others. Null texts have no words; a null id is hashed
    as an empty one and comes before others; repeated rows are rows of their
    own, with neighbouring ranks. Empty tables: no rows, or gains against
    nothing. Counting and weighing read the texts once each; only bucket sums
    and (id, score) are shuffled, and the driver sees a gain per bucket.
    """
    gains = bucket_gains(
        materialize(bucket_counts(raw, text_col, max_words, buckets), "raw-buckets"),
        materialize(bucket_counts(target, target_col, max_words, buckets), "target-buckets"), buckets,
    )
    # One number for each of the ``buckets`` buckets, whatever the data.
    by_bucket = [row["gain"] for row in gains.orderBy("bucket").collect()]
    weighed = raw.select(F.col(f"`{id_col}`").alias("id"), weights(F.col(f"`{text_col}`").cast("string"), by_bucket, max_words).alias("w"))
    scored = weighed.select("id", "w.n_words", "w.n_features", "w.weight", (F.col("w.weight") + noise(F.col("id"), seed)).alias("score"))
    scored = materialize(scored, "importance")
    able = scored.where(F.col("n_words") >= min_words).withColumn("low", -F.col("score"))
    ranked = rank_by_key(able, ("low", "id"))
    drawn = F.col("rank") < F.floor(share_percent * F.col("n_total") / 100)
    ranked = ranked.withColumn("rank", F.when(drawn, F.col("rank") + 1)).drop("low", "n_total")
    short = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(short).select("id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))


def op13_importance_sample(spark, sf_dir):
    """Documents that resemble the benchmark, drawn by the weights of their words."""
    drawn = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id")


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

# Single words only: MAX_WORDS is 1.
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS words FROM documents),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY doc_id, word),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest({_SQL_WORDS}) AS word FROM benchmark) GROUP BY word),
k AS (SELECT word, {sql_crc32("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM dw) + {BUCKETS} AS DOUBLE)
               / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM bw) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
      FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, CAST('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d),
v AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
      FROM h LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM v WHERE n_features >= {MIN_WORDS})
SELECT v.*, CASE WHEN place <= able * {SHARE_PERCENT} // 100 THEN place END AS rank FROM v LEFT JOIN r USING (doc_id)
"""
