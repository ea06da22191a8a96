"""Corpus BLEU."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import chunks_13a

ORDERS = (1, 2, 3, 4)
_PARTS = [f"{part}{n}" for part in "mtr" for n in ORDERS]


# What a task counts in one go, and the chunks it remembers.
_TOKENS_AT_ONCE = 1 << 18
_KNOWN_CHUNKS = 1 << 16


def gram_counts(translation: Column, reference: Column) -> Column:
    """Per row a struct of m1..m4, t1..t4, r1..r4: clipped matches, and grams of translation and reference.

    A sample is one row, so nothing is moved and no key is needed. A null text
    has no grams. Tokens are numbers, and the grams of many rows are counted at
    once: an (n-1)-gram of a row has a number, with the token after it that
    makes an n-gram, and a sort numbers these again. Nothing is hashed.
    """
    (chunks, tokens), orders, names = chunks_13a(), ORDERS, _PARTS
    at_once, known = _TOKENS_AT_ONCE, _KNOWN_CHUNKS

    def count(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from array import array

        import numpy as np

        numbers: dict[str, int] = {}
        of_chunk: dict[str, array] = {}

        def add(text: str | None, to: array) -> int:
            start = len(to)
            for chunk in chunks(text or ""):
                found = of_chunk.get(chunk)
                if found is None:
                    found = of_chunk[chunk] = array("q", [numbers.setdefault(t, len(numbers)) for t in tokens(chunk)])
                to.extend(found)
            return len(to) - start

        def counted(hyp: array, ref: array, hyp_lengths: array, ref_lengths: array) -> list:
            """The columns of ``names`` for the rows of these texts."""
            rows = len(hyp_lengths)
            token = np.concatenate([np.array(hyp, np.int64), np.array(ref, np.int64)])
            lengths = np.concatenate([np.array(hyp_lengths, np.int64), np.array(ref_lengths, np.int64)])
            end = np.repeat(np.cumsum(lengths), lengths)
            row = np.repeat(np.arange(2 * rows) % rows, lengths)
            at, gram, matches = np.arange(len(token)), row, []
            for n in orders:
                inside = at + n <= end[at]
                at = at[inside]
                distinct, gram = np.unique(gram[inside] * len(numbers) + token[at + n - 1], return_inverse=True)
                of_hyp = np.searchsorted(at, len(hyp))
                both = [np.bincount(side, minlength=len(distinct)) for side in (gram[:of_hyp], gram[of_hyp:])]
                row_of = np.empty(len(distinct), np.int64)
                row_of[gram] = row[at]
                matches.append(np.bincount(row_of, np.minimum(*both), minlength=rows).astype(np.int64))
            totals = [np.maximum(side - n + 1, 0) for side in (lengths[:rows], lengths[rows:]) for n in orders]
            return [*matches, *totals]

        for translations, references in pairs:
            if len(of_chunk) > known:
                numbers.clear()
                of_chunk.clear()
            parts, texts = [], [array("q") for _ in range(4)]
            for pair in zip(translations.to_pylist(), references.to_pylist()):
                for text, to, lengths in zip(pair, texts, texts[2:]):
                    lengths.append(add(text, to))
                if len(texts[0]) + len(texts[1]) > at_once:
                    parts.append(counted(*texts))
                    texts = [array("q") for _ in range(4)]
            parts.append(counted(*texts))
            columns = [pa.array(np.concatenate(column), pa.int64()) for column in zip(*parts)]
            yield pa.StructArray.from_arrays(columns, names)

    kind = ", ".join(f"{name} bigint" for name in _PARTS)
    return F.arrow_udf(count, f"struct<{kind.replace(' bigint', ':bigint')}>")(translation, reference)


def _summed(df: DataFrame) -> DataFrame:
    """One row: m1..m4, t1..t4, r1..r4 of all rows, zeros for no rows."""
    counted = df.select(gram_counts(F.col("translation"), F.col("reference")).alias("c"))
    return counted.agg(*[F.coalesce(F.sum(f"c.{name}"), F.lit(0)).alias(name) for name in _PARTS])


def ngram_totals(df: DataFrame) -> DataFrame:
    """Four rows, one per order: clipped matches, and grams in all translations and references."""
    rows = [
        F.struct(
            F.lit(n).alias("n"), F.col(f"m{n}").alias("matches"), F.col(f"t{n}").alias("hyp_total"), F.col(f"r{n}").alias("ref_total")
        )
        for n in ORDERS
    ]
    return _summed(df).select(F.inline(F.array(*rows)))


def corpus_bleu(df: DataFrame) -> DataFrame:
    """One row: the BLEU score of ``translation`` against ``reference`` and its parts.

    Order 4, one reference, case kept, exponential smoothing: the k-th order
    without a match counts as 1/2^k matches.
    """
    wide = _summed(df).withColumnRenamed("r1", "ref_length")
    precisions, misses = [], F.lit(0)
    for n in ORDERS:
        match, total = F.col(f"m{n}"), F.col(f"t{n}")
        misses = misses + F.when((match == 0) & (total > 0), 1).otherwise(0)
        smoothed = F.when(match > 0, match.cast("double")).otherwise(1 / F.pow(F.lit(2.0), misses))
        precisions.append(F.try_divide(100 * smoothed, total))
    wide = wide.select("*", *[p.alias(f"p{n}") for n, p in zip(ORDERS, precisions)])
    log_mean = sum(F.log(f"p{n}") for n in ORDERS) / len(ORDERS)
    brevity = F.exp(F.least(F.lit(0.0), 1 - F.try_divide(F.col("ref_length"), F.col("t1"))))
    scored = sum(F.col(f"m{n}") for n in ORDERS) > 0
    return wide.select(
        F.coalesce(F.when(scored, brevity * F.exp(log_mean)), F.lit(0.0)).alias("bleu"),
        F.coalesce(brevity, F.lit(0.0)).alias("brevity_penalty"),
        F.col("t1").alias("hyp_length"),
        "ref_length",
    )
