"""Language identification by prediction by partial matching over bytes.

For each language a context tree of up to ``ORDER`` bytes is counted over a
bounded sample of labelled documents and then frozen. A byte costs the code
length it has in the longest known context; where it is new there, an escape
(method C: as likely as the different bytes seen in that context) is paid and
the next shorter context asked, down to all bytes being equally likely. The
language with the shortest code for the whole text wins.

The cost of a byte depends on the bytes before it alone, so the trees are laid
out as tables from byte grams to the costs in several languages at once. Every
label is learned: languages are taken ``GROUP`` at a time, in order of their
names, so a table is as wide as its group and holds the grams of its group only,
and memory grows with the languages and not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.tables import fresh, read_table

ORDER = 4
SAMPLE_DOCS = 400  # labelled documents per language that the trees are counted over
SAMPLE_BYTES = 8 << 20  # of those, the bytes per language; the document that goes beyond is the last
GROUP = 8  # languages in a table; a gram takes four bytes for each of them
EVIDENCE_BYTES = 32.0
UNKNOWN = "und"
PAD = b"\n"
CHUNK = 1 << 18  # bytes scored at a time for one language; fewer for many


def _grams(text: bytes, order: int) -> np.ndarray:
    """The byte grams of ``order`` + 1 bytes that end at each byte of a padded text."""
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    n = len(data) - ORDER
    grams = np.zeros(n, np.int64)
    for back in range(order, -1, -1):
        grams = grams << 8 | data[ORDER - back : ORDER - back + n]
    return grams


def _bytes(text: str | None) -> bytes:
    return PAD * ORDER + (text or "").encode("utf-8", "surrogatepass").lower()


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, ctx_order, gram, n) over (lang, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for order in range(ORDER + 1):
                    grams = np.concatenate([_grams(_bytes(t), order) for t in texts])
                    found, n = np.unique(grams, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "ctx_order": order, "gram": found, "n": n})

    counted = sample.mapInPandas(count, "lang string, ctx_order int, gram bigint, n bigint")
    return counted.groupBy("lang", "ctx_order", "gram").agg(F.sum("n").alias("n"))


def _hashed(keys: np.ndarray) -> np.ndarray:
    """Places of unique keys in an open table of at least four times their number; -1 where none is."""
    bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
    table = np.full(1 << bits, -1, np.int32)
    waiting, at = np.arange(len(keys)), _slots(keys, bits)
    while len(waiting):
        free = table[at] < 0
        table[at[free]] = waiting[free]  # of several for one place the last stays
        lost = table[at] != waiting
        waiting, at = waiting[lost], (at[lost] + 1) & ((1 << bits) - 1)
    return table


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _find(index: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """The number of each wanted key, -1 for those not there."""
    keys, table = index
    if not len(keys):
        return np.full(len(wanted), -1, np.int32)
    bits = len(table).bit_length() - 1
    at = _slots(wanted, bits)
    found = table[at]
    open_ = np.flatnonzero((found >= 0) & (keys[found] != wanted))
    while len(open_):
        at[open_] = (at[open_] + 1) & ((1 << bits) - 1)
        found[open_] = table[at[open_]]
        now = found[open_]
        open_ = open_[(now >= 0) & (keys[now] != wanted[open_])]
    return found


def build_trees(langs: list[str], lang_no: np.ndarray, order: np.ndarray, gram: np.ndarray, n: np.ndarray) -> dict:
    """The frozen trees: all languages, and a table for each ``GROUP`` of them."""
    groups = []
    for first in range(0, len(langs), GROUP):
        here = (lang_no >= first) & (lang_no < first + GROUP)
        groups.append(_build_group(langs[first : first + GROUP], lang_no[here] - first, order[here], gram[here], n[here]))
    return {"langs": langs, "groups": groups}


def _build_group(langs: list[str], lang_no: np.ndarray, order: np.ndarray, gram: np.ndarray, n: np.ndarray) -> dict:
    """Plain arrays: for each order the costs of known grams and of leaving known contexts."""
    width = len(langs)
    trees: dict = {"langs": langs, "costs": [], "escapes": []}
    for o in range(ORDER + 1):
        here = order == o
        l, g, c = lang_no[here], gram[here], n[here].astype(np.float64)
        contexts, ctx_at = np.unique(g >> 8, return_inverse=True)
        total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(total, (ctx_at, l), c)
        np.add.at(kinds, (ctx_at, l), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
        if o == 0:
            known = np.arange(256)
            costs = 8.0 + np.broadcast_to(escape[0] if len(escape) else np.zeros(width), (256, width))
        else:
            known = np.unique(g)
            lower_keys, lower = trees["costs"][-1][0][0], trees["costs"][-1][1]
            below = lower[np.searchsorted(lower_keys, known & ((1 << 8 * o) - 1))].astype(np.float64)
            costs = below + escape[np.searchsorted(contexts, known >> 8)]
        costs = costs.copy()
        spread = total[ctx_at, l] + kinds[ctx_at, l]
        costs[np.searchsorted(known, g), l] = np.log2(spread / c)
        trees["costs"].append(((known, _hashed(known)), costs.astype(np.float32)))
        trees["escapes"].append(((contexts, _hashed(contexts)), escape.astype(np.float32)))
    return trees


def learn_trees(
    spark: SparkSession, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES
) -> dict:
    """Trees of (id, text, lang) rows: of each language up to ``sample_docs``, in the order of a hash of the id.

    Whatever number of labels there is, all are learned. The driver holds a row
    for each label and the counted grams, at most five for each sampled byte.
    """
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return build_trees([], *[np.zeros(0, np.int64)] * 4)
    langs = sorted(row["lang"] for row in counts)
    # A little more than asked for is let through by hash, so that no window sees a whole language.
    shares = spark.createDataFrame(
        [(row["lang"], min(1.0, 2.0 * sample_docs / row["count"] + 1e-9)) for row in counts], "lang string, share double"
    )
    key = F.md5(F.col("id").cast("string"))
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    some = labelled.join(F.broadcast(shares), "lang").where(head < F.col("share")).withColumn("key", key)
    first = Window.partitionBy("lang").orderBy("key", "id")
    some = some.withColumn("bytes", F.octet_length("text").cast("bigint"))
    sample = some.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_docs)
    ahead = F.coalesce(F.sum("bytes").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = sample.withColumn("ahead", ahead).where(F.col("ahead") < sample_bytes)
    table = gram_counts(sample.select("lang", "text")).toArrow()  # bounded by the sample
    number = {lang: i for i, lang in enumerate(langs)}
    named = table["lang"].combine_chunks().dictionary_encode()
    lang_no = np.array([number[v] for v in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]
    return build_trees(
        langs, lang_no, table["ctx_order"].to_numpy(), table["gram"].to_numpy(), table["n"].to_numpy()
    )


def _byte_costs(trees: dict, padded: bytes) -> np.ndarray:
    """The code length of each byte of a padded text in each language of a group."""
    grams = _grams(padded, ORDER)
    index, table = trees["costs"][ORDER]
    found = _find(index, grams)
    costs = table[found]
    rest = np.flatnonzero(found < 0)
    costs[rest] = 0
    for order in range(ORDER - 1, -1, -1):
        if not len(rest):
            break
        longer = grams[rest] & ((1 << 8 * (order + 2)) - 1)
        index, table = trees["escapes"][order + 1]
        at = _find(index, longer >> 8)
        known = at >= 0
        costs[rest[known]] += table[at[known]]
        index, table = trees["costs"][order]
        at = _find(index, longer & ((1 << 8 * (order + 1)) - 1))
        known = at >= 0
        costs[rest[known]] += table[at[known]]
        rest = rest[~known]
    return costs


def code_lengths(trees: dict, texts: list[str | None]) -> np.ndarray:
    """The bits that each whole text takes in each language."""
    if not trees["groups"]:
        return np.zeros((len(texts), 1))
    return np.concatenate([_group_lengths(group, texts) for group in trees["groups"]], axis=1)


def _group_lengths(trees: dict, texts: list[str | None]) -> np.ndarray:
    width = len(trees["langs"])
    step = max(4096, CHUNK // width)
    totals = np.zeros((len(texts), width))
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def score() -> None:
        joined = b"".join(held)
        costs = _byte_costs(trees, joined)
        # The grams that reach over a seam belong to the padding of the next text.
        at = 0
        for owner, piece in zip(owners, held):
            own = costs[at : at + len(piece) - ORDER]
            totals[owner] += own.sum(axis=0, dtype=np.float64)
            at += len(piece)
        held.clear(), owners.clear()

    for i, text in enumerate(texts):
        data = _bytes(text)
        for at in range(0, len(data) - ORDER, step):  # a long text in pieces that overlap by a context
            piece = data[at : at + step + ORDER]
            held.append(piece), owners.append(i)
            size += len(piece)
            if size >= step:
                score()
                size = 0
    if held:
        score()
    return totals


def predict(docs: DataFrame, trees: dict, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds lang_pred and score to ``docs``, in place of columns of these names.

    Null texts, texts without a letter and, with nothing learned, all texts get
    ``und`` and score 0. The score is the chance of the language chosen after
    ``EVIDENCE_BYTES`` typical bytes of the text, languages being equally
    likely before; of equal languages the first by name is chosen.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        frozen = shared.value
        names = np.array([*frozen["langs"], UNKNOWN], dtype=object)
        for texts in batches:
            if len(names) == 1:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
                continue
            bits = code_lengths(frozen, list(texts))
            lengths = np.array([max(1, len(_bytes(t)) - ORDER) for t in texts])
            per_byte = bits / lengths[:, None]
            gap = per_byte - per_byte.min(axis=1, keepdims=True)
            yield pd.DataFrame(
                {"lang_pred": names[per_byte.argmin(axis=1)], "score": 1 / np.exp2(-EVIDENCE_BYTES * gap).sum(axis=1)}
            )

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = fresh(docs, "told")
    told = docs.withColumn(out, run(F.col(text_col)))
    pred, score = F.col(f"{out}.lang_pred"), F.col(f"{out}.score")
    return told.withColumns(
        {
            lang_out: F.when(lettered, pred).otherwise(F.lit(UNKNOWN)),
            score_out: F.when(lettered & (pred != UNKNOWN), score).otherwise(F.lit(0.0)),
        }
    ).drop(out)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept out of learning; one without an id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn_from_documents(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return learn_trees(docs.sparkSession, labelled.select(F.col("doc_id").alias("id"), "text", "lang"), sample_docs)


def op10_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    judged = predict(docs.select("doc_id", "text"), learn_from_documents(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
