"""Benchmark decontamination: documents or passages that repeat benchmark text, by word windows.

The normalised windows of the benchmark items form a hash set. The windows of
all document words are hashed by pairwise doubling (1, 2, 4, 8 words, then any
length as a sum of these) and probe the set where they are made; a hit counts
once its words equal those of the item. Only built-in functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.tables import fresh, read_table
from pairloom.workspace import materialize

WINDOW_WORDS = 10
# Benchmark windows that are broadcast, at about 150 bytes each; a larger set meets the hashes of the texts by a shuffle.
BROADCAST_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; a null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _paired(left: str, right: str, distance: int) -> Column:
    """Hashes of stretches that begin where ``left`` does and go on with ``right`` so many words later."""
    later = F.slice(right, distance + 1, F.size(right))
    return F.zip_with(left, later, lambda a, b: F.xxhash64(a, b))


def _with_window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``_w<L>`` for each length: the hash of the L words from each word on (past the end: of no use)."""
    df = df.withColumn("_w1", F.transform("words", lambda w: F.xxhash64(w)))
    done = {1}
    top = max(lengths, default=1)
    size = 1
    while 2 * size <= top:
        df = df.withColumn(f"_w{2 * size}", _paired(f"_w{size}", f"_w{size}", size))
        size *= 2
        done.add(size)
    for length in lengths:
        powers = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
        reach = powers[0]
        for power in powers[1:]:
            if reach + power not in done:
                df = df.withColumn(f"_w{reach + power}", _paired(f"_w{reach}", f"_w{power}", reach))
                done.add(reach + power)
            reach += power
    return df


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, len, hash, window): the windows of n words of each item; one shorter window for a shorter item.

    Items without words have no window. The table is written once.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(n)))
    lengths = sorted(row["len"] for row in items.select("len").distinct().collect())  # n different at most
    hashed = _with_window_hashes(items, lengths)
    parts = [
        hashed.where(F.col("len") == length)
        .select("item", "len", "words", F.posexplode(f"_w{length}").alias("pos", "hash"))
        .where(F.col("pos") <= F.size("words") - length)
        .select("item", "len", "hash", F.array_join(F.slice("words", F.col("pos") + 1, length), " ").alias("window"))
        for length in lengths
    ]
    empty = items.select("item", "len", F.lit(0).cast("bigint").alias("hash"), F.lit("").alias("window")).limit(0)
    return materialize(reduce(DataFrame.unionByName, parts, empty), "benchmark-windows")


def _places(hashed: DataFrame, lengths: list[int], last: Column) -> tuple[DataFrame, Column, Column]:
    """The window hashes of all lengths and ``last`` as rows (pos, hash); start and length follow from pos."""
    rows = hashed.select("*", F.posexplode(F.concat(*[F.col(f"_w{length}") for length in lengths], last)).alias("pos", "hash"))
    span = F.greatest("n_words", F.lit(1))
    length = F.try_element_at(F.array(*map(F.lit, lengths), F.lit(0)), F.floor(F.col("pos") / span).cast("int") + 1)
    return rows, F.col("pos") % span, length


def _same(start: Column, length: Column, window: Column) -> Column:
    return F.array_join(F.slice("words", start + 1, length), " ") == window


def _probed(scanned: DataFrame, needles: DataFrame, lengths: list[int]) -> DataFrame:
    """The occurrences of a broadcast set of windows, verified where they are found; and a row of length 0 for each document."""
    nothing = needles.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("hash"), F.lit(0).alias("len"), F.lit("").alias("window")
    )
    # Every document also brings one empty window, so that those without hits stay.
    rows, start, of_length = _places(_with_window_hashes(scanned, lengths), lengths, F.array(F.lit(0).cast("bigint")))
    is_last = F.col("pos") == F.col("n_words") * len(lengths)
    real = ~is_last & (of_length == F.col("len")) & (start + F.col("len") <= F.col("n_words"))
    probes = rows.select("row", "id", "text_key", "n_words", "words", "pos", "hash")
    return probes.join(F.broadcast(needles.unionByName(nothing)), "hash").where(
        F.when(F.col("len") == 0, is_last).otherwise(real & _same(start, F.col("len"), F.col("window")))
    ).withColumn("start", start)


def _shuffled(scanned: DataFrame, needles: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a set of windows too large to broadcast.

    Each place sends its hash and numbers, never words. Where a hash meets, the
    place is a candidate of its text; the candidates of a text come back to its
    rows and each row verifies them by its own words. Rows without any stay by
    the outer join.
    """
    texts = scanned.select("text_key", "words", "n_words")
    rows, start, of_length = _places(_with_window_hashes(texts, lengths), lengths, F.array().cast("array<bigint>"))
    places = rows.select("text_key", start.alias("start"), of_length.alias("len"), "n_words", "hash")
    places = places.where(F.col("start") + F.col("len") <= F.col("n_words")).drop("n_words")
    met = places.join(needles, ["hash", "len"]).groupBy("text_key").agg(F.collect_set(F.struct("start", "len", "window")).alias("met"))
    met = materialize(met, "candidate-windows")
    both = scanned.join(met, "text_key", "left")
    real = F.filter(F.coalesce("met", F.array().cast(met.schema["met"].dataType)), lambda m: _same(m["start"], m["len"], m["window"]))
    itself = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("window")))
    return both.select("row", "id", "text_key", "n_words", F.inline(F.concat(itself, real)))


def find_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document: (id, text_key, n_words, n_hit, spans, items).

    ``spans`` are the merged stretches [start, end) of hit words in order,
    ``items`` the ids, as sorted strings, of items with a window that occurs;
    items with a null id hit but are not named. Repeated rows and ids stay
    apart. Null and blank texts have no words. ``text_key`` is a hash of the
    text, which with the id leads back to the row.
    """
    by_item = benchmark_windows(benchmark, n)
    needles = by_item.select("hash", "len", "window").distinct()
    sizes = {row["len"]: row["count"] for row in needles.groupBy("len").count().collect()}  # n rows at most
    lengths, small = sorted(sizes), sum(sizes.values()) <= broadcast_windows
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_key"),
        words(F.col(text_col)).alias("words"),
    ).withColumn("n_words", F.size("words"))
    found = (_probed if small else _shuffled)(scanned, needles, lengths)
    found = materialize(found.select("row", "id", "text_key", "n_words", "start", "len", "window"), "hits")

    hits = found.where("len > 0")
    in_order = Window.partitionBy("row").orderBy("start", "len")
    reached = F.max(F.col("start") + F.col("len")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reached, 0).otherwise(1)
    spans = (
        hits.select("row", "start", "len", opens.alias("opens"))
        .withColumn("nth", F.sum("opens").over(in_order))
        .groupBy("row", "nth")
        .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"))
        .groupBy("row")
        .agg(
            F.sum(F.col("end") - F.col("start")).alias("n_hit"),
            F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        )
    )
    names = by_item.where("item IS NOT NULL").select("item", "window").distinct()
    items = (
        hits.select("row", "window").distinct()
        .join(F.broadcast(names) if small and names.count() <= broadcast_windows else names, "window")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        found.where("len = 0").select("row", "id", "text_key", F.col("n_words").cast("bigint").alias("n_words"))
        .join(spans, "row", "left")
        .join(items, "row", "left")
        .select(
            "id", "text_key", "n_words",
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def _without_spans(text: Column, spans: Column) -> Column:
    """The text less its hit words and what stands between them."""
    gaps = F.split(text, CASED_WORD, -1)
    kept = F.regexp_extract_all(text, F.lit(CASED_WORD), F.lit(0))

    def inside(i):
        return F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"]))

    def piece(gap, i):
        between = F.exists(spans, lambda s: (s["start"] < i) & (i < s["end"]))
        word = F.when(inside(i), F.lit("")).otherwise(F.coalesce(F.get(kept, i), F.lit("")))
        return F.concat(F.when(between, F.lit("")).otherwise(gap), word)

    return F.array_join(F.transform(gaps, piece), "")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW_WORDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` without hit documents (``remove="documents"``) or without hit passages (``remove="spans"``).

    Other columns stay as they are. A document without hits is never touched,
    also if its id is null or repeated.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    hit = find_hits(docs, benchmark, n, id_col, text_col).where("n_hit > 0")
    hit_id, key, spans = (fresh(docs, name) for name in ("hit_id", "hit_key", "hit_spans"))
    hit = hit.groupBy(F.col("id").alias(hit_id), F.col("text_key").alias(key)).agg(F.first("spans").alias(spans))
    hit = materialize(hit, "leaks")  # its size tells Spark how to join
    same = docs[id_col].eqNullSafe(F.col(hit_id)) & (F.xxhash64(docs[text_col]) == F.col(key))
    if remove == "documents":
        return docs.join(hit.drop(spans), same, "left_anti")
    columns = [
        F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_without_spans(F.col(text_col), F.col(spans))).alias(c)
        if c == text_col else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return docs.join(hit, same, "left").select(*columns)


def op7_benchmark_leaks(spark, sf_dir):
    hits = find_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP7_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {WINDOW_WORDS}) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, x.item FROM places p JOIN windows x ON x.n = p.n AND x.win = p.win),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
