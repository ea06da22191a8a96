"""Mixing sources to target weights: exact quotas, split over output shards by a hypergeometric tree.

The documents of a source are dealt into blocks, and each pass over a source
takes its blocks in an order of its own. A source's quota of words so becomes
an exact number of block tickets, the last of which may be cut. The tree hands
the tickets to the output shards: each node puts what it holds in a random
order and sends the first half left, so its left half has a multivariate
hypergeometric share of every quota, and halves again. A source's blocks, in
the order of their passes, take its tickets one by one, so shards hold
disjoint blocks, and a shard shuffles what it got. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.tables import fresh, read_table, without
from pairloom.workspace import materialize

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
MAX_REPEATS = 3
BLOCK_DOCS = 256
SHARD_BITS = 4
HEAD_DIGITS = 3  # hex digits of a hash that tickets are counted by before any is numbered
HEADS = 16**HEAD_DIGITS
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"
# Sources whose statistics are broadcast, at about 100 bytes each; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _key(seed: int, *parts) -> Column:
    """32 hex digits that depend on the seed and the parts alone."""
    columns = [F.coalesce((F.lit(p) if not isinstance(p, Column) else p).cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds source_no (from 1, code point order, null last), cap and target to (source, source_size).

    The targets share the sum of all sizes by weight; a target stops at
    ``max_repeats`` times its source's size, and what it leaves goes to the
    others by weight. That is one water level for all: sorted by cap over
    weight, it is the share of the first source that its cap doesn't stop. The
    table has a row per source. All sizes zero: all targets zero.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sizes = sizes.withColumn("source_no", F.row_number().over(by_name))
    turn = (F.col("source_no") - 1) % len(weights) + 1
    sizes = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    sizes = sizes.withColumn("cap", F.col("source_size") * max_repeats)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sizes = sizes.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(fill), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))),
    )
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), open_level * F.col("weight"))
    return sizes.withColumn("target", F.round(F.coalesce(target, F.col("cap").cast("double")), 6)).drop("level")


def _tree_key(level: int, seed: int) -> Column:
    """The place of a ticket in the random order of its node; nodes of a level follow those of the levels above."""
    return _key(seed, "tree", F.col("node") + (1 << level), F.col("source_no"), F.col("ticket"))


def _halves(tickets: DataFrame, level: int, seed: int) -> DataFrame:
    """(node, cut): the ticket of each node that is the first of its right half.

    A histogram of the keys' heads, ``HEADS`` counts a node, tells in which
    head a node's middle lies; only tickets of that head are numbered.
    """
    keyed = tickets.select("node", _tree_key(level, seed).alias("key"), "source_no", "ticket").withColumn("head", F.substring("key", 1, HEAD_DIGITS))
    counts = keyed.groupBy("node", "head").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("node").orderBy("head")
    counts = counts.withColumns(
        {"end": F.sum("n").over(upto), "half": F.floor(F.sum("n").over(Window.partitionBy("node")) / 2)}
    )
    middle = counts.where((F.col("end") > F.col("half")) & (F.col("end") - F.col("n") <= F.col("half")))
    middle = middle.select("node", "head", (F.col("half") - F.col("end") + F.col("n") + 1).alias("nth"))
    order = Window.partitionBy("node").orderBy("key", "source_no", "ticket")
    inside = keyed.join(F.broadcast(middle), ["node", "head"]).withColumn("number", F.row_number().over(order))
    return inside.where("number = nth").select("node", F.struct("key", "source_no", "ticket").alias("cut"))


def split_tickets(tickets: DataFrame, shard_bits: int = SHARD_BITS, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` to tickets (source_no, ticket, ...), dealt to 2^shard_bits shards without replacement.

    At each level a node's tickets are ordered by a seeded hash and the first
    half goes left: every choice of that many tickets is equally likely, so the
    counts by source are multivariate hypergeometric. The sizes of the shards
    differ by one at most on each level. Tickets are rows that never move: a
    level reads them, counts, and writes one cut for each node, and each ticket
    then finds its half by comparing. ``tickets`` is read twice a level.
    """
    split = tickets.withColumn("node", F.lit(0))
    for level in range(shard_bits):
        cuts = materialize(_halves(split, level, seed), "mix-cuts")  # at most 2^level rows
        own = F.struct(_tree_key(level, seed).alias("key"), "source_no", "ticket")
        right = F.when(own < F.col("cut"), 0).otherwise(1)
        split = split.join(F.broadcast(cuts), "node").withColumn("node", F.col("node") * 2 + right).drop("cut")
    return split.withColumnRenamed("node", "shard")


def split_quotas(quotas: DataFrame, shard_bits: int = SHARD_BITS, seed: int = SEED) -> DataFrame:
    """(source_no, shard, n): exact quotas (source_no, n) split over 2^shard_bits shards; see ``split_tickets``."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)
    tickets = quotas.where("n > 0").select("source_no", F.explode(numbers).alias("ticket"))
    return split_tickets(tickets, shard_bits, seed).groupBy("source_no", "shard").agg(F.count("*").alias("n"))


def _block_tickets(passes: DataFrame) -> DataFrame:
    """Adds ``before``, the words ahead in the order of the pass, and ``ticket``, the number in the source, to blocks of passes.

    Both are sums over heads of the order, ``HEADS`` a pass, and within a head,
    so that the blocks of a large source are summed in many tasks.
    """
    head, group = F.substring("order", 1, HEAD_DIGITS), ["source_no", "pass"]
    passes = passes.withColumn("head", head)
    heads = passes.groupBy(*group, "head").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    ahead = Window.partitionBy(*group).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *group, "head", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("words_ahead"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_ahead"),
        F.sum("n").over(Window.partitionBy(*group)).alias("n_of_pass"),
    )
    inside = Window.partitionBy(*group, "head").orderBy("order", "block")
    within = F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = passes.withColumns({"words_inside": within, "n_inside": F.row_number().over(inside) - 1})
    # All passes but the last take every block of their source.
    return numbered.join(heads, [*group, "head"]).withColumns(
        {
            "before": F.col("words_ahead") + F.col("words_inside"),
            "ticket": F.col("pass") * F.col("n_of_pass") + F.col("n_ahead") + F.col("n_inside"),
        }
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block_docs: int = BLOCK_DOCS,
    shard_bits: int = SHARD_BITS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    row_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents with their source's figures, and what the mix draws.

    documents: (row, id, source, size, source_size, target), one row per row of
    ``docs``; size counts words, null texts have none.
    draws: (row, id, source, size, pass, shard, place, taken): a document once
    for each pass that takes it; ``place`` orders a shard. A source's taken
    words are its target rounded: one document of a source may be taken in
    part, no document is taken more than ``max_repeats`` times. Documents
    without words are not drawn. Null sources are one source, the last; null
    ids are mixed like others. ``row`` numbers the rows of ``docs``, or is
    their ``row_col``, a unique bigint. The same rows give the same mix in any layout;
    rows with one id and size may change places.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = materialize(
        docs.select(
            (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"), F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"), size.alias("size"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = source_targets(sizes, weights, max_repeats)
    quota = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("int")
    sources = materialize(
        sources.withColumns({"n_blocks": F.ceil(F.col("n_docs") / block_docs), "whole": whole}).withColumn(
            "rest", quota - F.col("whole") * F.col("source_size")
        ),
        "mix-sources",
    )
    few = sources.count() <= BROADCAST_SOURCES
    figures = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "n_blocks")
    placed = rows.join(F.broadcast(figures) if few else figures, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = F.conv(F.substring(_key(seed, "block", F.col("id")), 1, 8), 16, 10).cast("bigint")
    placed = placed.withColumn("block", dealt % F.col("n_blocks"))

    blocks = placed.where("size > 0").groupBy("source_no", "block").agg(F.sum("size").alias("words"))
    plan = sources.select("source_no", "source_size", "whole", "rest")
    passes = blocks.join(F.broadcast(plan) if few else plan, "source_no").withColumn(
        "pass", F.explode(F.sequence(F.lit(0), F.col("whole")))
    )
    limit = F.when(F.col("pass") < F.col("whole"), F.col("source_size")).otherwise(F.col("rest"))
    passes = passes.withColumns(
        {"limit": limit, "order": _key(seed, "order", F.col("pass"), F.col("source_no"), F.col("block"))}
    )
    passes = materialize(passes.select("source_no", "block", "pass", "words", "limit", "order"), "mix-passes")
    tickets = _block_tickets(passes).withColumn("room", F.col("limit") - F.col("before")).where("room > 0")
    tickets = materialize(tickets.select("source_no", "ticket", "block", "pass", "words", "room"), "mix-tickets")
    tickets = split_tickets(tickets, shard_bits, seed)

    drawn = placed.where("size > 0").join(tickets, ["source_no", "block"])
    cut = F.col("words") > F.col("room")
    full = drawn.where(~cut).withColumn("taken", F.col("size"))
    in_block = Window.partitionBy("source_no", "pass", "block").orderBy(_key(seed, "doc", F.col("id")), "id", "size")
    ahead = F.coalesce(F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = drawn.where(cut).withColumn("taken", F.least("size", F.col("room") - ahead)).where("taken > 0")
    draws = full.unionByName(part).withColumn("place", _key(seed, "place", F.col("shard"), F.col("pass"), F.col("id")))
    columns = ["row", "id", "source", "size", "pass", "shard", "place", "taken"]
    return placed.select("row", "id", "source", "size", "source_size", "target"), draws.select(*columns)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """(id, source, size, source_size, target, taken, draws): one row per row of ``docs``.

    ``draws`` holds (pass, shard, place, taken) for each time the row is taken,
    and is empty for rows never taken; ``taken`` adds them up.
    """
    documents, draws = mix(docs, **settings)
    drawn = _by_row(draws)
    return documents.join(drawn, "row", "left").select(
        "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"),
        F.coalesce("draws", F.array().cast(drawn.schema["draws"].dataType)).alias("draws"),
    )


def _by_row(draws: DataFrame) -> DataFrame:
    """(row, taken, draws): what the mix takes of each row it draws."""
    each = F.array_sort(F.collect_list(F.struct("pass", "shard", "place", "taken")))
    return draws.groupBy("row").agg(F.sum("taken").alias("taken"), each.alias("draws"))


def drawn_corpus(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the mix draws, whole, with what it takes of them.

    Added are size, source_size, target, taken and ``draws``, one (pass, shard,
    place, taken) for each time the row is taken, in place of columns of these
    names: exploded, they are the rows of the shards, in the order of ``place``.
    """
    names = ("size", "source_size", "target", "taken", "draws")
    kept, row = without(docs, names), fresh(docs, "mix_row")
    kept = materialize(kept.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    documents, draws = mix(kept, row_col=row, **settings)
    figures = documents.join(_by_row(draws), "row").select(F.col("row").alias(row), *names)
    return kept.join(figures, row).drop(row)


def op8_source_mix(spark, sf_dir):
    """Sizes, targets and taken words of all documents; ``draws`` lists pass:shard:place of each time one is taken."""
    mixed = mixed_documents(read_table(spark, sf_dir, "documents"))
    drawn = F.transform("draws", lambda d: F.concat_ws(":", d["pass"].cast("string"), d["shard"].cast("string"), d["place"]))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.array_join(drawn, ",").alias("draws")
    )


def _sql_key(*parts: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(parts)}))"


def _sql_tree() -> str:
    """Tables h1, h2, ...: the tickets with their node on each level, the first half of a node in the order of its keys being the left."""
    levels = []
    for level in range(SHARD_BITS):
        key = _sql_key("'tree'", f"CAST(node + {1 << level} AS VARCHAR)", "CAST(no AS VARCHAR)", "CAST(ticket AS VARCHAR)")
        place = f"row_number() OVER (PARTITION BY node ORDER BY {key}, no, ticket) - 1"
        right = f"CASE WHEN {place} < count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END"
        levels.append(f"h{level + 1} AS (SELECT * EXCLUDE (node), 2 * node + {right} AS node FROM h{level}),")
    return "\n".join(levels)


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
             row_number() OVER (ORDER BY source ASC NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (no - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS DOUBLE) AS weight,
             source_size * {MAX_REPEATS} AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER fill, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0)) AS level
      FROM w WINDOW fill AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, round(least(CAST(cap AS DOUBLE), weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()), 6) AS target
      FROM f),
q AS (SELECT *, CAST(ceil(n_docs / {float(BLOCK_DOCS)}) AS BIGINT) AS n_blocks,
             CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole,
             CAST(round(target) AS BIGINT) AS quota FROM t),
p AS (SELECT d.doc_id, d.size, q.no, q.source_size, q.target,
             CAST('0x' || substr({_sql_key("'block'", "coalesce(CAST(doc_id AS VARCHAR), 'null')")}, 1, 8) AS BIGINT) % q.n_blocks AS block
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT no, block, CAST(sum(size) AS BIGINT) AS words FROM p WHERE size > 0 GROUP BY no, block),
x AS (SELECT b.*, n AS pass,
             CASE WHEN n < q.whole THEN q.source_size ELSE q.quota - q.whole * q.source_size END AS lim,
             {_sql_key("'order'", "CAST(n AS VARCHAR)", "CAST(b.no AS VARCHAR)", "CAST(b.block AS VARCHAR)")} AS ord
      FROM b JOIN q ON q.no = b.no CROSS JOIN (SELECT unnest(range(0, {MAX_REPEATS} + 1)) AS n) r WHERE r.n <= q.whole),
r AS (SELECT *, lim - coalesce(sum(words) OVER (PARTITION BY no, pass ORDER BY ord, block
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM x),
h0 AS (SELECT *, 0 AS node, row_number() OVER (PARTITION BY no ORDER BY pass, ord, block) - 1 AS ticket FROM r WHERE room > 0),
{_sql_tree()}
g AS (SELECT p.doc_id, p.size, h.words, h.room, h.pass, h.node AS shard,
             coalesce(sum(p.size) OVER (PARTITION BY h.no, h.pass, h.block
               ORDER BY {_sql_key("'doc'", "coalesce(CAST(doc_id AS VARCHAR), 'null')")}, doc_id, p.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM p JOIN h{SHARD_BITS} h ON h.no = p.no AND h.block = p.block WHERE p.size > 0),
e AS (SELECT doc_id, pass, shard, CASE WHEN words <= room THEN size ELSE greatest(0, least(size, room - ahead)) END AS taken,
             {_sql_key("'place'", "CAST(shard AS VARCHAR)", "CAST(pass AS VARCHAR)", "coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS place
      FROM g),
k AS (SELECT doc_id, sum(taken) AS taken,
             string_agg(concat_ws(':', CAST(pass AS VARCHAR), CAST(shard AS VARCHAR), place), ',' ORDER BY pass) AS draws
      FROM e WHERE taken > 0 GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken, coalesce(k.draws, '') AS draws
FROM p LEFT JOIN k USING (doc_id)
"""
