"""Merkle manifest of a dataset, with proofs by checkpoint and recompute.

Every row is a leaf. The leaves of a group form a tree of fixed arity, and the
roots of the groups form another, whose root stands for the dataset. Stored are
the leaves and then only every few levels, as the blocks of nodes below one
stored node. A proof needs the levels between as well: they are computed again
from the stored nodes of each block, give the siblings of its members, and are
dropped with it. A block has ``arity ** every`` members at most, so no task
holds a group, however large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import read_table, sql_crc32
from pairloom.operators.rank import rank_by_key
from pairloom.workspace import materialize

ARITY = 3
EVERY = 4  # levels from one stored one to the next: blocks of 81 nodes
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: each value as its UTF-8 length, a colon and itself, a null one as ``-``."""
    texts = [value.cast("string") for value in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _parents(nodes: Column, arity: int) -> Column:
    """The level above a run of nodes that begins at a multiple of the arity; the last parent may have fewer children."""
    heads = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(heads, lambda i: F.sha2(F.array_join(F.slice(nodes, i * arity + 1, F.lit(arity)), ""), 256))


def _height(n: Column, arity: int) -> Column:
    """Levels above ``n`` leaves until one node remains."""
    powers = [arity**k for k in range(1, 64) if arity**k < 1 << 62]
    below = F.filter(F.array(*[F.lit(p).cast("bigint") for p in powers]), lambda p: p < n)
    return F.when(n > 1, F.size(below) + 1).otherwise(0)


def _levels(blocks: DataFrame, layer: int, arity: int, every: int) -> DataFrame:
    """Adds ``go``, the levels of a block up to its top node, and ``level0`` to ``level<every>``, the nodes on each of them."""
    go = F.least(F.greatest(F.col("height") - layer * every, F.lit(0)), F.lit(every))
    blocks = blocks.withColumn("go", go).withColumn("level0", F.transform("members", lambda m: m["node"]))
    for k in range(1, every + 1):
        below = F.col(f"level{k - 1}")
        blocks = blocks.withColumn(f"level{k}", F.when(F.col("go") >= k, _parents(below, arity)).otherwise(below))
    return blocks


def _blocks(nodes: DataFrame, arity: int, every: int) -> DataFrame:
    """(tree, height, block, members): nodes (tree, height, pos, node, ...) put together by aligned stretches."""
    payload = [c for c in nodes.columns if c not in ("tree", "height", "pos")]
    members = F.array_sort(F.collect_list(F.struct("pos", *payload)))
    block = F.expr(f"pos div {arity ** every}").alias("block")
    return nodes.groupBy("tree", "height", block).agg(members.alias("members"))


def build(leaves: DataFrame, arity: int = ARITY, every: int = EVERY) -> list[DataFrame]:
    """The stored layers of the trees over ``leaves`` (tree, n, pos, node, any others).

    ``pos`` numbers the n leaves of a tree from 0. Layer k holds the blocks
    (tree, height, block, members) of level k * every; other columns of the
    leaves stay with layer 0. Each layer is written once.
    """
    nodes = leaves.withColumn("height", _height(F.col("n"), arity)).drop("n")
    layers = [materialize(_blocks(nodes, arity, every), "merkle-layer")]
    tallest = layers[0].agg(F.max("height")).first()[0] or 0
    for layer in range(-(-tallest // every) - 1):
        tops = _levels(layers[-1], layer, arity, every).where(F.col("height") > (layer + 1) * every)
        nodes = tops.select("tree", "height", F.col("block").alias("pos"), F.get(f"level{every}", F.lit(0)).alias("node"))
        layers.append(materialize(_blocks(nodes, arity, every), "merkle-layer"))
    return layers


def roots(layers: list[DataFrame], arity: int = ARITY, every: int = EVERY) -> DataFrame:
    """(tree, root) of every tree."""
    found = []
    for layer, blocks in enumerate(layers):
        tops = _levels(blocks, layer, arity, every).where(F.col("height") <= (layer + 1) * every)
        found.append(tops.select("tree", F.get(f"level{every}", F.lit(0)).alias("root")))
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _steps(at: Column, arity: int, every: int) -> Column:
    """The steps of a member's path inside its block: what stands left and right of it among its run, level by level."""
    steps = []
    for k in range(every):
        own = F.floor(at / arity**k).cast("int")
        first = own - own % arity
        left = F.slice(f"level{k}", first + 1, own - first)
        right = F.slice(f"level{k}", own + 2, first + arity - 1 - own)
        steps.append(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("go"))


def proofs(layers: list[DataFrame], above: DataFrame | None = None, arity: int = ARITY, every: int = EVERY) -> DataFrame:
    """(tree, subroot, root, path, and the leaves' columns): one row per leaf.

    ``path`` lists, from the leaf up, the digests left and right of the own
    node in its run, each side as one string. Goes down the stored layers: a
    block of a layer meets the path of its top node, one row for a whole block,
    computes the levels between and hands each member its path. ``above``
    (tree, subroot, root, path) carries on the paths of the trees' roots,
    else these are the roots.
    """
    tops = roots(layers, arity, every)
    if above is None:
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        above = tops.select("tree", F.col("root").alias("subroot"), "root", nothing.alias("path"))
    starts = above.select("tree", F.lit(0).cast("bigint").alias("block"), "subroot", "root", "path")
    done = None
    for layer in reversed(range(len(layers))):
        blocks = _levels(layers[layer], layer, arity, every)
        top = F.col("height") <= (layer + 1) * every
        # Trees whose root lies in this layer start here; the others bring the paths of the layer above.
        begin = blocks.where(top).join(starts, ["tree", "block"])
        joined = begin if done is None else begin.unionByName(blocks.where(~top).join(done, ["tree", "block"]))
        members = F.transform(
            "members", lambda m, i: F.struct(m.alias("member"), F.concat(_steps(i, arity, every), F.col("path")).alias("path"))
        )
        rows = joined.select("tree", "subroot", "root", F.inline(members))
        if layer:
            done = materialize(rows.select("tree", F.col("member.pos").alias("block"), "subroot", "root", "path"), "merkle-paths")
        else:
            return rows.select("tree", "subroot", "root", "path", "member.*")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, group_col: str = "source", order_col: str = "doc_id",
    claimed: Column | None = None, arity: int = ARITY, every: int = EVERY,
) -> DataFrame:
    """(group, id, leaf, claimed, subroot, root, path): one row per row of ``docs``, each with its proof.

    Leaves are digests of ``columns``; those of a group ascend by ``order_col``
    (null first, equal ones by digest), the groups by name, UTF-8 bytewise, the
    null group first. ``claimed`` is the leaf that someone else presents for a
    row, by default its own; ``fold`` tells what it proves. Repeated rows are
    leaves of their own, other columns of ``docs`` play no part, an empty table
    has no rows.

    Positions are those of a range shuffle over (group, id), so a group of a
    third of all rows is many tasks. Only digests are shuffled, never texts.
    """
    own = leaf_digest(*[F.col(f"`{c}`") for c in columns])
    rows = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("group"), F.col(f"`{order_col}`").alias("id"), own.alias("leaf"),
        (own if claimed is None else claimed).alias("claimed"),
    )
    ranked = materialize(rank_by_key(materialize(rows, "merkle-leaves"), ("group", "id", "leaf")).drop("n_total"), "merkle-ranks")
    # A tree is named by the rank of its first leaf, so trees order like their groups.
    groups = ranked.groupBy("group").agg(F.min("rank").alias("tree"), F.count("*").alias("n"))
    groups = materialize(groups.withColumnRenamed("group", "name"), "merkle-groups")
    placed = ranked.join(groups, F.col("group").eqNullSafe(F.col("name")))
    leaves = placed.select(
        "tree", "n", (F.col("rank") - F.col("tree")).alias("pos"), F.col("leaf").alias("node"), "claimed", "id", "group"
    )
    layers = build(leaves, arity, every)
    of_groups = rank_by_key(roots(layers, arity, every), ("tree",)).select(
        F.lit(0).cast("bigint").alias("tree"), F.col("n_total").alias("n"), F.col("rank").alias("pos"),
        F.col("root").alias("node"), F.col("tree").alias("group_tree"),
    )
    above = proofs(build(of_groups, arity, every), None, arity, every)
    above = above.select(F.col("group_tree").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    proved = proofs(layers, materialize(above, "merkle-groups-above"), arity, every)
    return proved.select("group", "id", F.col("node").alias("leaf"), "claimed", "subroot", "root", "path")


def tampered_leaf(columns: Sequence[str] = COLUMNS, order_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text has lost its line breaks, where 2 divides the CRC-32 of its id; else its own."""
    hit = F.crc32(F.col(order_col).cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
    return leaf_digest(*[text if c == text_col else F.col(c) for c in columns])


def op11_merkle_manifest(spark, sf_dir):
    """Every document's leaf, proof, and the root that its tampered version folds to."""
    proved = manifest(read_table(spark, sf_dir, "documents"), claimed=tampered_leaf())
    proved = proved.withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    numbers = {"doc_id", "n_chars"}
    fields = [text if c == "text" else f"CAST({c} AS VARCHAR)" if c in numbers else c for c in COLUMNS]
    return f"sha256({' || '.join(map(_field, fields))})"


def _tree_sql(name: str, source: str) -> str:
    """All nodes of the trees over ``source`` (tree, pos, node), level by level; ``top`` is the last."""
    return f"""
{name} AS (
  SELECT 0 AS lvl, tree, pos, node, n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {source})
  UNION ALL
  SELECT lvl + 1, tree, pos // {ARITY}, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + {ARITY - 1}) // {ARITY}
  FROM {name} WHERE n > 1 GROUP BY lvl, tree, pos // {ARITY})"""


OP11_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce(source, '') AS tree, source IS NULL AS no_source, {_leaf('text')} AS leaf,
         CASE WHEN {sql_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS claimed
  FROM documents),
g AS (SELECT tree, no_source, row_number() OVER (ORDER BY no_source DESC, tree) AS no FROM l GROUP BY tree, no_source),
leaves AS (SELECT g.no AS tree, row_number() OVER (PARTITION BY g.no ORDER BY doc_id) - 1 AS pos, leaf AS node, doc_id, claimed
           FROM l JOIN g USING (tree, no_source)),
inner_leaves AS (SELECT tree, pos, node FROM leaves),{_tree_sql('t', 'inner_leaves')},
subroots AS (SELECT tree AS no, node AS subroot, lvl AS height FROM t WHERE n = 1),
outer_leaves AS (SELECT 0 AS tree, no - 1 AS pos, subroot AS node FROM subroots),{_tree_sql('o', 'outer_leaves')},
top AS (SELECT node AS root, lvl AS outer_height FROM o WHERE n = 1),
spots AS (
  SELECT doc_id, x.tree AS no, x.pos, x.node AS leaf, claimed, s.subroot, s.height, top.root, top.outer_height
  FROM leaves x JOIN subroots s ON s.no = x.tree CROSS JOIN top),
steps AS (
  SELECT a.doc_id, k.lvl AS step, string_agg(k.node, '' ORDER BY k.pos) FILTER (k.pos < p.own) AS lft,
         string_agg(k.node, '' ORDER BY k.pos) FILTER (k.pos > p.own) AS rgt
  FROM spots a JOIN (SELECT DISTINCT tree, lvl, pos AS own FROM t) p ON p.tree = a.no AND p.own = a.pos // CAST(power({ARITY}, p.lvl) AS BIGINT)
       JOIN t k ON k.tree = p.tree AND k.lvl = p.lvl AND k.pos // {ARITY} = p.own // {ARITY}
  WHERE p.lvl < a.height GROUP BY a.doc_id, k.lvl
  UNION ALL
  SELECT a.doc_id, 100 + k.lvl, string_agg(k.node, '' ORDER BY k.pos) FILTER (k.pos < p.own),
         string_agg(k.node, '' ORDER BY k.pos) FILTER (k.pos > p.own)
  FROM spots a JOIN (SELECT DISTINCT lvl, pos AS own FROM o) p ON p.own = (a.no - 1) // CAST(power({ARITY}, p.lvl) AS BIGINT)
       JOIN o k ON k.lvl = p.lvl AND k.pos // {ARITY} = p.own // {ARITY}
  WHERE p.lvl < a.outer_height GROUP BY a.doc_id, k.lvl),
paths AS (SELECT doc_id, list(struct_pack(l := coalesce(lft, ''), r := coalesce(rgt, '')) ORDER BY step) AS path FROM steps GROUP BY doc_id),
folded AS (
  SELECT a.*, sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s.l || s.r), '')) AS proof_sha256,
         list_reduce(coalesce(path, []), lambda acc, s: struct_pack(l := sha256(s.l || acc.l || acc.r || s.r), r := ''),
                     struct_pack(l := claimed, r := '')).l AS folded_root
  FROM spots a LEFT JOIN paths USING (doc_id))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
