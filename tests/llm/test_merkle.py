import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm.merkle import build, fold, manifest, proof_digest, proofs, roots, tampered_leaf

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes, arity):
    """Brute force: the root, and for each leaf its siblings left and right, level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, own in enumerate(at):
            first = own - own % arity
            paths[leaf].append(("".join(nodes[first:own]), "".join(nodes[own + 1 : first + arity])))
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        at = [own // arity for own in at]
    return nodes[0], paths


def _expected(rows, arity=3):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))):
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {name: _tree([_leaf(r) for r in groups[name]], arity) for name in names}
    root, above = _tree([trees[name][0] for name in names], arity)
    out = []
    for place, name in enumerate(names):
        for row, path in zip(groups[name], trees[name][1]):
            path, claimed = path + above[place], row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                claimed = (*row[:4], row[4].replace("\n", ""))
            node = _leaf(claimed)
            for left, right in path:
                node = sha(left + node + right)
            out.append((row[0], _leaf(row), trees[name][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def _got(docs, **settings):
    proved = manifest(docs, claimed=tampered_leaf(), **settings)
    proved = proved.select(
        "id", "leaf", "subroot", "root", proof_digest(F.col("path")), fold(F.col("claimed"), F.col("path")).alias("f"),
    ).withColumn("ok", F.col("f") == F.col("root"))
    return sorted(map(tuple, proved.collect()), key=str)


ROWS = [(i, f"s{i % 2}" if i % 3 else "hot", "en", i * 7, f"line {i}\nmore" if i % 4 else "é ü") for i in range(400)]
ROWS += [(1000 + i, f"own {i}", None, None, None) for i in range(7)] + [(2000, None, "de", 1, ""), (2001, None, None, None, "\n\n")]
ROWS += [(5, "hot", "en", 1, "again"), (5, "hot", "en", 1, "again"), (None, "hot", "en", 1, "no\nid"), (3000, "", "en", 1, "x" * 300_000)]
ROWS += [(3001, "ÿ", "en", 1, "a"), (3002, "\U0001f600", "en", 1, "b")]


@pytest.mark.parametrize("parts", [1, 7])
def test_proofs_equal_those_of_a_plain_tree(spark, parts):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    docs = docs.withColumns({c: F.lit(c) for c in ("tree", "pos", "node", "rank", "path", "group", "_place", "n")})
    got = _got(docs)
    assert got == _expected(ROWS) and 50 < sum(not r[-1] for r in got) < len(ROWS)


def test_one_document_and_none(spark):
    assert _got(spark.createDataFrame(ROWS[:1], SCHEMA)) == _expected(ROWS[:1])
    assert _got(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 81, 82, 245])
@pytest.mark.parametrize("arity, every", [(3, 1), (3, 2), (2, 3)])
def test_any_size_and_any_distance_of_stored_levels(spark, n, arity, every):
    if n > 28 and (arity, every) != (3, 2):
        pytest.skip("large sizes once")
    nodes = [sha(str(i)) for i in range(n)]
    leaves = spark.createDataFrame([(7, n, i, node, i * 10) for i, node in enumerate(nodes)], "tree bigint, n bigint, pos bigint, node string, tag int")
    layers = build(leaves.repartition(3), arity, every)
    root, paths = _tree(nodes, arity)
    assert [tuple(r) for r in roots(layers, arity, every).collect()] == [(7, root)]
    got = {r["tag"]: (r["root"], [(s["left"], s["right"]) for s in r["path"]]) for r in proofs(layers, None, arity, every).collect()}
    assert got == {i * 10: (root, path) for i, path in enumerate(paths)}
    # Only every ``every``-th level is stored, in blocks of bounded size.
    assert len(layers) <= 1 + n.bit_length() // every and all(b["k"] <= arity**every for layer in layers for b in layer.select(F.size("members").alias("k")).collect())
