import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.llm.mixing import WEIGHTS, mix, mixed_documents, source_targets, split_quotas, split_tickets


def _filled(sizes, weights=WEIGHTS, repeats=3):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > sizes[s] * repeats]
        if not over:
            return {**full, **share}
        full.update({s: sizes[s] * repeats for s in over})


SIZES = [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5000, "d": 3, None: 40}, {"x": 7}, {"a": 0, "b": 10},
    {f"s{i:02}": (i * 37) % 101 + 1 for i in range(40)}, {"Z": 5, "a": 5, "é": 5000, None: 0},
]


@pytest.mark.parametrize("sizes", SIZES)
def test_targets_are_those_of_resharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in source_targets(table).collect()}
    assert got == pytest.approx(_filled(sizes), abs=1e-5)


def _docs(spark):
    rows = [(i, "w " * (i % 50 + 1), "big" if i % 3 else f"small{i % 5}") for i in range(600)]
    rows += [(1000, None, "big"), (1001, "", "small0"), (1002, " \t", None), (1003, "a b c", None), (None, "d e", "big"), (None, "d e", "big")]
    rows += [(3, "w w w", "big"), (3, "w w w", "big")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_taken_words_meet_the_targets(spark):
    rows = mixed_documents(_docs(spark), block_docs=16).collect()
    assert len(rows) == 608
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())


def test_same_mix_in_any_layout(spark):
    def run(n):
        _, draws = mix(_docs(spark).where("doc_id <> 3").repartition(n), block_docs=16)
        return sorted((r["id"], r["pass"], r["shard"], r["place"], r["taken"]) for r in draws.where("id IS NOT NULL").collect())

    assert run(1) == run(7)


def _shard(ticket, of, bits, seed):
    """The leaf a ticket ends in, by sorting the tickets of each node it passes."""
    node, held = 0, sorted(of)
    for level in range(bits):
        held.sort(key=lambda t: (hashlib.md5(f"{seed}|tree|{node + (1 << level)}|{t[0]}|{t[1]}".encode()).hexdigest(), t))
        half = len(held) // 2
        right = held.index(ticket) >= half
        node, held = 2 * node + right, held[half:] if right else held[:half]
    return node


@pytest.mark.parametrize("bits", [0, 1, 4])
def test_tickets_go_where_sorting_each_node_sends_them(spark, bits):
    tickets = [(1, t) for t in range(90)] + [(2, t) for t in range(7)] + [(3, 0)]
    table = spark.createDataFrame(tickets, "source_no int, ticket bigint").repartition(5)
    got = {(r["source_no"], r["ticket"]): r["shard"] for r in split_tickets(table, bits, 11).collect()}
    assert got == {t: _shard(t, tickets, bits, 11) for t in tickets}


def test_taken_documents_carry_their_places(spark):
    """A document's draws add up to its words taken, and a shard's blocks are those of its tickets."""
    rows = mixed_documents(_docs(spark), block_docs=4).collect()
    assert all(r["taken"] == sum(d["taken"] for d in r["draws"]) for r in rows)
    per_shard = Counter(d["shard"] for r in rows for d in r["draws"])
    assert set(per_shard) == set(range(16))
    other = mixed_documents(_docs(spark), block_docs=4, shard_bits=1).collect()
    assert {d["shard"] for r in other for d in r["draws"]} == {0, 1}


def test_draws_are_disjoint_and_shards_even(spark):
    _, draws = mix(_docs(spark), block_docs=4, shard_bits=3)
    rows = draws.collect()
    assert len({(r["row"], r["pass"]) for r in rows}) == len(rows)
    assert {r["shard"] for r in rows} == set(range(8))


def test_tree_splits_quotas_exactly(spark):
    quotas = {1: 1000, 2: 10, 3: 1, 4: 333, 5: 0}
    table = spark.createDataFrame(list(quotas.items()), "source_no int, n bigint")
    by_source, by_shard = Counter(), Counter()
    for r in split_quotas(table, 4).collect():
        by_source[r["source_no"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert dict(by_source) == {k: v for k, v in quotas.items() if v}
    assert len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 4


def test_tree_draws_without_replacement(spark):
    """Of 30 + 10 tickets 20 go left: the mean is that of the hypergeometric law, the spread too."""
    table = spark.createDataFrame([(1, 30), (2, 10)], "source_no int, n bigint")
    left = [
        sum(r["n"] for r in split_quotas(table, 1, seed).where("shard = 0 AND source_no = 2").collect()) for seed in range(60)
    ]
    mean = sum(left) / len(left)
    variance = sum((x - mean) ** 2 for x in left) / (len(left) - 1)
    assert abs(mean - 5) < 0.8 and 0.9 < variance < 3.4  # 5 and 20 * .25 * .75 * 20/39 = 1.92


def test_empty_and_wordless_tables(spark):
    docs = _docs(spark)
    assert mixed_documents(docs.limit(0)).count() == 0
    rows = mixed_documents(docs.where("trim(text) = ''").unionByName(docs.where("text IS NULL"))).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in rows} == {(0, 0.0, 0)}


def test_no_python_in_the_plan(spark):
    for table in mix(_docs(spark)):
        plan = table._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
