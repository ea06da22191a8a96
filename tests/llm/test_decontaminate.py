import re

import pytest
from pyspark.sql import functions as F

from pairloom.llm.decontaminate import decontaminate, find_hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ITEM = "The quick brown fox jumps over the lazy dog near a river bank"
BENCHMARK = [
    (1, ITEM), (2, "short item"), (10, "Élan vital"), (3, ""), (4, None), (5, "!!!"), (None, "nameless thing"),
    (6, ITEM), (7, "x"), (8, "one two three four five six seven eight nine ten"),
]
DOCS = [
    (1, f"Before. {ITEM.upper()}! After that."), (2, "the quick brown fox jumps over the lazy dog near"),
    (3, "quick brown fox jumps over the lazy dog near a"), (4, "the quick brown fox jumps over the lazy dog"),
    (5, None), (6, ""), (7, "a short, item: and élan vital; Élan vital"), (8, "this is a nameless thing"), (9, "x y x x"),
    (10, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten"),
    (11, "clean words only"), (11, "a short item under a repeated id"), (None, "short item without an id"), (12, "ßX x\x7fx"),
]


def expected(docs, benchmark, n=10):
    def words(text):
        return WORD.findall((text or "").translate(LOWER))

    windows = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    rows = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for length in range(1, n + 1):
            for i in range(len(w) - length + 1):
                found = windows.get(tuple(w[i : i + length]))
                if found and (length == n or length < n):
                    hit.update(range(i, i + length))
                    items |= found
        rows.append((doc, len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return sorted(rows, key=str)


def _tables(spark):
    return (
        spark.createDataFrame(DOCS, "doc_id bigint, text string"),
        spark.createDataFrame(BENCHMARK, "item_id bigint, text string"),
    )


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize("n", [1, 3, 7, 10])
def test_hits_are_those_of_brute_force(spark, n, limit):
    """Short items and long ones, a broadcast and a shuffled set of windows."""
    docs, benchmark = _tables(spark)
    found = find_hits(docs, benchmark, n, broadcast_windows=limit).collect()
    assert sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=str) == expected(DOCS, BENCHMARK, n)


def test_spans_are_merged(spark):
    docs, benchmark = _tables(spark)
    spans = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in find_hits(docs, benchmark).collect()}
    assert spans[1] == [(1, 14)] and spans[7] == [(1, 3), (6, 8)] and spans[9] == [(0, 1), (2, 4)] and spans[4] == []


def test_removing_documents_leaves_clean_ones(spark):
    docs, benchmark = _tables(spark)
    docs = docs.withColumns({"hit_id": F.lit(1), "spans": F.lit("mine")})
    left = decontaminate(docs, benchmark)
    assert left.columns == docs.columns
    clean = [text for doc, text in DOCS if not expected([(doc, text)], BENCHMARK)[0][2]]
    assert sorted(r["text"] or "" for r in left.collect()) == sorted(t or "" for t in clean)
    assert "clean words only" in clean and len(clean) == 4


def test_removing_passages_keeps_the_rest(spark):
    docs, benchmark = _tables(spark)
    text = {r["doc_id"]: r["text"] for r in decontaminate(docs, benchmark, "spans").collect() if r["doc_id"] != 11}
    assert text[1] == "Before. ! After that."
    assert text[7] == "a : and élan vital; "
    assert text[4] == DOCS[3][1] and text[5] is None and text[6] == ""


def test_empty_tables(spark):
    docs, benchmark = _tables(spark)
    assert find_hits(docs.limit(0), benchmark).count() == 0
    assert [r["n_hit"] for r in find_hits(docs, benchmark.limit(0)).collect()] == [0] * len(DOCS)
    assert decontaminate(docs, benchmark.limit(0)).count() == len(DOCS)


def test_long_text(spark):
    long = "filler words go here " * 20000
    docs = spark.createDataFrame([(1, long + ITEM + " " + long)], "doc_id bigint, text string")
    row = find_hits(docs, _tables(spark)[1].where("item_id = 1")).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == (160013, 13, ["1"])


def test_no_python_in_the_plan(spark):
    docs, benchmark = _tables(spark)
    plan = find_hits(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_texts_against_a_shuffled_set(spark):
    """Texts of 20,000 words, many copies of one: as many hits as with a broadcast set."""
    long = [" ".join(f"w{(i * k) % 9973}" for i in range(20_000)) for k in range(1, 13)]
    rows = [(k, text + " " + ITEM * (k % 2)) for k, text in enumerate(long)] + [(100 + k, long[0]) for k in range(12)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    benchmark = spark.createDataFrame([*BENCHMARK, (20, " ".join(f"w{i}" for i in range(5, 300)))], "item_id bigint, text string")

    def hits(limit):
        found = find_hits(docs, benchmark, broadcast_windows=limit).collect()
        return sorted(((r["id"], r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in found), key=str)

    assert hits(0) == hits(10**6) and sum(r[2] > 0 for r in hits(0)) > 12
