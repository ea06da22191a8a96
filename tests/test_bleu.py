import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.operators.bleu import corpus_bleu, ngram_totals
from tests.test_text import python_13a


def python_bleu(pairs):
    match, total, h, r, smooth = [0] * 4, [0] * 4, 0, 0, 1.0
    for hyp, ref in pairs:
        hyp, ref = python_13a(hyp), python_13a(ref)
        h, r = h + len(hyp), r + len(ref)
        for n in range(1, 5):
            a = Counter(zip(*[hyp[k:] for k in range(n)]))
            b = Counter(zip(*[ref[k:] for k in range(n)]))
            match[n - 1] += sum((a & b).values())
            total[n - 1] += sum(a.values())
    if not any(match) or not all(total):
        return 0.0
    logs = 0.0
    for m, t in zip(match, total):
        if m == 0:
            smooth *= 2
        logs += math.log(100.0 * m / t if m else 100.0 / (smooth * t))
    return min(1.0, math.exp(min(0.0, 1 - r / h))) * math.exp(logs / 4)


def score(spark, pairs, parts=3):
    rows = [(i, *pair) for i, pair in enumerate(pairs)]
    df = spark.createDataFrame(rows, "sample_id bigint, translation string, reference string").repartition(parts)
    return corpus_bleu(df).first()


CASES = {
    "same": [("the cat sat on the mat .", "the cat sat on the mat .")],
    "repeats": [("the the the the the the the", "the cat is on the mat"), ("a b c d e", "a b c d e")],
    "short": [("the cat sat on", "the cat sat on the mat today"), ("x y z w v", "x y q w v u")],
    "no four": [("a b c x d e f", "a b c y d e f")],
    "only words": [("a x b y c", "c q b r a")],
    "nothing": [("a b c d", "e f g h")],
    "empty hypothesis": [("", "a b c d e"), ("a b c d e", "a b c d e")],
    "all empty": [("", "a b")],
    "too short": [("a b", "a b")],
    "marks": [("Hello, world! 3.14", "Hello , world ! 3.14"), ("it's 5-6 (ok) yes", "it's 5-6 (ok) no")],
}


@pytest.mark.parametrize("name", CASES)
def test_score(spark, name):
    got = score(spark, CASES[name])
    assert got.bleu == pytest.approx(python_bleu(CASES[name]), abs=1e-9)
    assert got.hyp_length == sum(len(python_13a(h)) for h, _ in CASES[name])
    assert got.ref_length == sum(len(python_13a(r)) for _, r in CASES[name])


def test_no_rows(spark):
    df = spark.createDataFrame([], "sample_id bigint, translation string, reference string")
    assert corpus_bleu(df).first().bleu == 0.0


def test_layout_does_not_matter(spark):
    pairs = CASES["short"] + CASES["repeats"] + CASES["marks"]
    assert score(spark, pairs, 1) == score(spark, pairs, 7)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from("abc."), max_size=9).map(" ".join)] * 2), min_size=1, max_size=8))
def test_score_property(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    assert score(spark, pairs).bleu == pytest.approx(python_bleu(pairs), abs=1e-9)


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a", "a")], "sample_id bigint, translation string, reference string")
    plan = ngram_totals(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan  # one row of sums per task


def test_repeated_samples_are_counted_one_by_one(spark):
    pairs = [("the cat sat on the mat", "the cat is on the mat"), ("on the mat the cat sat", "a dog ran on the mat")]
    rows = [(1, *pair) for pair in pairs]
    df = spark.createDataFrame(rows, "sample_id bigint, translation string, reference string")
    assert corpus_bleu(df).first().bleu == pytest.approx(python_bleu(pairs), abs=1e-9)


def test_four_orders_and_null_texts(spark):
    df = spark.createDataFrame([(1, None, "a b"), (2, "a", None)], "sample_id bigint, translation string, reference string")
    assert sorted(map(tuple, ngram_totals(df).collect())) == [(1, 0, 1, 2), (2, 0, 0, 1), (3, 0, 0, 0), (4, 0, 0, 0)]


def test_both_tokenizers_agree(apply):
    from pairloom.functions.text import tokenize_13a, tokenizer_13a

    texts = ["", " a.b,c 3.14 1,000-5 x-\ny", "it's (a) [b] {c} \\ ^ ~ &amp;quot; &lt;b&gt; <skipped>", "é\u2003ü\x1c.\xa0,5-6-", "...,,,", "1.-2,-.5"]
    assert apply(tokenize_13a, texts) == [tokenizer_13a()(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("a1.,-& \n\t\xa0\u2003!<&;amplt<skipped>'_"), max_size=24))
def test_chunks_give_the_tokens_of_the_text(text):
    from pairloom.functions.text import tokenizer_13a

    assert tokenizer_13a()(text) == python_13a(text.replace("\xa0", " ").replace("\u2003", " "))


def test_counting_in_parts_and_repeated_words(spark, monkeypatch):
    """grams are numbered over many rows, chunks are remembered and forgotten; each row counts by itself."""
    from pairloom.operators import bleu

    monkeypatch.setattr(bleu, "_TOKENS_AT_ONCE", 40)
    monkeypatch.setattr(bleu, "_KNOWN_CHUNKS", 5)
    words = "the cat, the dog. 3.14 a-b 1-2 it's the the cat".split()
    pairs = [(" ".join(words[(i * k) % 7 :: 1 + i % 3]), " ".join(words[i % 5 :] * (1 + i % 2))) for i in range(120) for k in (1, 2)]
    rows = [(i, *pair) for i, pair in enumerate([*pairs, (None, "a b"), ("", "")])]
    df = spark.createDataFrame(rows, "i int, translation string, reference string").repartition(2)
    got = df.select("i", bleu.gram_counts(df.translation, df.reference).alias("c")).select("i", "c.*").collect()
    for row in got:
        _, hyp, ref = rows[row.i]
        hyp, ref = python_13a(hyp or ""), python_13a(ref or "")
        for n in range(1, 5):
            a, b = (Counter(zip(*[side[k:] for k in range(n)])) for side in (hyp, ref))
            assert (row[f"m{n}"], row[f"t{n}"], row[f"r{n}"]) == (sum((a & b).values()), sum(a.values()), sum(b.values()))
