import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import subword as s
from pairloom.operators.segment import merger


def one_by_one(words, wanted, known):
    """Textbook byte-pair merging: recount everything, merge the best pair, repeat."""
    words = {tuple(w): f for w, f in words.items()}
    merges, made = [], set()
    while len(made) < wanted:
        pairs = Counter()
        for word, freq in words.items():
            for pair in zip(word, word[1:]):
                pairs[pair] += freq
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < 2:
            break
        merges.append((*best, pairs[best]))
        if "".join(best) not in known:
            made.add("".join(best))
        merged = Counter()
        for word, freq in words.items():
            out, i = [], 0
            while i < len(word):
                step = 2 if word[i : i + 2] == best else 1
                out.append("".join(word[i : i + step]))
                i += step
            merged[tuple(out)] += freq
        words = merged
    return merges


def random_words(seed, letters, n, longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(1, longest))): rng.randint(1, 30) for _ in range(n)}


@pytest.mark.parametrize(
    "seed,letters,n,options",
    [
        (1, "aab", 60, {}),
        (2, "abcde", 150, {"lookahead": 4}),
        (3, "abcdefghij", 300, {"lookahead": 16, "max_run_chars": 300}),
        (4, "aaaab", 80, {"max_run_chars": 1}),
        (6, "ab", 120, {"lookahead": 8}),
        (5, "abc", 200, {"lookahead": 1, "max_lookahead": 2}),
    ],
)
def test_merges_equal_the_one_by_one_procedure(spark, seed, letters, n, options):
    words = random_words(seed, letters, n)
    table = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    known = set("".join(words))
    for wanted in (1, 60):
        assert s.learn_merges(table, known, wanted, **options) == one_by_one(words, wanted, known)


@pytest.mark.parametrize("seed,letters", [(11, "aab"), (12, "abc"), (13, "aaaab"), (14, "abcd")])
def test_segmenting_repeats_what_learning_did(seed, letters):
    """Also where a symbol comes about in two ways, so that a pair is merged twice."""
    words = random_words(seed, letters, 120, 12)
    merges = one_by_one(words, 60, set(letters))
    merge = merger([(left, right) for left, right, _ in merges])
    for word in words:
        symbols = list(word)
        for left, right, _ in merges:
            symbols = merger([(left, right)])(symbols)
        assert merge(list(word)) == symbols


def test_merges_stop_below_two(spark):
    table = spark.createDataFrame([("abab", 3), ("xyz", 1)], "word string, freq bigint")
    assert s.learn_merges(table, set("abxyz"), 100, min_freq=2) == [("a", "b", 6), ("ab", "ab", 3)]
    assert len(s.learn_merges(table, set("abxyz"), 100)) == 4


def test_merges_ignore_layout(spark):
    words = random_words(9, "abcdef", 200)
    table = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    assert s.learn_merges(table.repartition(1), set(), 30) == s.learn_merges(table.repartition(7), set(), 30)


def test_vocabulary_layout(spark):
    rows = [("Hà Nội đẹp", ), ("đẹp đẹp", )]
    df = spark.createDataFrame(rows, "vi string")
    words = s.word_counts(df, "vi", ("Hà Nội", "Huế"))
    vocab, merges = s.learn_bpe(words, 20, "vi", ("Hà Nội", "Huế"))
    got = [tuple(r) for r in vocab.orderBy("id").collect()]
    assert [g[2] for g in got[:6]] == ["<pad>", "<unk>", "<s>", "</s>", "Hà▁Nội", "Huế"]
    assert [g[3] for g in got[4:6]] == [1, 0]
    assert [g[1] for g in got] == list(range(len(got)))
    kinds = [g[4] for g in got]
    assert kinds == sorted(kinds, key=["special", "user", "merge", "char"].index)
    assert [(r.l + r.r) for r in merges.orderBy("rank").collect()] == [g[2] for g in got if g[4] == "merge"]
    assert [(r.lang, r.n_pieces) for r in s.vocab_size(vocab).collect()] == [("vi", len(got))]


def test_vocabulary_keeps_the_most_frequent_characters_when_full(spark):
    table = spark.createDataFrame([("▁ab", 5), ("▁ac", 2), ("▁d", 1)], "word string, freq bigint")
    vocab, merges = s.learn_bpe(table, 7)
    assert [r.piece for r in vocab.orderBy("id").collect()][4:] == ["▁", "a", "b"]
    assert merges.count() == 0
    with pytest.raises(ValueError):
        s.learn_bpe(table, 4, "vi", ("x",))


def test_word_units(apply):
    symbols = ("Hà Nội", "Hồ", "Hồ Chí Minh", "a.b")
    cases = ["tôi ở Hà Nội nhé", "Hồ Chí Minh", "xHồy", "a.b axb", "Hồ Hồng"]
    u = s.USER
    assert apply(lambda c: s.word_units(c, symbols), cases) == [
        ["▁tôi", "▁ở", "▁", u + "Hà▁Nội", "▁nhé"],
        ["▁", u + "Hồ▁Chí▁Minh"],
        ["▁x", u + "Hồ", "y"],
        ["▁", u + "a.b", "▁axb"],
        ["▁", u + "Hồ", "▁", u + "Hồ", "ng"],
    ]
    assert apply(s.word_units, ["a bc"]) == [["▁a", "▁bc"]]


def test_counts(spark):
    df = spark.createDataFrame([("ab  ab",), ("aab\x01",), ("",), (None,)], "t string")
    words = s.word_counts(df, "t")
    assert {r.word: r.freq for r in words.collect()} == {"▁ab": 2, "▁aab": 1}
    pairs = {(r.l, r.r): r.freq for r in s.pair_counts(words).collect()}
    assert pairs == {("▁", "a"): 3, ("a", "b"): 3, ("a", "a"): 1}
    chars = s.char_counts(words)
    assert {r.piece: r.freq for r in chars.collect()} == {"▁": 3, "a": 4, "b": 3}
    assert [r.piece for r in s.top_pieces(chars, 2).collect()] == ["a", "b"]
    same = s.word_counts(df, "t", ("zz",))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, words.collect()))


def test_astral_characters_stay_whole(spark):
    df = spark.createDataFrame([("😀😀 😀",)], "t string")
    words = s.word_counts(df, "t")
    assert {r.piece: r.freq for r in s.char_counts(words).collect()} == {"▁": 2, "😀": 3}
    assert {(r.l, r.r): r.freq for r in s.pair_counts(words).collect()} == {("▁", "😀"): 2, ("😀", "😀"): 1}


def test_few_rounds_where_stretches_are_few(spark, monkeypatch):
    """every round is a pass over all words; the number of candidates grew by two only."""
    words = random_words(5, "abcdefghij", 300, 8)
    table = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    rounds, real = [], s._merges_in_runs
    monkeypatch.setattr(s, "_merges_in_runs", lambda *a: rounds.append(1) or real(*a))
    wanted = one_by_one(words, 200, set("abcdefghij"))
    assert s.learn_merges(table, set("abcdefghij"), 200, lookahead=2) == wanted
    few = len(rounds)
    assert s.learn_merges(table, set("abcdefghij"), 200, lookahead=2, max_run_chars=300) == wanted
    assert few < 8 < len(rounds) - few
