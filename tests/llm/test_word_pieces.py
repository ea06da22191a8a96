import os
import random

import pytest

from pairloom.llm.word_pieces import VOCABULARY, WORD_START, build_automaton, count_pieces, count_tokens, load_vocabulary


def greedy(vocabulary, word):
    n = i = 0
    while i < len(word):
        for j in range(min(len(word), i + 64), i, -1):
            if word[i:j] in vocabulary:
                n, i = n + 1, j
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_counts_are_those_of_greedy_longest_match():
    rng = random.Random(2)
    for _ in range(300):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 12))}
        automaton = build_automaton(vocabulary)
        for _ in range(30):
            word = "".join(rng.choice("abcdé😀") for _ in range(rng.randint(0, 16)))
            assert count_pieces(automaton, word) == greedy(vocabulary, word), (vocabulary, word)


def test_long_words_take_linear_time():
    vocabulary = {"a" * n for n in range(1, 65)} | {"a" * 40 + "b"}
    assert count_pieces(build_automaton(vocabulary), "a" * 200000) == 3125


def test_columns_and_rows(spark):
    docs = spark.createDataFrame([(1, "ab ab\nc", "x"), (1, "ab ab\nc", "x"), (2, None, "y"), (3, " \t", "z")], "doc_id bigint, text string, counted string")
    got = sorted(tuple(r) for r in count_tokens(docs, ["▁ab", "▁", "c"]).select("doc_id", "counted", "n_words", "n_tokens").collect())
    assert got == [(1, "x", 3, 4), (1, "x", 3, 4), (2, "y", 0, 0), (3, "z", 0, 0)]
    assert count_tokens(docs.limit(0), ["a"]).count() == 0
    assert [r["n_tokens"] for r in count_tokens(docs, []).where("doc_id = 3").collect()] == [0]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary is not here")
def test_public_vocabulary():
    pieces = load_vocabulary()
    known, automaton = set(pieces), build_automaton(pieces)
    for word in ("the", "internationalisation", "Größenordnung", "汉字と", "\x01", "x" * 300, "queuearchitecture"):
        assert count_pieces(automaton, WORD_START + word) == greedy(known, WORD_START + word)
