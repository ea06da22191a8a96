import random
import time

import pytest
from pyspark.sql import functions as F

from pairloom.functions import ids as i
from pairloom.operators import encode, subword
from pairloom.operators.segment import merger

TERMS = ("Hà Nội", "Hồ Chí Minh", "Hồ")
TEXTS = ["tôi ở Hà Nội nhé", "Hồ Chí Minh và Hồ", "xHồy", "", None, "tôi tôi tôi ở đây", "một  hai ba", "ﬁ 😀"]


@pytest.fixture(scope="module")
def learned(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    vocab, merges = subword.learn_bpe(subword.word_counts(df, "t", TERMS), 60, "vi", TERMS)
    return vocab, merges, encode.load_model(vocab, merges, "vi")


def test_round_trip(apply, learned):
    model = learned[2]
    ids = apply(lambda c: encode.encode_text(c, model), TEXTS)
    assert ids[3] == [] and ids[4] is None
    back = apply(lambda c: encode.decode_ids(c, model), ids, "array<int>")
    assert back == ["tôi ở Hà Nội nhé", "Hồ Chí Minh và Hồ", "xHồy", "", None, "tôi tôi tôi ở đây", "một hai ba", "fi 😀"]


def test_map_side_ids_equal_the_joined_ones(spark, learned):
    """Cutting distinct words and looking pieces up by join gives the same ids."""
    vocab, _, model = learned
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n int, t string").where("t is not null")
    clean = df.withColumn("t", subword.subword_normalize(F.col("t"))).where("t != ''")
    placed = clean.select("n", F.posexplode(subword.word_units(F.col("t"), TERMS)).alias("w", "word"))
    cut = encode.segment_words(placed.select("word").distinct(), model)
    pieces = placed.join(cut, "word").select("n", "w", F.posexplode("pieces").alias("p", "piece"))
    joined = encode.lookup_ids(pieces, vocab, "vi").groupBy("n").agg(
        F.array_sort(F.collect_list(F.struct("w", "p", "id"))).alias("rows")
    )
    by_join = {r.n: [x.id for x in r.rows] for r in joined.collect()}
    mapped = clean.withColumn("ids", encode.encode_text(F.col("t"), model))
    assert by_join == {r.n: r.ids for r in mapped.collect()}


def test_unknown_pieces(apply, learned):
    assert apply(lambda c: encode.encode_text(c, learned[2]), ["зз"])[0][-2:] == [1, 1]


def test_lookups_by_join(spark, learned):
    vocab = learned[0]
    pieces = spark.createDataFrame([("Hồ",), ("nowhere",)], "piece string")
    got = {r.piece: r.id for r in encode.lookup_ids(pieces, vocab, "vi").collect()}
    assert got == {"Hồ": 6, "nowhere": 1}
    back = encode.lookup_pieces(spark.createDataFrame([(6,), (10_000,)], "id int"), vocab, "vi")
    assert {r.id: r.piece for r in back.collect()} == {6: "Hồ", 10_000: None}


def test_models_with_gaps_are_refused(spark, learned):
    vocab, merges, _ = learned
    with pytest.raises(ValueError, match="ids"):
        encode.load_model(vocab.where("id != 5"), merges, "vi")


def test_truncation_drops_the_end_mark(apply):
    long, short = list(range(10, 140)), [10, 11]
    got = apply(lambda c: i.wrap_truncate(c, 128), [long, short, []], "array<int>")
    assert got[0] == [2, *long[:127]] and got[1] == [2, 10, 11, 3] and got[2] == [2, 3]


def test_encode_pairs(spark, learned):
    model = learned[2]
    df = spark.createDataFrame([("tôi " * 100, "ở")], "src string, tgt string")
    row = encode.encode_pairs(df, model, model, 16).first()
    assert row.src_len == 16 == len(row.src_ids) and row.src_ids[-1] != 3
    assert row.tgt_ids[0] == 2 and row.tgt_ids[-1] == 3 and row.tgt_len == len(row.tgt_ids)


def test_id_functions(apply):
    kind = "array<int>"
    assert apply(i.drop_special_ids, [[2, 5, 1, 4, 3, 0]], kind) == [[5, 4]]
    assert apply(i.pad_mask, [[2, 5, 0]], kind) == [[True, True, False]]
    assert apply(i.decoder_input, [[2, 5, 3], [2], []], kind) == [[2, 5], [], []]
    assert apply(i.decoder_label, [[2, 5, 3], [2], []], kind) == [[5, 3], [], []]
    assert apply(i.cut_at_eos, [[2, 5, 6, 3, 7, 3], [5, 6], [3], [2], []], kind) == [[5, 6], [5, 6], [], [], []]
    assert apply(lambda c: i.pad_right(c, F.lit(4)), [[5], [5, 6, 7, 8]], kind) == [[5, 0, 0, 0], [5, 6, 7, 8]]
    assert apply(i.token_length, [[5, 6]], kind) == [2]
    assert apply(i.pieces_to_text, [["▁a", "b", "▁c"], []], "array<string>") == ["ab c", ""]


def test_special_ids_never_come_from_text(spark):
    texts = ["a<s>b i</s>j", "<pad> <unk>", "a <s> b"] * 5
    lines = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab, merges = subword.learn_bpe(subword.word_counts(lines, "text"), 80)
    pieces = [r.piece for r in vocab.collect()]
    assert len(set(pieces)) == len(pieces)
    model = encode.load_model(vocab, merges, "en")
    ids = lines.withColumn("ids", encode.encode_text(F.col("text"), model))
    rows = ids.select("text", "ids", encode.decode_ids(F.col("ids"), model).alias("back")).collect()
    assert all(min(r.ids) > 3 and r.back == r.text for r in rows)
    looked = encode.lookup_ids(spark.createDataFrame([("<s>",), ("a",)], "piece string"), vocab, "en").collect()
    assert {r.piece: r.id for r in looked}["<s>"] == 1
    with pytest.raises(ValueError):
        subword.learn_bpe(subword.word_counts(lines, "text", ("<s>",)), 80, "en", ("<s>",))


def test_merging_goes_turn_by_turn():
    rng = random.Random(6)

    def one_by_one(merges, symbols):
        for left, right in merges:
            joined, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == [left, right]:
                    joined.append(left + right)
                    i += 2
                else:
                    joined.append(symbols[i])
                    i += 1
            symbols = joined
        return symbols

    for _ in range(400):
        parts = ["a", "b", "aa", "ab", "ba", "aab", "abab"]
        merges = [(rng.choice(parts), rng.choice(parts)) for _ in range(rng.randint(0, 12))]
        word = [rng.choice("ab") for _ in range(rng.randint(0, 25))]
        assert merger(merges)(list(word)) == one_by_one(merges, word), (merges, word)


def test_long_words_are_merged_in_good_time():
    rng = random.Random(7)
    merges = [(a, b) for a in "abcdefghijkl" for b in "abcdefghijkl"]
    merges += [(l + r, m) for l, r in merges for m in "abcdefghijkl"]
    word = [rng.choice("abcdefghijkl") for _ in range(100_000)]
    began = time.perf_counter()
    assert "".join(merger(merges)(word)) == "".join(word)
    assert time.perf_counter() - began < 10


def test_remembered_words_stay_small(spark):
    """a worker held 262,144 words, however long."""
    import tracemalloc

    import pyarrow as pa

    run = encode._encoder(encode.SubwordModel(("<pad>", "<unk>", "<s>", "</s>", "a"), ())).func
    words = [f"{i}{'a' * (i % 3) * 50}" for i in range(100_000)]
    tracemalloc.start()
    ids = run(pa.array(words))
    lengths = [len(i) for i in ids.to_pylist()[::997]]
    del ids
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert lengths == [len(w) + 1 for w in words[::997]]
    assert held < 25_000_000
