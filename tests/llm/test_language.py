import math
import random
import zlib

import numpy as np
import pytest

from pairloom.llm import language
from pairloom.llm.language import ORDER, PAD, build_trees, code_lengths, gram_counts, held_out, learn_from_documents, learn_trees, predict

TEXTS = {
    "en": ["the cat sat on the mat and the dog ran off", "this is the house that jack built", "they were there with the others"],
    "de": ["der hund und die katze sind nicht im haus", "das ist ein schönes großes haus", "wir waren nicht dabei"],
    "fr": ["le chat est sur la table et le chien est là", "ceci n'est pas une pipe", "où êtes-vous allés"],
}


def _trees(spark):
    rows = [(lang, t) for lang, texts in TEXTS.items() for t in texts]
    counts = gram_counts(spark.createDataFrame(rows, "lang string, text string").repartition(4)).collect()
    langs = sorted(TEXTS)
    arrays = [np.array([r[c] if c != "lang" else langs.index(r[c]) for r in counts], np.int64) for c in ("lang", "ctx_order", "gram", "n")]
    return build_trees(langs, *arrays)


def _exact(lang, text):
    """The code length by walking contexts of plain dictionaries, method C."""
    counts = {}
    for t in TEXTS[lang]:
        data = PAD * ORDER + t.encode().lower()
        for i in range(ORDER, len(data)):
            for o in range(ORDER + 1):
                seen = counts.setdefault(data[i - o : i], {})
                seen[data[i]] = seen.get(data[i], 0) + 1
    data, bits = PAD * ORDER + (text or "").encode().lower(), 0.0
    for i in range(ORDER, len(data)):
        for o in range(ORDER, -1, -1):
            seen = counts.get(data[i - o : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += math.log2(total / seen[data[i]])
                break
            bits += math.log2(total / len(seen))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["", None, "the", "Das Haus", "où", "\x00\xff", *("".join(rng.choice("aehtns üé.") for _ in range(60)) for _ in range(10))]
    want = [[_exact(lang, t) for lang in sorted(TEXTS)] for t in texts]
    trees = _trees(spark)
    assert code_lengths(trees, texts) == pytest.approx(np.array(want), rel=1e-5, abs=1e-3)
    monkeypatch.setattr(language, "CHUNK", 1)
    long = " ".join(t for t in texts if t) * 60  # in pieces of 4096 bytes
    assert code_lengths(trees, [long])[0] == pytest.approx([_exact(lang, long) for lang in sorted(TEXTS)], rel=1e-5)


def test_predictions_and_their_limits(spark):
    rows = [(1, "the dog and the cat"), (2, "der große hund"), (3, "la table est là"), (4, None), (5, ""), (6, "12 34 !?"), (7, "the " * 50000)]
    docs = spark.createDataFrame([(*r, "mine", 0.5) for r in rows], "doc_id bigint, text string, told string, score double")
    got = {r["doc_id"]: r for r in predict(docs, _trees(spark)).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 8)] == ["en", "de", "fr", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 and r["told"] == "mine" for r in got.values())
    assert got[4]["score"] == got[6]["score"] == 0


def test_learns_from_the_documents_that_are_not_held_out(spark):
    rows = [(i, TEXTS[lang][i % 3], lang) for i in range(300) for lang in [sorted(TEXTS)[i % 3]]]
    rows += [(1000, None, "en"), (1001, "no language", None), (None, "ohne nummer", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    # Held-out rows carry a language of their own; it must not be learned.
    marked = docs.withColumn("held", held_out()).selectExpr("doc_id", "text", "CASE WHEN held THEN 'zz' ELSE lang END AS lang")
    trees = learn_from_documents(marked)
    assert trees["langs"] == ["de", "en", "fr"]
    got = predict(docs, learn_from_documents(docs, 20)).where("lang IS NOT NULL AND text IS NOT NULL").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    trees = learn_from_documents(docs)
    assert trees["langs"] == [] and predict(docs, trees).count() == 0
    some = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    assert [(r["lang_pred"], r["score"]) for r in predict(some, trees).collect()] == [("und", 0.0)]


def test_every_label_is_learned(spark):
    """600 labels, each with letters of its own; tables of eight give the code lengths of one table for all."""
    def said(i, k):
        return " ".join(chr(0x4E00 + 7 * i + (k + j) % 7) * 2 for j in range(9))

    rows = [(i * 10 + k, said(i, k), f"l{i:03}") for i in range(600) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8)
    trees = learn_from_documents(docs)
    known = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert trees["langs"] == sorted(known) and len(known) > 590
    got = predict(docs.where("doc_id % 10 = 0"), trees).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] in known)


def test_groups_of_any_size_give_the_same(spark, monkeypatch):
    texts = ["the große chat", "où", "", None, "x" * 5000]
    want = code_lengths(_trees(spark), texts)
    for size in (1, 2):
        monkeypatch.setattr(language, "GROUP", size)
        assert code_lengths(_trees(spark), texts) == pytest.approx(want, rel=1e-6)


def test_sampled_bytes_are_bounded(spark):
    rows = [(i, TEXTS["en"][0] * 100, "en") for i in range(1, 200)] + [(i, TEXTS["de"][0], "de") for i in range(200, 260)]
    labelled = spark.createDataFrame(rows, "id bigint, text string, lang string")

    def learned(limit):
        # The cost of leaving the empty context grows with the bytes counted.
        return learn_trees(spark, labelled, 400, limit)["groups"][0]["escapes"][0][1][0]

    few, many = learned(10_000), learned(1 << 30)
    assert few[1] < many[1] and few[0] == many[0]
