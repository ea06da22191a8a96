import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.llm.importance import _reader, bucket_counts, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _buckets(text, longest, buckets):
    words = _words(text)
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs]


def _expected(rows, target, longest=1, buckets=10_000, least=20, share=10):
    found = {row: _buckets(row[1], longest, buckets) for row in rows}
    s, t = Counter(b for row in rows for b in found[row]), Counter(b for text in target for b in _buckets(text, longest, buckets))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for row in rows:
        weight = sum(gain[b] for b in found[row]) // len(found[row]) if found[row] else 0
        h = int(hashlib.sha256(f"2024:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16)
        out.append((row[0], len(found[row]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(_words(row[1]))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {r[:4]: k for k, r in reversed(list(enumerate(able[: len(able) * share // 100], 1)))}
    return out, drawn


TEXTS = ["The cat sat on the mat, the END. " * 3, "der hund und die katze " * 6, "Ünïcode ΣΊΣΥΦΟΣ 数学 café 123 " * 7, "a\x00b_c-d9 " * 9, "", None, "!!", "one two"]


def _rows(n=300):
    return [(i, TEXTS[i % 8] if i % 8 > 3 else TEXTS[i % 8] + f" w{i} w{i * i}") for i in range(n)]


@pytest.mark.parametrize("longest", [1, 3])
def test_weights_scores_and_ranks(spark, longest):
    rows = _rows() + [(7000, "long words " * 60_000 + "x" * 70_000)]
    target = ["the cat and the dog", "数学 café", None, ""]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    docs = docs.withColumns({c: F.lit(c) for c in ("id", "w", "score", "rank", "low", "n_words", "weight", "bucket")})
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(docs, bench, max_words=longest).collect()
    expected, drawn = _expected(rows, target, longest)
    assert sorted(tuple(r)[:4] for r in got) == sorted(r[:4] for r in expected)
    assert {tuple(r)[:4]: r["rank"] for r in got if r["rank"]} == drawn and len(drawn) >= 15
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_ties_repeated_rows_and_null_ids(spark):
    rows = [(3, TEXTS[0]), (3, TEXTS[0]), (None, TEXTS[1]), (None, TEXTS[1]), (5, TEXTS[0]), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = resample(docs, docs.limit(0), share_percent=100).collect()
    expected, _ = _expected(rows, [], share=100)
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in expected), key=str)
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    ranks = [r["rank"] for r in got if r["id"] == 3]
    assert abs(ranks[0] - ranks[1]) == 1 and [r["rank"] for r in got if r["id"] == 6] == [None]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert resample(docs.limit(0), docs).count() == 0
    assert resample(docs.limit(0), docs.limit(0)).count() == 0
    assert bucket_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a", "A b", "ünï cödé x" * 50, " ".join("w" * k for k in range(1, 200))])
def test_stretches_from_two_prefixes_have_their_crc(text):
    found, n = _reader(4, 1 << 32)(text)
    assert found.tolist() == _buckets(text, 4, 1 << 32) and n == len(_words(text))
