import csv
import io
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.operators.runs import compare_epochs, compare_translations
from pairloom.operators.subword import learn_bpe
from pairloom.sources import pairs, tables
from pairloom.workspace import discard, materialize, shared_dir


def test_csv(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text('en,vi,topic\n"say ""hi"", now",chào,x\n"two\nlines",hai,\nnull,None,y\n', encoding="utf-8")
    got = [(r.en, r.vi, r.topic) for r in pairs.read_pairs_csv(spark, str(path)).orderBy("pair_id").collect()]
    assert got == [('say "hi", now', "chào", "x"), ("two\nlines", "hai", None), ("null", "None", "y")]


def test_plain_csv_is_split(spark, tmp_path):
    lines = ["en,vi", *(f'"say ""{i}""",câu {i}' for i in range(200_000))]
    (tmp_path / "plain.csv").write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        df = pairs.read_pairs_csv(spark, str(tmp_path / "plain.csv"))
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert df.select("pair_id").distinct().count() == 200_000
        assert df.where('en = \'say "199999"\' and vi = \'câu 199999\'').count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_needs_both_columns(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text("en,other\na,b\n")
    with pytest.raises(ValueError, match="vi"):
        pairs.read_pairs_csv(spark, str(path))


def test_tsv(spark, tmp_path):
    path = tmp_path / "pairs.txt"
    path.write_text("a\tb\tc\na\n\ta\tb\n  x y \tz \n\u3000p\tq\x1c\r\nm\t\tn\n", encoding="utf-8")
    rows = pairs.read_pairs_tsv(spark, str(path)).orderBy("pair_id").collect()
    assert [(r.en, r.vi) for r in rows] == [("a", "b"), ("a", "b"), ("x y ", "z"), ("p", "q"), ("m", "")]


def test_ids_are_unique_and_name_their_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("en,vi\na,b\nc,d\n")
    (tmp_path / "b.txt").write_text("a\tb\nc\td\n")
    both = pairs.read_pairs_csv(spark, str(tmp_path / "a.csv")).unionByName(
        pairs.read_pairs_tsv(spark, str(tmp_path / "b.txt"))
    )
    rows = both.withColumn("origin", pairs.origin(F.col("pair_id"), ["csv", "tsv"])).collect()
    assert len({r.pair_id for r in rows}) == 4
    assert sorted(r.origin for r in rows) == ["csv", "csv", "tsv", "tsv"]


def test_corpus_text(spark, tmp_path):
    df = spark.createDataFrame([("một",), ("hai ba",)], "t string")
    tables.write_corpus_text(df, "t", str(tmp_path / "c"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ["hai ba", "một"]


def test_splits_round_trip_and_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, "null", "train"), (2, "NA", "val"), (3, "", "test")], "pair_id bigint, en string, split string")
    tables.write_splits(df, str(tmp_path / "s"))
    assert [(r.pair_id, r.en) for r in tables.read_splits(spark, str(tmp_path / "s"), "val").collect()] == [(2, "NA")]
    assert tables.read_splits(spark, str(tmp_path / "s")).count() == 3
    plan = tables.read_splits(spark, str(tmp_path / "s"), "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_vocab_round_trip(spark, tmp_path):
    vocab = spark.createDataFrame([("en", 0, "<pad>", 0, "special"), ("vi", 4, "▁a", 7, "merge")], "lang string, id int, piece string, freq bigint, kind string")
    merges = spark.createDataFrame([("vi", 0, "▁", "a", 7)], "lang string, rank int, l string, r string, freq bigint")
    tables.write_vocab(vocab, merges, str(tmp_path / "v"))
    again, ranked = tables.read_vocab(spark, str(tmp_path / "v"))
    assert again.schema == vocab.schema and ranked.schema == merges.schema
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, vocab.collect()))
    assert ranked.collect() == merges.collect()


def test_comparison_files(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25), ("a", 2, 0.4)], "run string, epoch int, val_loss double")
    tables.write_epoch_comparison(compare_epochs(log, "a", "b"), str(tmp_path / "e"))
    got = spark.read.option("header", True).csv(str(tmp_path / "e")).orderBy("epoch").collect()
    assert [tuple(r) for r in got] == [("1", "0.5", "0.25"), ("2", "0.4", None)]
    samples = spark.createDataFrame([(0, 's "q", x', "r", "t")], "sample_id int, source string, reference string, translation string")
    tables.write_translation_comparison(compare_translations(samples, samples, "one", "two"), str(tmp_path / "t"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "t")).first()
    assert (row.source, row.one, row.two) == ('s "q", x', "t", "t")


def test_materialize_uses_the_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.array(F.col("id")))
    kept = materialize(df, "numbers")
    assert kept.dtypes == df.dtypes and kept.count() == 10
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert kept.inputFiles()[0].startswith("file://" + shared_dir(spark))


def test_discard_removes_only_its_table(spark, tmp_path):
    folder = Path(shared_dir(spark))
    kept, gone = materialize(spark.range(3), "kept"), materialize(spark.range(3), "gone")
    discard(gone)
    assert not list(folder.glob("gone-*")) and kept.count() == 3
    spark.range(3).write.parquet(str(tmp_path / "other"))
    other = spark.read.parquet(str(tmp_path / "other"))
    discard(other)
    assert other.count() == 3


def test_learning_leaves_no_tables_behind(spark):
    table = spark.createDataFrame([("▁abab", 3), ("▁ab", 2)], "word string, freq bigint")
    vocab, merges = learn_bpe(table, 20)
    assert vocab.count() > 4 and merges.count() > 0
    assert not list(Path(shared_dir(spark)).glob("subword-*"))


def test_csv_files_have_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text('en,vi\nq,one\n"x, y","two\nlines ""q"""\n\nq,one, two\nshort\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('vi,topic,en\nV,t,E\n"V\n2",,"E,2"\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("en,vi\n", encoding="utf-8")
    rows = pairs.read_pairs_csv(spark, str(tmp_path), keep_malformed=True).collect()
    assert sorted(((r.en, r.vi, r.topic, r.malformed_record) for r in rows), key=str) == sorted(
        [
            ("q", "one", None, None), ("x, y", 'two\nlines "q"', None, None), (None, None, None, "q,one, two"),
            ("short", None, None, None), ("E", "V", "t", None), ("E,2", "V\n2", None, None),
        ],
        key=str,
    )
    with pytest.raises(Exception, match="more than 2 fields: q,one, two"):
        pairs.read_pairs_csv(spark, str(tmp_path)).collect()


def test_one_file_with_line_breaks_in_fields_is_many_tasks(spark, tmp_path):
    rows = [(f"word {i}\nsecond, {i}", f'say "{i}"\n\n') for i in range(2000)]
    text = "en,vi\n" + "".join('"{}","{}"\n'.format(*(side.replace('"', '""') for side in row)) for row in rows)
    (tmp_path / "one.csv").write_text(text, encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = pairs._lines(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        assert lines.select("task").distinct().count() > 5
        got = pairs.read_pairs_csv(spark, str(tmp_path)).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted((r.en, r.vi) for r in got) == sorted(rows)


def test_discard_of_a_name_with_a_blank(spark):
    table = materialize(spark.range(3), "gone with blank")
    assert table.count() == 3
    discard(table)
    assert not list(Path(shared_dir(spark)).glob("gone with blank-*"))


def test_quotes_within_plain_fields_are_text(spark, tmp_path):
    text = 'en,vi\n5" pipe,ong\na,b\nthe 7" disc,x\nc,d\n"q" tail "x",say "hi"\n"two\nlines, 5"" wide",""\n \t\ne,f"\n"g\n'
    (tmp_path / "inch.csv").write_text('\ufeff' + text + '",h\n', encoding="utf-8")
    want = pd.read_csv(tmp_path / "inch.csv", dtype=str, keep_default_na=False)
    got = [(r.en, r.vi) for r in pairs.read_pairs_csv(spark, str(tmp_path)).orderBy("pair_id").collect()]
    assert got == list(want.itertuples(index=False, name=None)) and len(got) == 8


def test_a_field_that_never_ends_is_malformed(spark, tmp_path):
    (tmp_path / "open.csv").write_text('en,vi\na,b\nc,"d\ne,f\n', encoding="utf-8")
    rows = pairs.read_pairs_csv(spark, str(tmp_path), keep_malformed=True).collect()
    assert {(r.en, r.vi, r.malformed_record) for r in rows} == {("a", "b", None), (None, None, 'c,"d\ne,f')}
    with pytest.raises(Exception, match="without end"):
        pairs.read_pairs_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("block", [7, 31, 100_000])
def test_any_text_in_blocks_of_any_size(spark, tmp_path, block):
    rng = random.Random(block)
    for n in range(6):
        body = "".join(rng.choices(['"', ",", "\n", "a", " ", '""', '","', '"\n"'], [4, 4, 4, 5, 1, 2, 2, 1], k=150 * (n + 1)))
        (tmp_path / f"{n}.csv").write_text("en,vi\n" + body, encoding="utf-8", newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = pairs.read_pairs_csv(spark, str(tmp_path), keep_malformed=True).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    whole = sorted(((r.en or "", r.vi or "") for r in got if r.malformed_record is None))
    want, malformed = [], 0
    for file in tmp_path.glob("*.csv"):
        text = file.read_text(encoding="utf-8")
        rows = _plain_csv(text)
        if rows[-1][-1] is not None:  # the standard reader takes what never ends for ended
            assert [r for r in csv.reader(io.StringIO(text, newline="")) if "".join(r).strip(" ") or len(r) > 1] == [
                r for r in rows if "".join(r).strip(" ") or len(r) > 1
            ]
        for row in rows[1:]:
            malformed += len(row) > 2 or row[-1] is None
            if len(row) <= 2 and row[-1] is not None:
                want.append(tuple((row + [""])[:2]))
    assert whole == sorted(want) and len(whole) > 50
    assert sum(r.malformed_record is not None for r in got) == malformed > 50


def _plain_csv(text):
    """One character at a time: the rows; the last field of a row that never ends is None."""
    rows, row, field, state, line = [], [], "", "start", ""
    for c in text + "\n":
        line += c
        if c == "\n" and state != "inside":
            if line.strip(" \t\n") or len(row) or state == "quote":
                rows.append(row + [field])
            row, field, state, line = [], "", "start", ""
        elif state == "inside":
            state, field = ("quote", field) if c == '"' else (state, field + c)
        elif state == "quote" and c == '"':
            state, field = "inside", field + c
        elif c == ",":
            row, field, state = row + [field], "", "start"
        elif state == "start" and c == '"':
            state = "inside"
        else:
            state, field = "plain", field + c
    if state == "inside":
        rows.append(row + [None])
    return rows


def test_very_long_lines_of_quotes(spark, tmp_path):
    long = '""' * 300_000
    (tmp_path / "long.csv").write_text(f'en,vi\n"{long}",b\n' + "a," + "b" * 10 + '"' * 200_001 + "\nc,d\n", encoding="utf-8")
    rows = pairs.read_pairs_csv(spark, str(tmp_path)).orderBy("pair_id").collect()
    assert [(len(r.en), len(r.vi)) for r in rows] == [(300_000, 1), (1, 200_011), (1, 1)]


def test_states_are_found_in_stretches_of_lines(spark, tmp_path, monkeypatch):
    """all lines of a file's block met in one task; quoted fields reach over many stretches of it."""
    from pairloom.sources import pairs

    rows = [(f'{i}" x', "\n".join(f'"{k}", ' for k in range(i % 9))) for i in range(400)]
    quoted = ['{},"{}"'.format(en, vi.replace('"', '""')) for en, vi in rows]
    (tmp_path / "one.csv").write_text("en,vi\n" + "\n".join(quoted) + "\n")
    monkeypatch.setattr(pairs, "_BLOCK_BITS", 2)
    lines = pairs._lines(spark, str(tmp_path))
    assert lines.groupBy("file", "block").count().agg({"count": "max"}).first()[0] == 4
    read = pairs.read_pairs_csv(spark, str(tmp_path)).select("en", "vi").collect()
    assert sorted(map(tuple, read)) == sorted(rows)
