"""Readers of sentence-pair files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.text import strip
from pairloom.workspace import materialize

# A pair id holds the number of its source above bit 56 and the position within it below.
_SOURCE_SHIFT = 56


def _with_pair_id(df: DataFrame, source_no: int) -> DataFrame:
    pair_id = F.monotonically_increasing_id() + F.lit(source_no << _SOURCE_SHIFT)
    return df.select(pair_id.alias("pair_id"), *df.columns)


_BLOCK_BITS = 13  # 8,192 lines at most


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): lines in the order of ``at`` within their block, blocks in order within their file.

    A block is a stretch of lines of what one task reads of a file, as all lines
    of a block meet in one task again.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    stretch = F.struct("start", F.shiftright("at", _BLOCK_BITS).alias("stretch"))
    return lines.select("file", stretch.alias("block"), "at", "line")


# A quoted field goes on to its closing quote, two quotes in it are one; what then comes before the comma
# belongs to it as it stands. Anywhere else a quote is a character like others. Possessive throughout: the
# patterns run through a line once and need no stack, however long it is.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'
# Lines that end inside of a quoted field: such that begin at a field, and such that begin inside of one.
_OPENS = rf'\A(?:{_FIELD},)*+"{_INSIDE}\z'
_STAYS_OPEN = rf'\A{_INSIDE}(?:\z|"[^,]*+,(?:{_FIELD},)*+"{_INSIDE}\z)'


def _opens(text: Column) -> Column:
    return F.contains(text, F.lit('"')) & F.rlike(text, F.lit(_OPENS))


def _with_states(lines: DataFrame) -> DataFrame:
    """Adds ``inside``: whether a line begins inside of a quoted field.

    At a line's end the automaton of a CSV reader is in one of two states,
    before a record or inside quotes, so a line is a map of two states into
    two: both kept, both to one (set), or both exchanged (flip). The state after any
    stretch is that of its last set, exchanged by the flips after it. A block
    of a file is summed up as one such map and only these are composed over a
    file, so a large file is as many tasks as it has blocks.
    """
    opens, stays = _opens(F.col("line")), ~F.contains("line", F.lit('"')) | F.rlike("line", F.lit(_STAYS_OPEN))
    lines = lines.withColumns({"from_start": opens, "from_inside": stays})
    lines = lines.withColumns(
        {
            "set": F.when(F.col("from_start") == F.col("from_inside"), F.col("from_start")),
            "flip": (F.col("from_start") & ~F.col("from_inside")).cast("int"),
        }
    )

    def after(window, start: Column) -> Column:
        """The state that the rows before lead to, from ``start``."""
        flips = F.coalesce(F.sum("flip").over(window), F.lit(0))
        last = F.last(F.when(F.col("set").isNotNull(), F.struct("set", "flips_to")), ignorenulls=True).over(window)
        odd = (flips - F.coalesce(last["flips_to"], F.lit(0))) % 2 == 1
        return F.coalesce(last["set"], start) != odd

    in_block = Window.partitionBy("file", "block").orderBy("at")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("flips_to", F.sum("flip").over(so_far))
    blocks = lines.groupBy("file", "block").agg(
        F.max_by("set", F.when(F.col("set").isNotNull(), F.col("at"))).alias("set"), F.sum("flip").alias("flip"),
        F.max(F.when(F.col("set").isNotNull(), F.struct("at", "flips_to")))["flips_to"].alias("flips_to_set"),
    )
    # A block that sets the state flips it by what comes after; its flips up to there play no part.
    blocks = blocks.withColumns(
        {
            "set": F.col("set") != ((F.col("flip") - F.col("flips_to_set")) % 2 == 1),
            "flip": F.when(F.col("set").isNull(), F.col("flip")).otherwise(0),
        }
    )
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("flips_to", F.sum("flip").over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", after(earlier, F.lit(False)).alias("block_inside"))
    lines = lines.join(blocks, ["file", "block"])
    return lines.withColumn("inside", after(in_block.rowsBetween(Window.unboundedPreceding, -1), F.col("block_inside")))


def _joined_records(lines: DataFrame) -> DataFrame:
    """Lines joined to records where quoted fields hold line breaks; numbered by block, then over the file."""
    lines = _with_states(lines).withColumn("begins", (~F.col("inside")).cast("int"))
    blocks = lines.groupBy("file", "block").agg(F.sum("begins").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("records_before"))
    so_far = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.join(blocks, ["file", "block"]).withColumn("record_no", F.col("records_before") + F.sum("begins").over(so_far))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    return numbered.groupBy("file", "record_no").agg(
        F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("record"), F.min(F.struct("block", "at")).alias("place")
    ).select("file", "place", "record")


def _filled(record: str) -> Column:
    return F.btrim(F.col(record), F.lit(" \t")) != ""


def _headed_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, place, record) of CSV files without blank lines, and (file, head, head_place).

    One scan tells for every file its first line and whether any line ends
    inside of quotes. Only files with such a line are put together from their
    lines, and written, as both results need them.
    """
    lines = _lines(spark, path)
    place = F.struct("block", "at")
    files = lines.groupBy("file").agg(
        F.max(_opens(F.col("line"))).alias("broken"),
        F.min_by(F.struct(F.col("line").alias("head"), place.alias("head_place")), F.when(_filled("line"), place)).alias("first"),
    )
    files = materialize(files, "csv-files")
    broken = files.where("broken").select("file")
    plain = files.where("NOT broken AND first IS NOT NULL").select("file", "first.head", "first.head_place")
    records = lines.join(broken, "file", "left_anti").select("file", place.alias("place"), F.col("line").alias("record"))
    if broken.isEmpty():
        return records.where(_filled("record")), plain
    joined = _joined_records(lines.join(broken, "file", "left_semi")).where(_filled("record"))
    joined = materialize(joined.sortWithinPartitions("file", "place"), "csv-records")
    first = joined.groupBy("file").agg(F.min(F.struct("place", "record")).alias("first"))
    heads = plain.unionByName(first.select("file", F.col("first.record").alias("head"), F.col("first.place").alias("head_place")))
    return records.where(_filled("record")).unionByName(joined), materialize(heads, "csv-heads")


def _fields(record: Column) -> Column:
    """The fields of a record; an empty one without quotes is null."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf',("{_INSIDE}(?:"[^,]*+)?+|[^",][^,]*+|)'), F.lit(1))
    quoted = rf'(?s)\A"({_INSIDE})"?+(.*)\z'

    def value(field: Column) -> Column:
        inside = F.replace(F.regexp_extract(field, quoted, 1), F.lit('""'), F.lit('"'))
        plain = F.when(field != "", field)
        return F.when(F.startswith(field, F.lit('"')), F.concat(inside, F.regexp_extract(field, quoted, 2))).otherwise(plain)

    return F.transform(found, value)


def read_pairs_csv(
    spark: SparkSession, path: str, source_no: int = 0, keep_malformed: bool = False
) -> DataFrame:
    """CSV files with a header naming at least ``en`` and ``vi``; every other column is kept.

    Each file has its own header, which may name the columns in another order
    or have others. Quotes count where a field begins with one; anywhere else,
    as in 5" pipe, they are text. Quoted fields may hold line breaks (kept as
    \\n); such files are read by as many tasks as others. Blank lines are left
    out. A record with fewer fields than its header ends in nulls. One with
    more, or whose last quoted field never ends, is not guessed at: it is an
    error, or with ``keep_malformed`` its text is in ``malformed_record``, a
    column that is null for all others, and its fields are null, so that it is
    counted with the pairs that lack a text.
    """
    records, heads = _headed_records(spark, path)
    names = _fields(F.regexp_replace("head", "^\ufeff", "")).alias("names")
    heads = heads.select("file", "head_place", names)
    # As many as there are different headers.
    headers = [row["names"] for row in heads.select("names").distinct().collect()]
    if not headers:
        raise ValueError(f"{path} has no header")
    for header in headers:
        missing = {"en", "vi"} - set(header)
        if missing:
            raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    headers.sort(key=lambda header: [name or "" for name in header])
    columns = list(dict.fromkeys(name for header in headers for name in header if name))
    # An outer join, kept one by the null-safe test: only its right side, a row per file, may ever be broadcast.
    body = records.join(heads, "file", "left").where(~F.col("place").eqNullSafe(F.col("head_place")))
    body = body.withColumn("fields", _fields(F.col("record")))
    body = body.withColumns({"excess": F.size("fields") > F.size("names"), "open": _opens(F.col("record"))})
    excess, open_ = F.col("excess"), F.col("open")
    if keep_malformed:
        fields = F.when(~(excess | open_), F.col("fields"))
        malformed = [F.when(excess | open_, F.col("record")).alias("malformed_record")]
    else:
        too_many = F.raise_error(F.concat(F.lit("more than "), F.size("names").cast("string"), F.lit(" fields: "), "record"))
        unending = F.raise_error(F.concat(F.lit("a quoted field without end: "), "record"))
        fields, malformed = F.when(open_, unending).when(excess, too_many).otherwise(F.col("fields")), []
    body = body.withColumn("fields", fields)
    # All headers in one pass: where a column stands follows from the names of the row's own file.
    values = [F.get("fields", (F.array_position("names", F.lit(c)) - 1).cast("int")).alias(c) for c in columns]
    return _with_pair_id(body.select(*values, *malformed), source_no)


def read_pairs_tsv(spark: SparkSession, path: str, source_no: int = 1) -> DataFrame:
    """Tab-separated lines without a header: the first two fields of each line that has two.

    Lines are stripped first, so a leading tab moves the fields to the left.
    """
    fields = F.split(strip(F.col("value")), "\t")
    df = (
        spark.read.text(path)
        .select(fields.alias("fields"))
        .where(F.size("fields") >= 2)
        .select(F.get("fields", F.lit(0)).alias("en"), F.get("fields", F.lit(1)).alias("vi"))
    )
    return _with_pair_id(df, source_no)


def origin(pair_id: Column, names: list[str]) -> Column:
    """The name of the source a pair came from."""
    return F.get(F.array(*map(F.lit, names)), F.shiftright(pair_id, _SOURCE_SHIFT).cast("int"))
