"""Learning a subword vocabulary from distributed word counts.

The corpus is read once, to count words. Everything after works on distinct
words, whose number grows far slower, and only candidate pairs and the finished
vocabulary, both bounded by settings, ever reach the driver.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.config import SPECIAL_PIECES
from pairloom.functions.text import subword_normalize
from pairloom.operators.segment import merger
from pairloom.workspace import discard, materialize

BLANK = "▁"

# Marks that normalised text cannot hold, as normalisation deletes controls:
# one wraps every symbol of a word, the other flags a user symbol.
WRAP = "\x01"
USER = "\x02"

# Distinct words one task works on in a round.
_WORDS_PER_PART = 200_000


def symbol_pattern(user_symbols: Sequence[str]) -> str:
    """Regular expression of the user symbols, longest first, blanks shown as ``▁``."""
    shown = (s.replace(" ", BLANK) for s in user_symbols)
    return "|".join(re.escape(s) for s in sorted(shown, key=lambda s: (-len(s), s)))


def word_units(text: Column, user_symbols: Sequence[str] = ()) -> Column:
    """Words of normalised text, each led by ``▁``; user symbols stand alone, flagged."""
    shown = F.concat(F.lit(BLANK), F.translate(text, " ", BLANK))
    if not user_symbols:
        return F.split(shown, f"(?={BLANK})")
    marked = F.regexp_replace(shown, f"({symbol_pattern(user_symbols)})", f"{WRAP}{USER}$1{WRAP}")
    parts = F.array_remove(F.split(marked, WRAP), "")
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.when(F.startswith(p, F.lit(USER)), F.array(p)).otherwise(F.split(p, f"(?={BLANK})")),
        )
    )


def word_counts(df: DataFrame, column: str, user_symbols: Sequence[str] = ()) -> DataFrame:
    """Occurrences of every distinct word of a cleaned column: (word, freq)."""
    text = df.select(subword_normalize(F.col(column)).alias("text")).where(F.col("text") != "")
    if user_symbols:
        units = text.select(F.explode(word_units(F.col("text"), user_symbols)).alias("word"))
        return units.groupBy("word").agg(F.count("*").alias("freq"))
    # Every word starts at a blank, so the mark can wait until words are distinct.
    counts = text.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    return counts.select(F.concat(F.lit(BLANK), "word").alias("word"), "freq")


def _wrapped(word: Column) -> Column:
    """A word as single characters, each with the mark on both sides.

    A string costs less to write, compare and search than an array of symbols.
    """
    return F.regexp_replace(word, "(?s).", f"{WRAP}$0{WRAP}")


def _adjacent(words: DataFrame, symbols: str, freq: Column) -> DataFrame:
    # Words of one symbol hold no pair; the double mark in the middle tells.
    split = F.split(F.substring(symbols, F.lit(2), F.length(symbols) - 2), WRAP * 2)
    cut = words.where(F.contains(F.col(symbols), F.lit(WRAP * 2))).select(split.alias("parts"), freq.alias("freq"))
    # A column of its own, as a generator would split once for each mention.
    left, right = (F.slice("parts", F.lit(start), F.size("parts") - 1) for start in (1, 2))
    return cut.select(F.inline(F.arrays_zip(left.alias("l"), right.alias("r"))), "freq")


def _changes(words: DataFrame) -> DataFrame:
    """What merges did to the counts of pairs: those of changed words as they were are taken away, as they are added.

    ``words`` is (before, symbols, freq) with ``before`` null where no merge touched the word.
    """
    touched = words.where(F.col("before").isNotNull())
    gone = _adjacent(touched, "before", -F.col("freq"))
    return gone.unionByName(_adjacent(touched, "symbols", F.col("freq")))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent characters of (word, freq), weighted by word frequency: (l, r, freq)."""
    symbols = words.select(_wrapped(F.col("word")).alias("symbols"), "freq")
    return _adjacent(symbols, "symbols", F.col("freq")).groupBy("l", "r").agg(F.sum("freq").alias("freq"))


def char_counts(words: DataFrame) -> DataFrame:
    """Occurrences of every character of (word, freq): (piece, freq)."""
    chars = words.select(F.explode(F.split("word", "")).alias("piece"), "freq").where(F.col("piece") != "")
    return chars.groupBy("piece").agg(F.sum("freq").alias("freq"))


def top_pieces(pieces: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent pieces; ties by piece."""
    return pieces.orderBy(F.desc("freq"), "piece").limit(k)


def _runs(words: DataFrame, candidates: Sequence[tuple[str, str]]) -> DataFrame:
    """Stretches of symbols in which every adjacent pair is a candidate: (run, freq).

    An Arrow UDF, as nested array functions took twice the time here.
    """
    wanted, wrap = frozenset(candidates), WRAP

    def stretches(words: pa.Array) -> pa.Array:
        rows = []
        for word in words.to_pylist():
            symbols = word[1:-1].split(wrap * 2)
            ends = [i for i, pair in enumerate(zip(symbols, symbols[1:]), 1) if pair not in wanted]
            bounds = zip([0, *ends], [*ends, len(symbols)])
            rows.append([wrap.join(symbols[start:end]) for start, end in bounds if end - start > 1])
        return pa.array(rows, pa.list_(pa.string()))

    runs = F.arrow_udf(stretches, "array<string>").asNondeterministic()("symbols")
    return words.select(F.explode(runs).alias("run"), "freq").groupBy("run").agg(F.sum("freq").alias("freq"))


def _merges_in_runs(runs: list, floor: int, known: set[str], room: int) -> list[tuple[str, str, int]]:
    """Best pair first over the runs, as long as it beats ``floor``; at most ``room`` new pieces."""
    texts = [r.run.split(WRAP) for r in runs]
    count: Counter = Counter()
    places = defaultdict(set)

    def tally(i: int, sign: int) -> list[tuple[str, str]]:
        pairs = list(zip(texts[i], texts[i][1:]))
        for pair in pairs:
            count[pair] += sign * runs[i].freq
            places[pair].add(i)
        return pairs

    for i in range(len(texts)):
        tally(i, 1)
    # Entries go stale when a count changes; the changed count is pushed again.
    queue = [(-n, pair) for pair, n in count.items()]
    heapq.heapify(queue)
    taken, made = [], set()
    while queue and len(made) < room:
        n, pair = heapq.heappop(queue)
        if -n != count[pair] or not n:
            continue
        if -n <= floor and taken:
            break
        piece = "".join(pair)
        if piece in SPECIAL_PIECES:
            continue  # never made of text
        taken.append((*pair, -n))
        if piece in known or piece in made:
            break
        made.add(piece)
        changed, join = set(), merger([pair])
        for i in places.pop(pair):
            changed.update(tally(i, -1))
            texts[i] = join(texts[i])
            changed.update(tally(i, 1))
        for other in changed:
            heapq.heappush(queue, (-count[other], other))
    return taken


def learn_merges(
    words: DataFrame,
    known: set[str],
    max_pieces: int,
    min_freq: int = 1,
    lookahead: int = 64,
    max_lookahead: int = 4096,
    max_run_chars: int = 2_000_000,
) -> list[tuple[str, str, int]]:
    """Byte-pair merges of (word, freq), best pair first, until ``max_pieces`` new pieces exist.

    Gives the merges of the one-by-one procedure, ties to the smaller (l, r),
    but many per round. A pair counted above the ``lookahead``-th best can only
    arise where all adjacent pairs are among the candidates before it. So the
    stretches of candidates, summed over all words by Spark, decide the next
    merges by themselves down to that count. Only if the distinct stretches
    fit in ``max_run_chars`` do they come to the driver; otherwise fewer
    candidates are tried, and a single one needs no stretches. A merge whose
    result exists already ends the round, because its neighbours then also
    occur outside the stretches.
    """
    # Counting may leave few, large parts; the rounds need work for every core.
    parts = max(words.sparkSession.sparkContext.defaultParallelism, words.count() // _WORDS_PER_PART + 1)
    state = words.repartition(parts, "word").select(_wrapped(F.col("word")).alias("symbols"), "freq")
    written: DataFrame | None = None
    merges: list[tuple[str, str, int]] = []
    pieces = set(known)
    pending: list[tuple[str, str, int]] = []
    counts: DataFrame | None = None
    while len(pieces) - len(known) < max_pieces:
        if pending:
            merged = state.withColumn("merged", _apply(F.col("symbols"), pending))
            touched = F.when(F.col("merged") != F.col("symbols"), F.col("symbols"))
            state = merged.select(touched.alias("before"), F.col("merged").alias("symbols"), "freq")
        else:
            state = state.withColumn("before", F.lit(None).cast("string"))
        previous, written = written, materialize(state, "subword-state")
        # Counts of all pairs are taken once; a round recounts only the words that its merges touched.
        moved = _adjacent(written, "symbols", F.col("freq")) if counts is None else counts.unionByName(_changes(written))
        tallied = moved.groupBy("l", "r").agg(F.sum("freq").alias("freq")).where("freq > 0")
        earlier, counts = counts, materialize(tallied, "subword-pairs")
        for table in (previous, earlier):
            if table is not None:
                discard(table)
        # Words down to one symbol can never change again and are left behind.
        state = written.where(F.contains("symbols", F.lit(WRAP * 2))).drop("before")
        # A special piece is never made of text.
        able = counts.where((F.col("freq") >= min_freq) & ~F.concat("l", "r").isin(*SPECIAL_PIECES))
        best = able.orderBy(F.desc("freq"), "l", "r").limit(max_lookahead + 1).collect()
        if not best:
            break
        while True:
            floor = best[lookahead].freq if lookahead < len(best) else min_freq - 1
            chosen = [p for p in best[:lookahead] if p.freq > floor]
            if len(chosen) < 2:
                pending = [(best[0].l, best[0].r, best[0].freq)]
                size = 0
                break
            runs = materialize(_runs(state, [(p.l, p.r) for p in chosen]), "subword-runs")
            size = runs.agg(F.sum(F.length("run"))).first()[0]
            few = size <= max_run_chars
            if few:
                pending = _merges_in_runs(runs.collect(), floor, pieces, max_pieces - (len(pieces) - len(known)))
            discard(runs)
            if few:
                break
            lookahead = len(chosen) // 2
        merges += pending
        pieces.update(l + r for l, r, _ in pending)
        # A round costs a pass over all words, a try too many a part of one; stretches are few after the first merges.
        if size < max_run_chars // 4:
            lookahead = min(lookahead * (8 if size < max_run_chars // 16 else 2), max_lookahead)
    for table in (written, counts):
        if table is not None:
            discard(table)
    return merges


def _apply(symbols: Column, merges: list[tuple[str, str, int]]) -> Column:
    """The merges, in order, on wrapped words: a cost per word that does not grow with the merges."""
    merge = merger([(left, right) for left, right, _ in merges])
    wrap = WRAP

    def apply(words: pa.Array) -> pa.Array:
        split = (w[1:-1].split(wrap * 2) for w in words.to_pylist())
        return pa.array([f"{wrap}{(wrap * 2).join(merge(w))}{wrap}" for w in split], pa.string())

    return F.arrow_udf(apply, "string").asNondeterministic()(symbols)


def learn_bpe(
    words: DataFrame, vocab_size: int = 8000, lang: str = "en", user_symbols: Sequence[str] = (), **options
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and merges of one language from its (word, freq) table.

    The vocabulary holds the four special pieces, the user symbols, the merged
    pieces in the order they were learned and the characters by frequency:
    ``vocab(lang, id, piece, freq, kind)``, ``merges(lang, rank, l, r, freq)``.
    If characters alone overfill it, the rarest are left to the unknown piece.
    It stays smaller than asked for only if no pair occurs ``min_freq`` times.
    """
    spark = words.sparkSession
    users = [s.replace(" ", BLANK) for s in user_symbols]
    room = vocab_size - len(SPECIAL_PIECES) - len(users)
    if set(users) & set(SPECIAL_PIECES):
        raise ValueError("a special piece cannot be a user symbol")
    if room < 0:
        raise ValueError(f"a vocabulary of {vocab_size} has no room for {len(users)} user symbols")
    words = materialize(words, "subword-words")
    is_user = F.startswith("word", F.lit(USER))
    plain = words.where(~is_user)
    user_freq = {r.word[1:]: r.freq for r in words.where(is_user).collect()} if users else {}
    chars = top_pieces(char_counts(plain), room).collect()
    known = {c.piece for c in chars} | set(users)
    merges = learn_merges(plain, known, room - len(chars), **options)
    discard(words)

    rows = [(p, 0, "special") for p in SPECIAL_PIECES]
    rows += [(s, user_freq.get(s, 0), "user") for s in users]
    merged: dict[str, int] = {}
    for left, right, freq in merges:
        if left + right not in known:
            merged.setdefault(left + right, freq)
    rows += [(p, n, "merge") for p, n in merged.items()]
    rows += [(c.piece, c.freq, "char") for c in chars]
    vocab = spark.createDataFrame(
        [(lang, i, *row) for i, row in enumerate(rows)],
        "lang string, id int, piece string, freq bigint, kind string",
    )
    table = spark.createDataFrame(
        [(lang, i, *m) for i, m in enumerate(merges)],
        "lang string, rank int, l string, r string, freq bigint",
    )
    return vocab, table


def vocab_size(vocab: DataFrame) -> DataFrame:
    """Pieces per language."""
    return vocab.groupBy("lang").agg(F.count("*").alias("n_pieces"))
