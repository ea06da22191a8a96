"""Text to piece ids and back."""

from __future__ import annotations

import json
import re
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.config import SPECIAL_PIECES, UNK
from pairloom.functions.ids import cut_at_eos, drop_special_ids, pieces_to_text, wrap_truncate
from pairloom.functions.text import subword_normalize
from pairloom.operators.segment import merger
from pairloom.operators.subword import BLANK, USER, symbol_pattern

# Distinct words one task remembers, and their most characters; the longest known leave first. Frequent
# words come back soon, so more of them would only hold the rare ones, in every worker of an executor.
_CACHED_WORDS = 1 << 15
_CACHED_CHARS = 64


@dataclass(frozen=True)
class SubwordModel:
    """One language's pieces by id, its merges and its user symbols."""

    pieces: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]
    user_symbols: tuple[str, ...] = ()


def load_model(vocab: DataFrame, merges: DataFrame, lang: str) -> SubwordModel:
    """The model of one language from the vocabulary tables, which have the size asked for when learning.

    ``lookup_ids`` and ``lookup_pieces`` need no model: they join the tables.
    """
    rows = vocab.where(F.col("lang") == lang).orderBy("id").collect()
    if [r.id for r in rows] != list(range(len(rows))):
        raise ValueError(f"the ids of {lang} are not 0..{len(rows) - 1}")
    ranked = merges.where(F.col("lang") == lang).orderBy("rank").collect()
    return SubwordModel(
        tuple(r.piece for r in rows),
        tuple((r.l, r.r) for r in ranked),
        tuple(r.piece for r in rows if r.kind == "user"),
    )


def segment_words(words: DataFrame, model: SubwordModel) -> DataFrame:
    """Adds ``pieces`` to a table with distinct ``word`` values."""
    merge = merger(model.merges)
    user = USER

    def segment(words: pa.Array) -> pa.Array:
        cut = [[w[1:]] if w.startswith(user) else merge(list(w)) for w in words.to_pylist()]
        return pa.array(cut, pa.list_(pa.string()))

    return words.withColumn("pieces", F.arrow_udf(segment, "array<string>").asNondeterministic()("word"))


def lookup_ids(pieces: DataFrame, vocab: DataFrame, lang: str) -> DataFrame:
    """Adds ``id`` to a table with a ``piece`` column; a piece not in the vocabulary gets the unknown id.

    Text never gets the id of a special piece, even if it reads like one.
    """
    ids = vocab.where((F.col("lang") == lang) & (F.col("kind") != "special")).select("piece", "id")
    return pieces.join(ids, "piece", "left").withColumn("id", F.coalesce("id", F.lit(UNK)))


def lookup_pieces(ids: DataFrame, vocab: DataFrame, lang: str) -> DataFrame:
    """Adds ``piece`` to a table with an ``id`` column."""
    pieces = vocab.where(F.col("lang") == lang).select("id", "piece")
    return ids.join(pieces, "id", "left")


def _encoder(model: SubwordModel):
    """An Arrow UDF from normalised text to ids, cutting text where ``word_units`` does."""
    merge = merger(model.merges)
    special = len(SPECIAL_PIECES)  # their ids never come from text
    ids = {piece: i for i, piece in enumerate(model.pieces[special:], special)}
    symbols = symbol_pattern(model.user_symbols)
    blank, unk, limit, longest = BLANK, UNK, _CACHED_WORDS, _CACHED_CHARS
    seen: OrderedDict[str, array] = OrderedDict()

    def of_word(word: str) -> array:
        found = seen.get(word)
        if found is None:
            found = array("i", [ids.get(p, unk) for p in merge(list(word))])
            if len(word) <= longest:
                seen[word] = found
            if len(seen) > limit:
                seen.popitem(last=False)
        return found

    def of_text(text: str, pattern) -> Iterator[array]:
        shown = blank + text.replace(" ", blank)
        for i, part in enumerate(pattern.split(shown) if pattern else [shown]):
            if i % 2:
                yield array("i", [ids.get(part, unk)])
                continue
            head, *words = part.split(blank)
            if head:
                yield of_word(head)
            for word in words:
                yield of_word(blank + word)

    def encode(texts: pa.Array) -> pa.Array:
        pattern = re.compile(f"({symbols})") if symbols else None
        values, offsets = array("i"), array("i", [0])
        for text in texts.to_pylist():
            if text:
                for word in of_text(text, pattern):
                    values.extend(word)
            offsets.append(len(values))
        flat = pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values)])
        ends = pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)])
        return pa.ListArray.from_arrays(ends, flat, mask=texts.is_null())

    return F.arrow_udf(encode, "array<int>").asNondeterministic()


def encode_text(text: Column, model: SubwordModel) -> Column:
    """Ids of the pieces of cleaned text, without begin and end marks.

    Works row by row inside the scan's tasks: no shuffle of tokens, hence no
    hot word. A task cuts each distinct word once while it stays in its cache.
    """
    return _encoder(model)(subword_normalize(text))


def encode_pairs(df: DataFrame, src_model: SubwordModel, tgt_model: SubwordModel, max_len: int = 128) -> DataFrame:
    """Adds ids with marks and their number for ``src`` and ``tgt``, cut to ``max_len``."""
    ids = df.withColumns(
        {"src_ids": encode_text(F.col("src"), src_model), "tgt_ids": encode_text(F.col("tgt"), tgt_model)}
    )
    ids = ids.withColumns(
        {"src_ids": wrap_truncate(F.col("src_ids"), max_len), "tgt_ids": wrap_truncate(F.col("tgt_ids"), max_len)}
    )
    return ids.withColumns({"src_len": F.size("src_ids"), "tgt_len": F.size("tgt_ids")})


def ids_to_pieces(ids: Column, model: SubwordModel) -> Column:
    """Pieces of ids, read from one constant array."""
    table = F.from_json(F.lit(json.dumps(model.pieces)), "array<string>")  # folded to a literal
    return F.transform(ids, lambda i: F.get(table, i))


def decode_ids(ids: Column, model: SubwordModel, stop_at_eos: bool = True) -> Column:
    """Text of ids: up to the first end mark, special ids left out."""
    kept = cut_at_eos(ids) if stop_at_eos else ids
    return pieces_to_text(ids_to_pieces(drop_special_ids(kept), model))
