"""Column functions on arrays of piece ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.config import BOS, EOS, PAD, UNK


def wrap_truncate(ids: Column, max_len: int = 128) -> Column:
    """Begin and end mark around the ids, cut to ``max_len``: a cut sentence loses its end mark."""
    wrapped = F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))
    return F.slice(wrapped, 1, max_len)


def token_length(ids: Column) -> Column:
    return F.size(ids)


def pad_right(ids: Column, width: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), width - F.size(ids)))


def pad_mask(ids: Column) -> Column:
    """True where the id is not padding."""
    return F.transform(ids, lambda i: i != PAD)


def drop_special_ids(ids: Column) -> Column:
    """Ids above the four specials, in order."""
    return F.filter(ids, lambda i: i > max(PAD, UNK, BOS, EOS))


def decoder_input(ids: Column) -> Column:
    """Everything but the last id."""
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def decoder_label(ids: Column) -> Column:
    """Everything but the first id."""
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def cut_at_eos(ids: Column) -> Column:
    """Ids between the leading begin mark, if any, and the first end mark, if any."""
    start = F.when(F.get(ids, F.lit(0)) == BOS, F.lit(2)).otherwise(F.lit(1))
    end = F.array_position(ids, EOS).cast("int")
    stop = F.when(end > 0, end).otherwise(F.size(ids) + 1)
    return F.slice(ids, start, F.greatest(stop - start, F.lit(0)))


def pieces_to_text(pieces: Column) -> Column:
    return F.trim(F.translate(F.array_join(pieces, ""), "▁", " "))
