"""Column functions on text: normalising, cleaning, scoring tokens.

Everything but Unicode normalisation is a built-in expression. Normalisation
has none in Spark, so it runs in an Arrow UDF over whole column batches, and
only rows that may change are handed to it: the others travel as nulls. The
UDF is declared non-deterministic to keep Catalyst from copying it into the
filters above, where it would run a second time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.terms import VIETNAMESE_TERMS

# What Python's \s matches: the Unicode white space plus the four separators.
_SPACE_RUN = r"(?U)[\s\x1C-\x1F]+"

# Runs that are not a single blank already, so that tidy text is left as it is.
_UNEVEN_SPACE = r"(?U) [\s\x1C-\x1F]+|[\s\x1C-\x1F&&[^ ]][\s\x1C-\x1F]*"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)

# Code points that canonical composition never changes, alone or next to each
# other: no combining mark, nothing that composes with a neighbour.
_NFC_STABLE = r"\x{0000}-\x{02FF}\x{0400}-\x{0482}\x{1E00}-\x{1EFF}\x{2010}-\x{2027}\x{20A0}-\x{20C0}\x{4E00}-\x{9FFF}"

# The same for the compatibility form after control removal; narrower.
_NFKC_STABLE = r"\x{0020}-\x{007E}\x{00C0}-\x{0131}\x{0400}-\x{0482}\x{1EA0}-\x{1EFF}\x{2018}-\x{201D}\x{4E00}-\x{9FFF}"

# Fixed values of the subword normalisation rule: code points it turns into a
# blank, controls it deletes, and one it leaves alone.
_BLANKED = "\t\n\x0c\r\u1680\u200b\u200c\u200e\u200f\u2028\u2029\u2581\ufeff\ufffd"
_DELETED = (
    "\x01\x02\x03\x04\x05\x06\x07\x08\x0b\x0e\x0f\x10\x11\x12\x13\x14\x15\x16"
    "\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f\x7f\x8f\x9f"
)
_KEPT = "～"


def _normalizer(form: str, kept: str | None = None):
    """An Arrow UDF to a Unicode normal form; ``kept`` passes through as it is."""

    def normalize(texts: pa.Array) -> pa.Array:
        from unicodedata import normalize as to_form

        def one(text: str) -> str:
            if kept and kept in text:
                return kept.join(to_form(form, part) for part in text.split(kept))
            return to_form(form, text)

        return pa.array([text if text is None else one(text) for text in texts.to_pylist()], pa.string())

    return F.arrow_udf(normalize, "string").asNondeterministic()


def _outside(ranges: str) -> str:
    """The class of characters in none of the ranges.

    An intersection ends at the first range that holds a character, mostly the
    first of all; one negated class of all ranges took ten times the time.
    """
    single = re.findall(r"\\x\{\w+\}-\\x\{\w+\}", ranges)
    return f"[{'&&'.join(f'[^{r}]' for r in single)}]"


def nfc(text: Column) -> Column:
    """Canonical composition."""
    unstable = (F.octet_length(text) > F.length(text)) & text.rlike(_outside(_NFC_STABLE))
    return F.coalesce(_normalizer("NFC")(F.when(unstable, text)), text)


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.trim(text, F.lit(_SPACES))


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank; none at either end."""
    return F.trim(F.regexp_replace(text, _UNEVEN_SPACE, " "))


# Fixed value: the pattern that finds wrapped terms again.
_WRAPPED = "__(.+?)__"


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def protect_terms(text: Column, terms: Sequence[str] = VIETNAMESE_TERMS, mode: str = "safe") -> Column:
    """Wrap every term as ``__a_b__`` and unwrap again.

    The unwrapped text should equal the input, and in ``safe`` mode does. Where
    one term holds another the second wrapping nests in the first and the
    non-greedy unwrapping leaves debris, as it does for a literal ``__x__``;
    ``exact`` mode gives that text, for results that must agree with it.
    """
    if mode == "safe":
        return text
    wrapped = text
    for term in terms:
        wrapped = F.replace(wrapped, F.lit(term), F.lit(f"__{term.replace(' ', '_')}__"))

    def unwrap(text: Column) -> Column:
        outside = F.split(text, _WRAPPED, -1)
        inside = F.regexp_extract_all(text, F.lit(_WRAPPED), F.lit(1))
        return F.array_join(
            F.zip_with(
                outside,
                inside,
                lambda plain, term: F.concat(plain, F.coalesce(F.translate(term, "_", " "), F.lit(""))),
            ),
            "",
        )

    return _let(wrapped, lambda t: F.when(F.contains(t, F.lit("__")), unwrap(t)).otherwise(t))


def clean(
    text: Column,
    is_target: bool = False,
    terms: Sequence[str] = VIETNAMESE_TERMS,
    mode: str = "safe",
) -> Column:
    """Compose, squeeze and, on the target side, pass through ``protect_terms``."""
    text = squeeze(nfc(text))
    return protect_terms(text, terms, mode) if is_target else text


def subword_normalize(text: Column) -> Column:
    """Text as the subword learner sees it: no controls, compatibility forms folded."""
    ascii_only = F.octet_length(text) == F.length(text)
    unstable = F.when(ascii_only, text.rlike(r"[\x01-\x1F\x7F]")).otherwise(text.rlike(_outside(_NFKC_STABLE)))
    # translate() deletes what has no counterpart in its last argument.
    plain = F.translate(text, _BLANKED + _DELETED, " " * len(_BLANKED))
    text = F.coalesce(_normalizer("NFKC", _KEPT)(F.when(unstable, plain)), text)
    return F.trim(F.regexp_replace(text, "  +", " "))


def tokenize_13a(text: Column) -> Column:
    """Tokens of the mteval-v13a rules, as an array."""
    text = F.rtrim(text, F.lit(_SPACES))
    text = F.replace(text, F.lit("<skipped>"), F.lit(""))
    text = F.replace(text, F.lit("-\n"), F.lit(""))
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    # Every ASCII mark but ' , - . stands alone. Listed one by one, the class
    # compiles to a bit set; blanks are left out, as they need no padding.
    text = F.regexp_replace(text, r"[!\"#$%&()*+/:;<=>?@\[\\\]^_`{|}~]", " $0 ")
    text = F.regexp_replace(text, r"([^0-9])([.,])", "$1 $2 ")
    text = F.regexp_replace(text, r"([.,])([^0-9])", " $1 $2")
    text = F.regexp_replace(text, r"([0-9])(-)", "$1 $2 ")
    return F.array_remove(F.split(text, _SPACE_RUN), "")


def chunks_13a():
    """The same rules as two functions, for work that is done in Python anyway: from a text to its chunks
    without white space, and from a chunk to its tokens.

    The rules look past a chunk at the white space next to it only, which is no
    digit whatever it is; so chunks, most of which are frequent words, can be
    remembered. Closures over compiled patterns, so that they travel with a task.
    """
    marks = re.compile(r"([!\"#$%&()*+/:;<=>?@\[\\\]^_`{|}~])")
    before, after = re.compile(r"([^0-9])([.,])"), re.compile(r"([.,])([^0-9])")
    dash, entities = re.compile(r"([0-9])(-)"), (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
    spaces = _SPACES

    def chunks(text: str) -> list[str]:
        return text.rstrip(spaces).replace("<skipped>", "").replace("-\n", "").split()

    def tokens(chunk: str) -> list[str]:
        if chunk.isalnum():
            return [chunk]
        if "&" in chunk:
            for entity, char in entities:
                chunk = chunk.replace(entity, char)
        text = marks.sub(r" \1 ", f" {chunk} ")
        if "." in text or "," in text:
            text = after.sub(r" \1 \2", before.sub(r"\1 \2 ", text))
        if "-" in text:
            text = dash.sub(r"\1 \2 ", text)
        return text.split()

    return chunks, tokens


def tokenizer_13a():
    """Both in one: from a text to its tokens."""
    chunks, tokens = chunks_13a()
    return lambda text: [token for chunk in chunks(text) for token in tokens(chunk)]
