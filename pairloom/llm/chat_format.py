"""Chat formatting: schema fingerprints choose a declarative mapping to canonical turns, a template writes them.

A record's schema is the set of its nested field paths with their kinds of
value, ``messages[].role:string`` for one. A hash of it looks up the mapping
for that layout. A mapping lists where turns are found and which fields say who
speaks and what; it is data, not code, and new layouts are added as such.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from collections.abc import Mapping as Mapping_
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import read_table

LOSS_ROLES = ("assistant",)


class Mapping(NamedTuple):
    """How one layout turns into turns.

    ``schema``: the field paths that a record has, sorted; a trailing ``?``
    marks one that may be missing. ``turns``: (items, role, text) in order:
    ``items`` is the path of a list, or empty for the record itself; ``role``
    the field of the speaker, or ``=name`` for a fixed one; ``text`` the field
    of the text. ``order``: the field by which listed turns are sorted, if any.
    ``roles``: other names of the canonical roles.
    """

    name: str
    schema: tuple[str, ...]
    turns: tuple[tuple[str, str, str], ...]
    order: str = ""
    roles: tuple[tuple[str, str], ...] = ()


_NAMES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

MAPPINGS = (
    Mapping("turn_rows", ("turns[].role:string", "turns[].text:string", "turns[].turn:number?"), (("turns", "role", "text"),), "turn"),
    Mapping("messages", ("messages[].content:string", "messages[].role:string", "system:string?"),
            (("", "=system", "system"), ("messages", "role", "content"))),
    Mapping("from_value", ("conversations[].from:string", "conversations[].value:string", "system:string?"),
            (("", "=system", "system"), ("conversations", "from", "value")), "", _NAMES),
    Mapping("prompt_completion", ("completion:string", "prompt:string", "system:string?"),
            (("", "=system", "system"), ("", "=user", "prompt"), ("", "=assistant", "completion"))),
    Mapping("prompt_response", ("prompt:string", "response:string", "system:string?"),
            (("", "=system", "system"), ("", "=user", "prompt"), ("", "=assistant", "response"))),
    Mapping("question_answer", ("answer:string", "context:string?", "question:string", "system:string?"),
            (("", "=system", "system"), ("", "=system", "context"), ("", "=user", "question"), ("", "=assistant", "answer"))),
    Mapping("instruction", ("input:string?", "instruction:string", "output:string"),
            (("", "=system", "instruction"), ("", "=user", "input"), ("", "=assistant", "output"))),
)


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "string"


def field_paths(value: Any, at: str = "") -> set[str]:
    """The nested field paths of a record; a null has the paths of no value, an empty list none."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value))
    return {f"{at}:{_kind(value)}"} if value is not None else set()


def fingerprint(paths: Sequence[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(mappings: Sequence[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Mappings by the fingerprints of every schema they take: with and without each field that may be missing."""
    found: dict[str, Mapping] = {}
    for mapping in mappings:
        fixed = [p for p in mapping.schema if not p.endswith("?")]
        free = [p[:-1] for p in mapping.schema if p.endswith("?")]
        for chosen in range(1 << len(free)):
            schema = fingerprint(fixed + [p for i, p in enumerate(free) if chosen >> i & 1])
            if found.setdefault(schema, mapping) is not mapping:
                raise ValueError(f"{mapping.name} and {found[schema].name} take the same schema")
    return found


def null_names(value: Any, at: str = "") -> set[str]:
    """The paths, without a kind, at which a record has a null."""
    if isinstance(value, dict):
        return set().union(*(null_names(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(null_names(v, at + "[]") for v in value))
    return {at} if value is None else set()


def choose(record: dict, known: Mapping_[str, Mapping], mappings: Sequence[Mapping]) -> tuple[str, Mapping | None, dict]:
    """The record's fingerprint, its mapping and the record as the mapping takes it.

    The mapping is that of the fingerprint. If there is none, fields that a
    mapping does not name are ignored, and a null field that it needs is an
    empty text: the mapping whose schema the rest then is, by its fingerprint,
    is taken, of several the one that uses most fields, then the first. A
    record in which all that a mapping needs is null has none.
    """
    paths = field_paths(record)
    schema = fingerprint(paths)
    if schema in known or not paths:
        return schema, known.get(schema), record
    nulls, best = null_names(record), (0, None, record)
    for mapping in mappings:
        needed = {p.partition(":")[0]: p for p in mapping.schema if not p.endswith("?")}
        named = {p.rstrip("?").partition(":")[0] for p in mapping.schema}
        there = {p for p in paths if p.partition(":")[0] in named}
        empty = {name for name in needed if name in nulls}
        whole = fingerprint(there | {needed[name] for name in empty})
        if known.get(whole) is mapping and there & set(needed.values()) and len(there) > best[0]:
            best = (len(there), mapping, {**record, **{name: "" for name in empty if "[]" not in name}})
    return schema, best[1], best[2]


def canonical_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) in order. Fields of the record itself that are missing or null give no turn, in lists they are empty."""
    roles, turns = dict(mapping.roles), []
    for items, role, text in mapping.turns:
        if items:
            listed = record.get(items) or []
            if mapping.order:
                key = mapping.order
                listed = sorted(listed, key=lambda t: (t.get(key) is not None, t.get(key) or 0, t.get("role") or "", t.get("text") or ""))
            for item in listed:
                said = item.get(role) or ""
                turns.append((roles.get(said, said), item.get(text) or ""))
        elif record.get(text) is not None:
            turns.append((role[1:], record[text]))
    return turns


# Control strings of the template; a text may hold them, and the backslash, only behind a backslash.
TURN_OPEN, ROLE_END, TURN_CLOSE = "### ", ":\n", "</turn>\n"
_IN_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_IN_ROLE = re.compile(r"[\\#<:\n]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write(turns: Sequence[tuple[str, str]], loss_roles: Sequence[str] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask: the [start, end) of each text to be learned, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = TURN_OPEN + _IN_ROLE.sub(lambda m: "\\" + m[0], role) + ROLE_END
        body = escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, TURN_CLOSE
        at += len(head) + len(body) + len(TURN_CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything that ``write`` cannot have written is an error."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """(id, schema, mapping, n_turns, formatted, mask) for records in JSON, whatever their layout.

    mask is an array of (start, end). Fields that no mapping names are ignored,
    a null field that a mapping needs is an empty text. A record of unknown
    layout has a null mapping and text, so that its schema can be counted, and is left to the caller, as are null and broken ones,
    whose schema is null too. A record with no value in it has no turn.
    """
    known = registry(mappings)
    empty = fingerprint(())

    @F.pandas_udf("schema string, mapping string, n_turns bigint, formatted string, mask array<struct<start:bigint,end:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["schema", "mapping", "n_turns", "formatted", "mask"]
        for batch in batches:
            rows = []
            for text in batch:
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    rows.append((None, None, None, None, None))
                    continue
                schema, mapping, record = choose(record, known, mappings)
                if mapping is None and schema != empty:
                    rows.append((schema, None, None, None, None))
                    continue
                turns = canonical_turns(record, mapping) if mapping else []
                formatted, spans = write(turns)
                mask = [{"start": a, "end": b} for a, b in spans]
                rows.append((schema, mapping.name if mapping else "empty", len(turns), formatted, mask))
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(n_turns=out["n_turns"].astype("Int64"))

    return records.select(F.col(id_col).alias("id"), run(F.col(record_col)).alias("out")).select("id", "out.*")


def conversation_records(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, record): the rows (id, turn, role, text) of a conversation as one JSON record; null roles and texts are empty.

    A record is one text for a reader to learn from, so its rows come together
    in one place, as one row; the turns of different conversations never do.
    """
    row = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    grouped = turns.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(row).alias("turns"))
    return grouped.select("id", F.to_json(F.struct("turns")).alias("record"))


def checked(formatted: DataFrame) -> DataFrame:
    """Adds what reading ``formatted`` and ``mask`` back gives: turns and learned text as counts and digests."""

    @F.pandas_udf("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def digest(text: str) -> str:
            return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

        for texts, masks in batches:
            rows = []
            for text, mask in zip(texts, masks):
                turns = read_back(text)
                learned = "".join(unescape(text[span["start"] : span["end"]]) for span in mask)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), digest(told), len(learned), digest(learned)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return formatted.withColumn("back", run("formatted", "mask"))


def op3_chat_turns(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    formatted = format_records(conversation_records(turns.unionByName(more)), "id")
    back = checked(formatted.select("id", "formatted", "mask"))
    return back.select(
        F.col("id").alias("conv_id"), "back.n_turns", "back.turns_sha256", "back.loss_chars", "back.loss_sha256",
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
