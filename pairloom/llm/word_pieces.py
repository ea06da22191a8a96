"""Token counts: greedy longest-match word pieces by a linear automaton, without building pieces.

The vocabulary is a trie. A node at which the text cannot go on has a failure
link to the node that stands for what is left after the longest pieces so far
are cut off, and knows how many pieces those are. So every character is looked
at once, and a count is all that is kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import fresh, read_table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"  # stands before each word, as in the vocabulary
CACHED_WORDS = 1 << 17
CACHED_CHARS = 48  # longer words are counted each time


def load_vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(kind(i) for kind in special)]


def build_automaton(pieces: Iterable[str]) -> dict:
    """The automaton as plain containers: ``next`` by (node, character), ``link`` and ``popped`` by node.

    A character that is part of a piece but none itself costs its UTF-8 bytes,
    as does one in no piece; the latter is not in the trie and begins anew.
    """
    children: list[dict[str, int]] = [{}]
    cost: list[int] = [0]  # of a node that ends a piece, else 0

    def insert(piece: str, n: int) -> None:
        node = 0
        for char in piece:
            if char not in children[node]:
                children[node][char] = len(children)
                children.append({})
                cost.append(0)
            node = children[node][char]
        cost[node] = n

    vocabulary = {p for p in pieces if p}
    for piece in sorted(vocabulary):
        insert(piece, 1)
    for char in sorted(set("".join(vocabulary)) - vocabulary):
        insert(char, len(char.encode("utf-8", "surrogatepass")))

    link, popped = [0] * len(children), [0] * len(children)
    waiting = deque([0])
    while waiting:
        parent = waiting.popleft()
        for char, node in children[parent].items():
            waiting.append(node)
            if cost[node]:
                link[node], popped[node] = 0, cost[node]
                continue
            at, n = link[parent], popped[parent]
            while char not in children[at]:  # the root has every character
                n += popped[at]
                at = link[at]
            link[node], popped[node] = children[at][char], n
    return {"next": children, "link": link, "popped": popped}


def count_pieces(automaton: dict, word: str) -> int:
    """How many pieces greedy longest match cuts ``word`` into."""
    children, link, popped = automaton["next"], automaton["link"], automaton["popped"]
    node = n = 0
    for char in word:
        while char not in children[node]:
            if not node:
                n += len(char.encode("utf-8", "surrogatepass"))
                break
            n += popped[node]
            node = link[node]
        else:
            node = children[node][char]
    while node:
        n += popped[node]
        node = link[node]
    return n


def count_tokens(docs: DataFrame, pieces: Iterable[str], text_col: str = "text") -> DataFrame:
    """Adds n_words and n_tokens to ``docs``, in place of columns of these names.

    Words are what white space separates; each is counted whole, with a word
    start before it. Null and blank texts have none. The automaton, of the
    size of the vocabulary, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_automaton(pieces))

    @F.pandas_udf("n_words bigint, n_tokens bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        cache: dict[str, int] = {}
        for texts in batches:
            rows = []
            for text in texts:
                words = (text or "").split()
                n = 0
                for word in words:
                    found = cache.get(word)
                    if found is None:
                        found = count_pieces(automaton, WORD_START + word)
                        if len(word) <= CACHED_CHARS:
                            if len(cache) >= CACHED_WORDS:
                                cache.clear()
                            cache[word] = found
                    n += found
                rows.append((len(words), n))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    out = fresh(docs, "counted")
    counted = docs.withColumn(out, run(F.col(text_col)))
    return counted.withColumns({c: F.col(f"{out}.{c}") for c in ("n_words", "n_tokens")}).drop(out)


def op5_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, load_vocabulary()).select("doc_id", "n_words", "n_tokens")
