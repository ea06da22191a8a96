"""Cutting words into learned pieces.

The functions returned here run inside Arrow UDFs. They are closures over plain
data and travel with the task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence


def merger(merges: Sequence[tuple[str, str]]) -> Callable[[list[str]], list[str]]:
    """A function applying the merges to a list of symbols, in order, each from the left.

    Pairs wait in a queue by turn and place, so a word of n symbols takes
    n * log(n) steps whatever the number of merges. A pair may be merged more
    than once: a symbol can come about again later.
    """
    turns: dict[tuple[str, str], list[int]] = defaultdict(list)
    for turn, pair in enumerate(merges):
        turns[pair].append(turn)
    turns = dict(turns)

    def merge(symbols: list[str]) -> list[str]:
        from bisect import bisect_right
        from heapq import heapify, heappop, heappush

        queue = [(turns[pair][0], at) for at, pair in enumerate(zip(symbols, symbols[1:])) if pair in turns]
        if not queue:
            return symbols
        symbols = list(symbols)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = {at: turn for turn, at in queue}  # the turn at which the pair that begins here is merged
        heapify(queue)
        while queue:
            turn, at = heappop(queue)
            if due.get(at) != turn:
                continue
            gone = after[at]
            symbols[at] += symbols[gone]
            symbols[gone] = ""
            due.pop(gone, None)
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            for start in (before[at], at):
                if start < 0:
                    continue
                end = after[start]
                known = turns.get((symbols[start], symbols[end])) if end < n else None
                later = bisect_right(known, turn) if known else 0
                if known and later < len(known):
                    due[start] = known[later]
                    heappush(queue, (known[later], start))
                else:
                    due.pop(start, None)
        return [s for s in symbols if s]

    return merge
