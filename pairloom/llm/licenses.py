"""License scans: stretches of text against licence templates, by the Dice coefficient over word bigrams.

A text is cut into units at sentence and line ends and normalised to words. Every
run of neighbouring units (so each sentence, line, paragraph and the whole, but
also a notice wrapped over lines or a licence of several paragraphs) is compared
to the templates whose size allows the wanted likeness at all: two lists of a
and b bigrams are alike by 2 * min(a, b) / (a + b) at most. That bounds the size
of runs and prunes templates: of one with b bigrams at least
b * min_dice / (2 - min_dice) must lie within a stretch of the largest size.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import read_table, without

MIN_DICE = 0.8

# The wording of public licences and of notices that name them. (licence, wording)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile("[a-z0-9]+")
_SENTENCE = re.compile(r"[.!?][ \t]+")
LEVELS = ("sentence", "line", "paragraph", "text")  # and "run"


def normalise(text: str) -> list[str]:
    """Words of ASCII letters and digits in lower case."""
    return _WORDS.findall(text.translate(_CAPITALS))


class Templates:
    """The templates with the bounds on the size of what can be as like them as wanted, and their bigrams' index."""

    def __init__(self, templates: Sequence[tuple[str, str]], min_dice: float):
        counted = ((name, Counter(zip(words, words[1:]))) for name, words in ((n, normalise(t)) for n, t in templates))
        self.items = sorted(((c.total(), name, c) for name, c in counted if c), key=lambda x: x[:2])
        self.min_dice = min_dice
        self.ratio = min_dice / (2 - min_dice)
        self.having: dict[tuple[str, str], list[int]] = {}
        for t, (_, _, pairs) in enumerate(self.items):
            for pair in pairs:
                self.having.setdefault(pair, []).append(t)

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The likeness and name of the most alike template; of equal ones the largest, then the first by name."""
        return self.runs([words]).get((0, len(words)))

    def runs(self, units: Sequence[list[str]]) -> dict[tuple[int, int], tuple[float, str]]:
        """The best template of each run of units that is like one: (first word, end) to (dice, name).

        Words are numbered through the text. Runs are told by their words, so
        units without words don't count.
        """
        words = [word for unit in units for word in unit]
        starts, at = [], 0
        for unit in units:
            if unit:
                starts.append(at)
            at += len(unit)
        ends = [*starts[1:], at]
        hits: dict[int, list[int]] = {}
        for place, pair in enumerate(zip(words, words[1:])):
            for t in self.having.get(pair, ()):
                hits.setdefault(t, []).append(place)
        found: dict[tuple[int, int], tuple[float, int, str]] = {}
        for t, places in hits.items():
            size, name, template = self.items[t]
            need, longest = math.ceil(size * self.ratio - 1e-9), size / self.ratio + 1e-9
            if len(places) < need:
                continue
            # The start of a run lies up to ``longest`` before the last of ``need`` hits.
            tried = -1
            for first, last in zip(places, places[need - 1 :]):
                if last - first >= longest:
                    continue
                lowest = bisect_left(starts, last + 1 - longest)
                for s in range(max(lowest, tried + 1), bisect_right(starts, first)):
                    tried = s
                    self._from(s, starts, ends, words, places, (size, name, template, longest), found)
        return {run: (-dice, name) for run, (dice, _, name) in found.items()}

    def _from(self, s, starts, ends, words, places, wanted, found) -> None:
        """Adds the runs from unit ``s`` on that are like one template, counting its bigrams as the run grows."""
        size, name, template, longest = wanted
        left: dict[tuple[str, str], int] = {}
        shared, hit = 0, bisect_left(places, starts[s])
        for e in range(s, len(ends)):
            n = ends[e] - starts[s] - 1
            if n > longest:
                break
            while hit < len(places) and places[hit] + 1 < ends[e]:
                pair = (words[places[hit]], words[places[hit] + 1])
                rest = left.get(pair, template[pair])
                left[pair] = rest - 1
                shared += rest > 0
                hit += 1
            dice = 2 * shared / (size + n)
            if dice >= self.min_dice:
                run, rank = (starts[s], ends[e]), (-dice, -size, name)
                if run not in found or rank < found[run]:
                    found[run] = rank


def units_and_segments(text: str) -> tuple[list[list[str]], list[tuple[int, int, int, int]]]:
    """The words of each unit, and (level, number within it, first word, end); lines end at \\n, paragraphs at empty lines, sentences within a line."""
    units: list[list[str]] = []
    parts: list[tuple[int, int, int, int]] = []
    at = paragraph = n_paragraphs = 0
    for n_lines, line in enumerate(text.split("\n")):
        before = at
        for sentence in _SENTENCE.split(line):
            words = normalise(sentence)
            parts.append((0, len(units), at, at + len(words)))
            units.append(words)
            at += len(words)
        parts.append((1, n_lines, before, at))
        if not line.strip(" \t\r") and at > paragraph:
            parts.append((2, n_paragraphs, paragraph, at))
            n_paragraphs, paragraph = n_paragraphs + 1, at
    parts.append((2, n_paragraphs, paragraph, at))
    parts.append((3, 0, 0, at))
    return units, parts


def _hits(text: str, known: Templates) -> list[dict]:
    """The hits of a text, see ``scan_licenses``."""
    units, parts = units_and_segments(text)
    runs = known.runs(units)
    if not runs:
        return []
    hits = [
        {"level": LEVELS[level], "number": number, "license": runs[a, b][1], "dice": runs[a, b][0]}
        for level, number, a, b in parts if (a, b) in runs
    ]
    named = {(a, b) for _, _, a, b in parts}
    first_unit = {a: number for level, number, a, b in parts if level == 0 and a < b}
    taken: dict[str, list[tuple[int, int]]] = {}
    for (a, b), (dice, name) in sorted(runs.items(), key=lambda x: (-x[1][0], x[0][1] - x[0][0], x[0])):
        own = taken.setdefault(name, [])
        place = bisect_left(own, (a, b))
        if (place and own[place - 1][1] > a) or (place < len(own) and own[place][0] < b):
            continue
        own.insert(place, (a, b))
        if (a, b) not in named:
            hits.append({"level": "run", "number": first_unit[a], "license": name, "dice": dice})
    return hits


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, min_dice: float = MIN_DICE, text_col: str = "text") -> DataFrame:
    """Adds ``licenses`` to ``docs``, in place of a column of this name: (level, number, license, dice) of stretches like a template.

    All sentences, lines, paragraphs and whole texts that are like one are
    listed. Of the other runs of sentences and lines, level ``run``, numbered by
    their first sentence, those are listed that are more alike than any stretch
    of that licence they overlap: runs are taken from the most alike on, of
    equal ones the shortest, then the first, and none that overlaps one taken.
    Null and blank texts, and stretches of fewer than two words, are like none.
    """
    docs = without(docs, ["licenses"])
    kind = "array<struct<level:string,number:bigint,license:string,dice:double>>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Templates(templates, min_dice)
        for texts in batches:
            found = [_hits(text or "", known) for text in texts]
            yield pd.Series(found, dtype=object)

    return docs.withColumn("licenses", run(F.col(text_col)))


def op6_licenses(spark, sf_dir):
    docs = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    # The most alike comes first; a negative likeness sorts the array.
    ranked = F.array_sort(
        F.transform("licenses", lambda h: F.struct((-F.round(h["dice"], 6)).alias("rank"), h["license"].alias("license")))
    )
    best = F.get(ranked, F.lit(0))
    return docs.withColumn("best", best).select(
        "doc_id", F.col("best.license").alias("license"), (-F.col("best.rank")).alias("dice"),
        F.size(F.array_distinct(F.transform("licenses", lambda h: h["license"]))).cast("bigint").alias("n_licenses"),
    )


def _template_rows() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    return f"(VALUES {rows}) AS v(license, wording)"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"


# Every run of units (sentences within lines), for the templates of which a text has enough bigrams at all.
OP6_SQL = f"""
WITH t AS (SELECT row_number() OVER (ORDER BY license, wording) AS t, license, {_words_sql("wording")} AS w FROM {_template_rows()}),
tb AS (SELECT t, license, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS pair, count(*) AS k
       FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t) GROUP BY ALL),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
u AS (SELECT doc_id, i, unnest(regexp_split_to_array(line, '[.!?][ \\t]+')) AS sentence,
             generate_subscripts(regexp_split_to_array(line, '[.!?][ \\t]+'), 1) AS j FROM l),
v AS (SELECT doc_id, i, j, {_words_sql("sentence")} AS w FROM u),
b AS (SELECT doc_id, row_number() OVER o AS k, sum(len(w)) OVER o AS stop, sum(len(w)) OVER o - len(w) AS start
      FROM v WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i, j)),
d AS (SELECT doc_id, {_words_sql("coalesce(text, '')")} AS w FROM documents),
h AS (SELECT g.doc_id, g.pos, tb.t, tb.license, tb.size, tb.pair, tb.k
      FROM (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)) g
      JOIN tb ON tb.pair = g.pair),
c AS (SELECT doc_id, t, size, license FROM (SELECT doc_id, t, size, license, least(count(*), k) AS n FROM h GROUP BY doc_id, t, size, license, pair, k)
      GROUP BY ALL HAVING sum(n) * {2 - MIN_DICE} >= {MIN_DICE} * size - 1e-9),
r AS (SELECT c.doc_id, c.t, c.license, c.size, x.start, y.stop, y.stop - x.start - 1 AS n
      FROM c JOIN b x ON x.doc_id = c.doc_id
      JOIN b y ON y.doc_id = c.doc_id AND y.k >= x.k AND y.stop - x.start - 1 <= c.size * {2 - MIN_DICE} / {MIN_DICE} + 1e-9
      WHERE y.stop - x.start - 1 >= c.size * {MIN_DICE} / {2 - MIN_DICE} - 1e-9),
s AS (SELECT r.doc_id, r.t, r.license, r.size, r.start, r.stop, r.n, least(count(*), h.k) AS shared
      FROM r JOIN h ON h.doc_id = r.doc_id AND h.t = r.t AND h.pos >= r.start AND h.pos + 1 < r.stop
      GROUP BY r.doc_id, r.t, r.license, r.size, r.start, r.stop, r.n, h.pair, h.k),
m AS (SELECT doc_id, license, size, start, stop, 2 * sum(shared) / CAST(size + n AS DOUBLE) AS dice
      FROM s GROUP BY doc_id, t, license, size, start, stop, n),
best AS (SELECT doc_id, license, dice FROM m WHERE dice >= {MIN_DICE}
         QUALIFY row_number() OVER (PARTITION BY doc_id, start, stop ORDER BY dice DESC, size DESC, license) = 1),
doc AS (SELECT doc_id, count(DISTINCT license) AS n_licenses FROM best GROUP BY doc_id),
top AS (SELECT doc_id, license, round(dice, 6) AS dice FROM best
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(dice, 6) DESC, license) = 1)
SELECT documents.doc_id, top.license, top.dice, CAST(coalesce(doc.n_licenses, 0) AS BIGINT) AS n_licenses
FROM documents LEFT JOIN top USING (doc_id) LEFT JOIN doc USING (doc_id)
"""
