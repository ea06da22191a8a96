import random
from collections import Counter

import pytest

from pairloom.llm.licenses import MIN_DICE, TEMPLATES, Templates, normalise, scan_licenses, units_and_segments


def _dice(a, b):
    a, b = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * (a & b).total() / (a.total() + b.total()) if a and b else 0.0


def test_pruned_search_finds_what_a_full_one_does():
    known = Templates(TEMPLATES, MIN_DICE)
    for name, wording in TEMPLATES:
        words = normalise(wording)
        for n in range(0, len(words), max(1, len(words) // 25)):
            for said in (words[n:], words[: len(words) - n], words + ["more"] * n, words[:n] + ["other"] + words[n:]):
                ranked = [(_dice(said, normalise(t)), len(normalise(t)), l) for l, t in TEMPLATES]
                best = max((d for d, _, _ in ranked), default=0)
                got = known.best(said)
                assert (got is None) == (best < MIN_DICE)
                if got:
                    assert got[0] == pytest.approx(best) and got[1] in {l for d, _, l in ranked if d == best}


def test_every_template_finds_itself():
    known = Templates(TEMPLATES, MIN_DICE)
    assert [known.best(normalise(t)) for _, t in TEMPLATES] == [(1.0, name) for name, _ in TEMPLATES]


def test_levels(spark):
    mit = TEMPLATES[[n for n, _ in TEMPLATES].index("MIT") + 2][1]
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70) )
    rows = [
        (1, "Some words. Released under the MIT License. And more of them."), (2, "a line of quite other words\nLicensed under CC BY-NC 4.0.\nanother"),
        (3, f"intro text of the file\n\n{wrapped}\n\n def f(): pass"), (4, None), (5, ""), (6, "nothing of the kind " * 50000),
        (7, "MIT"), (1, "Some words. Released under the MIT License. And more of them."),
    ]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id bigint, text string, dice string")
    got = [(r["doc_id"], {(h["level"], h["license"]) for h in r["licenses"]}) for r in scan_licenses(docs).collect()]
    assert got.count((1, {("sentence", "MIT")})) == 2
    assert (2, {("sentence", "CC-BY-NC-4.0"), ("line", "CC-BY-NC-4.0")}) in got
    assert [levels for i, levels in got if i == 3][0] >= {("paragraph", "MIT")}
    assert [i for i, levels in got if not levels] == [4, 5, 6, 7]
    assert scan_licenses(docs.limit(0)).count() == 0


MIT = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)


def _all_runs(units):
    """The best template of every run of units, by comparing each to all templates."""
    templates = [(len(normalise(t)) - 1, name, normalise(t)) for name, t in TEMPLATES]
    units = [u for u in units if u]
    found = {}
    for s in range(len(units)):
        words = []
        start = sum(map(len, units[:s]))
        for unit in units[s:]:
            words = words + unit
            ranked = [(-_dice(words, t), -size, name) for size, name, t in templates]
            if -min(ranked)[0] >= MIN_DICE:
                found[start, start + len(words)] = (-min(ranked)[0], min(ranked)[2])
    return found


def test_runs_are_those_of_a_full_search():
    rng = random.Random(8)
    known, vocabulary = Templates(TEMPLATES, MIN_DICE), normalise(" ".join(t for _, t in TEMPLATES))
    for _ in range(40):
        pieces = []
        for _ in range(rng.randint(1, 4)):
            words = normalise(rng.choice(TEMPLATES)[1]) if rng.random() < 0.7 else rng.choices(vocabulary, k=30)
            cuts = sorted(rng.sample(range(len(words) + 1), min(5, len(words))))
            pieces += [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
            pieces += [rng.choices(vocabulary, k=rng.randint(0, 6))]
        assert known.runs(pieces) == _all_runs(pieces)


def test_licences_of_several_paragraphs_within_long_texts(spark):
    grant, notice = MIT.index("The above copyright"), MIT.index("THE SOFTWARE IS")
    layout = "\n\n".join([MIT[:grant], MIT[grant:notice], MIT[notice:]])
    filler = "\n".join("a line of quite other words, number %d" % i for i in range(3000))
    rows = [
        (1, f"{filler}\n\n{layout}\n\n{filler}"), (2, "Some code here. It is licensed. Released under\nthe MIT License. And it goes on.\nand on"),
        (3, f"{layout}\n\n{filler}\n\n{layout}"), (4, filler),
    ]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, Licenses double")
    got = {r["doc_id"]: [(h["level"], h["license"], round(h["dice"], 6)) for h in r["licenses"]] for r in scan_licenses(docs).collect()}
    assert got == {1: [("run", "MIT", 1.0)], 2: [("run", "MIT", 1.0)], 3: [("run", "MIT", 1.0)] * 2, 4: []}


def test_units_cover_the_text():
    text = "One two. Three\n\n four five\n\n\nsix! seven"
    units, parts = units_and_segments(text)
    assert units == [["one", "two"], ["three"], [], ["four", "five"], [], [], ["six"], ["seven"]]
    assert [p for p in parts if p[0] > 1] == [(2, 0, 0, 3), (2, 1, 3, 5), (2, 2, 5, 7), (3, 0, 0, 7)]
