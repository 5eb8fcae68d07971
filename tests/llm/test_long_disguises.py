"""Disguises in very long texts, letters set apart against one regular expression, Viterbi against all paths."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from issuelens.llm import toxicity
from issuelens.llm.toxicity import LOOKALIKES, MARGIN, SEPARATORS, SYMBOLS, CharacterModel, Restorer, bare, spaced_letters, symbol

WEIGHTS = {"idiot": 5.0, "stupid": 4.0, "clown": 3.0}
LETTER = r"(?:[^\W_]|[@$!|+])"
SPACED = re.compile(rf"(?:(?<!\S)|(?<=[,;:?()\[\]{{}}\"<>/\\=#&%]))(?:(?![@$!|+])[^\w\s]|_)*({LETTER}(?:\s+{LETTER}){{2,}})(?![^\W_])")


def counts():
    out = np.ones((SYMBOLS,) * 3)
    s = [0, 0, *map(symbol, "the end is what you are and the idea of it"), 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        out[a, b, c] += 5
    return out.ravel()


@pytest.fixture(scope="module")
def restorer():
    return Restorer(WEIGHTS, counts())


MB = 1 << 20
LONG = {
    "letters apart": (" ".join(random.Random(3).choices("bcefghjkmnqvwxyz", k=MB // 2)) + " i d i o t", 5),
    "one word apart": ("idea " * (MB // 5) + "1 d 1 0 t", 5),
    "one token": ("".join(random.Random(4).choices("abce01!3$", k=MB)) + " 1d10t", 5),
    "one letter": ("i" * MB + "d10t", 5),
    "marks": ("," * MB + "1d10t", 5),
    "marks apart": ("." * (MB // 2) + "i d i o t" + "'" * (MB // 2), 5),
    "look-alikes": ("i1" * (MB // 2), 0),
    "joined": ("1d10t-" * 10_000, 50_000),  # every piece is decoded: about 0.6 ms each
}


@pytest.mark.parametrize("name", LONG)
def test_long(restorer, name):
    text, want = LONG[name]
    start = time.process_time()
    assert restorer.text(text)[0] == want
    assert time.process_time() - start < 10


def test_long_grows_in_step(restorer):
    """Ten times the disguised letters take about ten times as long, not a hundred."""
    took = []
    for n in (2_000, 20_000):
        start = time.process_time()
        assert Restorer(WEIGHTS, counts()).text("1 d 1 0 t " * n)[0] >= 5 * n * 0.99
        took.append(time.process_time() - start)
    assert took[1] < 30 * took[0]


def test_spaced_letters():
    rnd = random.Random(5)
    for _ in range(4_000):
        text = "".join(rnd.choices("ab1!'.,(_- \n\té", weights=[5, 5, 2, 1, 1, 1, 1, 1, 1, 1, 16, 1, 1, 1], k=rnd.randrange(24)))
        want = ["".join(m.group(1).split()) for m in SPACED.finditer(text)]
        assert list(spaced_letters(text.split())) == want, repr(text)


def every_source(model, token):
    """Scores of all sources of a token, path by path."""
    out = {}

    def go(at, state, score, text):
        if at == len(token):
            a, b = state
            out[text] = max(out.get(text, -np.inf), score + model.log[a][b][0])
            return
        char = token[at]
        run = at + len(list(itertools.takewhile(lambda c: c == char, token[at:])))
        if char in SEPARATORS:
            arcs = [("", run, 0.1)]
        elif char in LOOKALIKES:
            arcs = [("", run, 6.0), *((x, at + 1, 0.5) for x in LOOKALIKES[char])]
            arcs += [(x * n, run, 1.0) for x in LOOKALIKES[char] for n in (1, 2) if run > at + 1]
        else:
            arcs = [(char, at + 1, 0.0)]
            arcs += [(bare(char), at + 1, 0.5)] if bare(char) != char else []
            arcs += [(char, run, 1.0), (char * 2, run, 0.5)] if run > at + 1 else []
        for letters, to, cost in arcs:
            (a, b), gain = state, -cost
            for x in letters:
                gain += model.log[a][b][symbol(x)]
                a, b = b, symbol(x)
            go(to, (a, b), score + gain, text + letters)

    go(0, (0, 0), 0.0, "")
    return out


def test_viterbi_is_the_best_of_all_paths():
    model, rnd = CharacterModel(counts(), ["idiot"]), random.Random(6)
    for _ in range(300):
        token = "".join(rnd.choices("ido10!6..é", k=rnd.randrange(1, 8)))
        want = every_source(model, token)
        got = model.sources(token)
        best = max(want.values())
        assert want[got[0]] == pytest.approx(best)
        assert len(set(got)) == len(got) and all(want[g] >= best - MARGIN - 1e-9 for g in got)


def test_cache_holds_no_long_tokens(restorer):
    restorer.text("x" * 1_000 + " 1d10t")
    assert max(map(len, restorer.cache)) <= toxicity.LONG_TOKEN
