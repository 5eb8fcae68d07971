"""Disguised words next to punctuation, over wider gaps, and joined to other words."""

import numpy as np
import pytest

from issuelens.llm.toxicity import SYMBOLS, CharacterModel, Restorer, symbol

WEIGHTS = {"idiot": 5.0, "stupid": 4.0, "clown": 3.0, "fop": 2.0}


@pytest.fixture(scope="module")
def restorer():
    counts = np.zeros((SYMBOLS,) * 3)
    s = [0, 0, *map(symbol, "the end is what you are and the idea of it"), 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        counts[a, b, c] += 1
    return Restorer(WEIGHTS, counts.ravel())


@pytest.mark.parametrize(
    "text, want",
    [
        ("i d i o t.", 5), ("i d i o t,", 5), ("(i d i o t)", 5), ('"i d i o t"', 5), ("i  d  i  o  t", 5), ("i d\ni o\nt", 5),
        ("you:(i d i o t)!", 5), ("1 d 1 0 t!", 5), ("f o p", 2), ("(f o p).", 2), ("you are an i d i o t; c l o w n.", 8),
        ("...i d i o t...", 5), ("a b c", 0), ("it's f o", 0), ("oaf's top f o", 0), ("(a b c)", 0), ("i d i o", 0),
    ],
)
def test_spaced(restorer, text, want):
    assert restorer.text(text)[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("end.1d10t", 5), ("you-1d10t", 5), ("1d10t.end", 5), ("clown-1d10t", 8), ("1d10t-cl0wn", 8), ("clown!1d10t", 8), ("end.i.d.i.o.t", 5),
        ("the-end_1d1ot*you", 5), ("the.end", 0), ("end-idea", 0), ("...", 0), ("i.d.i.o.t.", 5), ("idiot-idiot", 10), ("1d10t~1d10t", 10),
    ],
)
def test_joined(restorer, text, want):
    assert restorer.text(text)[0] == want


def test_no_known_words():
    assert Restorer({}, np.zeros(SYMBOLS**3)).text("end.1d10t i d i o t")[0] == 0
