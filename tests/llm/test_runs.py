"""Periodic runs against a direct search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from issuelens.llm.common import table
from issuelens.llm.repair import grammar, periodic_runs
from issuelens.llm.runs import find_runs, run_digests
from tests.llm.test_operators import frame, prose


def plain_runs(words, least=12, powers=2):
    """[(start, length, period)] by trying every period."""
    out, seen = [], set()
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, powers * q) and (s, e) not in seen:
                seen.add((s, e))
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digests(doc, text):
    w = split(text)
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(w, runs)), len(w))


def test_against_every_period():
    draw = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(draw.randrange(1, 5)):
            kinds, n = draw.randrange(1, 6), draw.randrange(0, 90)
            w = [draw.randrange(kinds) for _ in range(n)]
            if draw.random() < 0.6 and n:
                a = draw.randrange(n)
                p = 1 + draw.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        least = draw.choice([12, 12, 4, 7])
        words = np.array([x for w in texts for x in w], np.int64)
        text = np.repeat(np.arange(len(texts)), list(map(len, texts)))
        start, end, period = periodic_runs(words, text, least)
        at, want = 0, []
        for w in texts:
            want += [(at + s, at + s + n, q) for s, n, q in plain_runs(w, least)]
            at += len(w)
        assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_grammar_spells_the_texts():
    draw = np.random.default_rng(5)
    words, text = draw.integers(0, 4, 500), np.sort(draw.integers(0, 6, 500))
    rules = grammar(words, text)
    by_rule = {}
    for rule, place in zip(rules.rule, rules.place):
        size = int(rules.size[rule])
        assert text[place] == text[place + size - 1]
        by_rule.setdefault(int(rule), set()).add((tuple(words[place : place + size]), int(rules.left[rule])))
    assert all(len(v) == 1 for v in by_rule.values())
    # A pair of words or symbols is replaced all over: repeated rules are shared.
    assert len(by_rule) < len(rules.rule)


def test_long_texts_are_quick():
    """Half a million words, each of one period or none: no step tries all pairs of places."""
    n = 500_000
    one = np.zeros(n, np.int64)
    for words, want in ((one[:200_000], (0, 200_000, 1)), (np.arange(n) % 2, (0, n, 2)), (np.arange(n) % 1000, (0, n, 1000))):
        assert [tuple(int(x[0]) for x in periodic_runs(words, one[: len(words)]))] == [want]


@pytest.fixture(scope="module")
def texts():
    lines = prose(1, 9)
    return [
        (0, "\n".join([lines] * 4) + " end"),
        (1, "a " * 40),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b\x0c\r "),
        (5, prose(2, 400)),
        (6, "x y\tx  y\nx y x y x y x y x"),
        (6, "x y\tx  y\nx y x y x y x y x"),
        (7, " ".join(["one word"] * 30)),
        (8, ("é ß " * 30 + prose(3, 10) + " ") * 2),
        (9, " ".join([prose(4, 6)] * 2)),
        (None, "z " * 13),
        (11, prose(5, 3000) + " " + " ".join([prose(6, 700)] * 3)),
        *((i, prose(i, 5 * i)) for i in range(12, 60)),
    ]


def test_digests(spark, texts):
    got = run_digests(frame(spark, texts)).collect()
    want = sorted((str(d), *plain_digests(d, t)) for d, t in texts)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert run_digests(frame(spark, texts).limit(0)).count() == 0


def test_other_lengths_and_columns(spark, texts):
    docs = frame(spark, texts).withColumnRenamed("_part", "runs")
    for least, powers in ((4, 2), (9, 3)):
        got = find_runs(docs, least, powers)
        assert got.columns[-3:] == ["n_words", "runs_", "collapsed"] and "row" in got.columns
        for r in got.collect():
            text = next(t for d, t in texts if d == r["doc_id"])
            runs = plain_runs(split(text), least, powers)
            assert [tuple(x) for x in r["runs_"]] == runs
            assert r["collapsed"] == collapsed(split(text), runs) and r["runs"] == 1


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: tuple(r)[1:] for r in run_digests(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        if r["text"] and len(r["text"]) > 20_000:
            continue  # the direct search takes long there
        assert got[r["doc_id"]] == plain_digests(r["doc_id"], r["text"])
