"""Cleaning: each literal case, and the whole chain against a restatement with ``re``."""

import re
import sys
import unicodedata

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuelens.functions import text as T
from issuelens.operators.relational import keep_min_length

PY_FLAGS = {"m": re.MULTILINE, "s": re.DOTALL}


def python_clean(body):
    """The same rules run by Python's own engine."""
    if body is None:
        return ""
    out = body
    for name, pattern, replacement, _ in T.ALL_RULES:
        if name == "unprintable":
            out = unicodedata.normalize("NFKC", out)
        flags = 0
        head = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
        if head:
            pattern = pattern[head.end() :]
            for letter in head.group(1):
                flags |= PY_FLAGS.get(letter, 0)
        pattern = pattern.replace(r"\p{Nd}", r"\d")
        pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), pattern)
        out = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", replacement), out, flags=flags)
    return "\n".join(s for s in (line.strip() for line in out.splitlines()) if s).strip()


CASES = [
    ("Crash on start\n```sh\nrun --now\n```\nsince Monday", "Crash on start\nsince Monday"),
    ("call `reset_all()` twice", "call twice"),
    ("first\n~~~\nlog = []\n~~~\nlast", "first\nlast"),
    ("an <em>odd</em> tag", "an odd tag"),
    ("<!-- template hint -->seen", "seen"),
    ("fish &amp; chips &gt;rice&lt;", "fish chips rice"),
    ("Logo: ![our logo](http://host.test/logo.svg)", "Logo:"),
    ("read [chapter two](https://host.test/two) first", "read chapter two first"),
    ("read [chapter two][c2] first", "read chapter two first"),
    ("moved to https://host.test/new last week", "moved to last week"),
    ("moved to www.host.test last week", "moved to last week"),
    ("### Steps\nnone", "Steps\nnone"),
    ("a **very** old bug", "a very old bug"),
    ("- milk\n- bread", "milk\nbread"),
    ("4. open\n5. close", "open\nclose"),
    ("- [x] tested\n- [ ] merged", "tested\nmerged"),
    ("> as you said\nI agree", "I agree"),
    ("upper\n---\nlower", "upper\nlower"),
    ("ship it \U0001f680 today", "ship it today"),
    ("top\n\n\n\n\nbottom", "top\nbottom"),
    ("wide   open    space", "wide open space"),
    ("   padded on both sides   ", "padded on both sides"),
    (None, ""),
    ("", ""),
    ("x_y_z", "xyz"),
    ("p < q\n> r", "p r"),
    ("&#x2a;", "&#x2a;"),
    ("\ufb02y \u2460 \uff21\uff22", "fly 1 AB"),
    ("one\r\ntwo\rthree", "one\ntwo\nthree"),
    ("\u00a0lead\u2028mid\u0085end\u001cz\u200b", "lead\nmid end z"),
    ("\u0664. arabic digit", "arabic digit"),
]


def run(spark, bodies):
    frame = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    both = T.with_clean_text(frame, "body", "text").withColumn("chain", T.clean_text(F.col("body")))
    return both.orderBy("id").collect()


def test_literal_cases(spark):
    rows = run(spark, [c[0] for c in CASES])
    for row, (body, expected) in zip(rows, CASES):
        assert row["text"] == expected, body
        assert row["chain"] == expected, body
        assert python_clean(body) == expected, body


PIECES = st.sampled_from(
    ["`", "```", "~~~", "~~", "*", "**", "_", "__", "<", ">", "<!--", "-->", "&amp;", "&#12;", "#", "##", "-", "---"]
    + ["[", "]", "](", ")", "![", "][", "[x]", "http://", "https://", "www.", "1.", "+ ", "\n", "\n\n\n", "\r", "\r\n"]
    + [" ", "  ", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u2029", "\u3000", "\u200b", "\ufeff"]
    + ["a", "B", "word", "é", "e\u0301", "ﬁ", "①", "\u0663", "\U0001f600", "\U0001d400", "\u2603", "中", "가", "\u1161", "½", "²"]
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=200, max_size=200))
def test_chain_equals_python(spark, bodies):
    for row in run(spark, bodies):
        expected = python_clean(row["body"])
        assert row["text"] == expected, repr(row["body"])
        assert row["chain"] == expected, repr(row["body"])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\x00"), max_size=60),
        min_size=200,
        max_size=200,
    )
)
def test_chain_equals_python_any_text(spark, bodies):
    for row in run(spark, bodies):
        assert row["text"] == python_clean(row["body"]), repr(row["body"])


def test_fold_stable_class_is_stable():
    inner = T.FOLD_STABLE[2:-4]
    body = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), inner)
    stable = {c for c in map(chr, range(0x110000)) if re.match(f"[{body}]", c)}
    seconds = set(map(chr, range(0x1161, 0x1176))) | set(map(chr, range(0x11A8, 0x11C3)))
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code))
        if parts and not parts.startswith("<") and len(parts.split()) == 2:
            seconds.add(chr(int(parts.split()[1], 16)))
    assert len(stable) > 30_000
    plain = {c for c in map(chr, range(256)) if re.match(T.PLAIN_LATIN.replace("*\\z", ""), c)}
    assert plain < stable and not plain & set("\xa0\xad\x85\x0b\x0c\x1c")
    for char in stable:
        assert unicodedata.normalize("NFKC", char) == char, hex(ord(char))
        assert not unicodedata.combining(char) and char not in seconds, hex(ord(char))


def test_one_python_node_and_filters_below(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en'")
    plan = keep_min_length(T.with_clean_text(docs, "text", "clean"), "clean", 20)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython [") == 1
    assert "EqualTo(lang,en)" in text


@pytest.mark.parametrize(
    "body,limit,expected",
    [
        ("Short note", 300, "Short note"),
        ("q" * 700, 90, "q" * 90),
        ("gaps   of    all  kinds", 300, "gaps of all kinds"),
        ("", 300, ""),
        ("bits " * 120, 40, ("bits " * 8).strip()),
    ],
)
def test_preprocess(spark, body, limit, expected):
    frame = spark.createDataFrame([(body,)], "t string")
    assert frame.select(T.preprocess_text(F.col("t"), limit)).first()[0] == expected


def test_word_count_and_tokens(spark):
    texts = ["", "  ", "one", " a  b\tc\n", "x\u00a0y\u2003z\x1cw"]
    frame = spark.createDataFrame(pd.DataFrame({"t": texts}))
    rows = frame.select("t", T.word_count(F.col("t")).alias("n"), T.tokens(F.col("t"), 2).alias("k")).collect()
    for row in rows:
        assert row["n"] == len(row["t"].split())
        assert row["k"] == row["t"].lower().split()[:2]


def test_filter_repeats_no_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = keep_min_length(T.with_clean_text(docs, "text", "clean"), "clean", 20)
    text = plan._jdf.queryExecution().executedPlan().toString()
    marker = "d800"  # the unprintable rule
    assert text.count(marker) <= 2
