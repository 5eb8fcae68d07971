"""Text cleaning as Column expressions.

Everything except Unicode compatibility folding is a built-in expression that stays
inside generated JVM code. The patterns carry the flag ``(?d)``, which leaves ``\\n``
as the only line end, and spell out Unicode white space and digits, since Java's
short classes are ASCII. A built-in replacement decodes, scans and encodes the text anew
for every rule, so texts to which many rules apply are cleaned by Python's engine instead,
with the same patterns.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



class Rule(NamedTuple):
    name: str
    pattern: str
    replacement: str
    # The pattern can only match a text that holds one of these; checking for them
    # is a byte search.
    needs: tuple[str, ...]


# The characters that count as white space, and those that end a line.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, NOT_SPACE = f"[{SPACE_CLASS}]", f"[^{SPACE_CLASS}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# The cleaning patterns, in the order they apply; the order is part of
# the result.
MARKUP_RULES = [
    Rule("fenced_backtick", r"(?sd)```.*?```", " ", ("```",)),
    Rule("fenced_tilde", r"(?sd)~~~.*?~~~", " ", ("~~~",)),
    Rule("inline_code", r"(?d)`[^`\n]+`", " ", ("`",)),
    Rule("html_comment", r"(?sd)<!--.*?-->", " ", ("<!--",)),
    Rule("html_tag", r"(?d)<[^>]+>", " ", ("<",)),
    Rule("html_entity", r"(?d)&[a-zA-Z]+;|&#\p{Nd}+;", " ", ("&",)),
    Rule("block_quote", rf"(?md)^{SPACE}*+>+.*$", "", (">",)),
    Rule("image", r"(?d)!\[.*?\]\(.*?\)", " ", ("![",)),
    Rule("inline_link", r"(?d)\[([^\]]*)\]\([^)]*\)", "$1", ("](",)),
    Rule("reference_link", r"(?d)\[([^\]]*)\]\[[^\]]*\]", "$1", ("][",)),
    Rule("raw_url", rf"(?d)https?://{NOT_SPACE}+", " ", ("://",)),
    Rule("www_url", rf"(?d)www\.{NOT_SPACE}+", " ", ("www.",)),
    Rule("heading", rf"(?md)^#{{1,6}}{SPACE}+", "", ("#",)),
    Rule("emphasis", r"(?d)(\*{1,3}|_{1,3}|~{2})(.*?)\1", "$2", ("*", "_", "~~")),
    Rule("rule_line", rf"(?md)^{SPACE}*+[-*_]{{3,}}{SPACE}*$", "", ("-", "*", "_")),
    Rule("checkbox", rf"(?md)^{SPACE}*+-{SPACE}*+\[[ xX]\]{SPACE}*", "", ("[ ]", "[x]", "[X]")),
    Rule("bullet", rf"(?md)^{SPACE}*+[-*+]{SPACE}+", "", ("-", "*", "+")),
    Rule("numbered", rf"(?md)^{SPACE}*+\p{{Nd}}+\.{SPACE}+", "", (".",)),
]

# Symbol rules; they only concern text beyond Latin-1 letters.
SYMBOL_RULES = [
    Rule(
        "emoji",
        r"[\x{1f600}-\x{1f64f}\x{1f300}-\x{1f5ff}\x{1f680}-\x{1f6ff}\x{1f1e0}-\x{1f1ff}"
        r"\x{2700}-\x{27bf}\x{1f900}-\x{1f9ff}\x{2600}-\x{26ff}\x{1fa00}-\x{1fa6f}"
        r"\x{1fa70}-\x{1faff}\x{2300}-\x{23ff}\x{1f700}-\x{1f77f}]+",
        " ",
        (),
    ),
    Rule("invisible", r"[\x{fe00}-\x{fe0f}\x{200b}-\x{200f}\x{ad}\x{feff}]", "", ()),
]

# What no display can show; applies after compatibility folding.
PRINT_RULES = [
    Rule("unprintable", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{d800}-\x{dfff}\x{fffe}-\x{10ffff}]", " ", ()),
]

# Spacing rules, last.
SPACE_RUNS = [Rule("space_runs", r"[ \t]{2,}", " ", ("  ", "\t"))]
LAYOUT_RULES = [Rule("blank_lines", r"\n{3,}", "\n\n", ("\n\n\n",)), *SPACE_RUNS]

ALL_RULES = [*MARKUP_RULES, *SYMBOL_RULES, *PRINT_RULES, *LAYOUT_RULES]

WHITE_SPACE = f"{SPACE}+"
ASCII_WHITE_SPACE = r"[\t-\r\x1c-\x20]+"
# Text of these characters only has no symbols, nothing to fold, nothing unprintable
# and no line ends but \n and \r.
PLAIN_LATIN = r"^[\t\n\r\x20-\x7e\xa1-\xa7\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff]*\z"
PLAIN_LINE_ENDS = r"[\t ]*+[\n\r][\t\n\r ]*+"

# Characters that compatibility folding certainly leaves alone and that never
# combine with a neighbour. Text made only of these skips the Python worker.
# tests/test_text.py derives the same claim from the Unicode database.
FOLD_STABLE = (
    r"^[\x00-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\x{131}"
    r"\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{391}-\x{3a1}\x{3a3}-\x{3ce}"
    r"\x{400}-\x{482}\x{48a}-\x{52f}\x{5d0}-\x{5ea}\x{621}-\x{64a}\x{2010}\x{2012}-\x{2016}"
    r"\x{2018}-\x{2023}\x{2030}-\x{2032}\x{20a0}-\x{20a7}\x{20a9}-\x{20bf}\x{2190}-\x{21ff}"
    r"\x{2500}-\x{25ff}\x{3001}-\x{3003}\x{3041}-\x{3094}\x{30a1}-\x{30fa}\x{4e00}-\x{9fef}"
    r"\x{ac00}-\x{d7a3}]*\z"
)


# Texts with as many rules that may match are cleaned by Python's engine.
MANY_RULES = 8


def _python_engine() -> tuple[Callable[[str, str], str], Callable[[str], str]]:
    """One named rule, and the whole chain, on one text.

    Python's short classes are Unicode and its line end is ``\\n``. Functions made inside
    another go to the workers with their code.
    """
    rules = {}
    for rule in ALL_RULES:
        pattern = rule.pattern.replace("(?d)", "").replace("(?sd)", "(?s)").replace("(?md)", "(?m)").replace(r"\p{Nd}", r"\d")
        pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)
        rules[rule.name] = re.compile(pattern), rule.replacement.replace("$", "\\"), rule.needs
    folded_before = PRINT_RULES[0].name
    in_a_line = {"emphasis", "space_runs"}  # no match of these holds a line end
    symbols = re.compile("[\u2300-\U0001faff]+")  # one range, searched faster, that holds all emoji

    def step(text: str, name: str) -> str:
        pattern, replacement, needs = rules[name]
        if needs and not any(n in text for n in needs):
            return text
        if name in in_a_line:
            lines = text.split("\n")
            return "\n".join(pattern.sub(replacement, line) if any(n in line for n in needs) else line for line in lines)
        if name == "emoji":
            return symbols.sub(lambda m: pattern.sub(replacement, m[0]), text)
        return pattern.sub(replacement, text)

    def clean(text: str) -> str:
        for name in rules:
            if name == folded_before:
                text = unicodedata.normalize("NFKC", text)
            text = step(text, name)
        return "\n".join(line for line in map(str.strip, text.splitlines()) if line)

    return step, clean


python_step, python_clean = _python_engine()


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _fold_or_clean(to_fold: pd.Series, to_clean: pd.Series) -> pd.Series:
    cleaned = to_clean.map(python_clean, na_action="ignore")
    return cleaned.where(to_clean.notna(), to_fold.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore"))


# Marked non-deterministic so that a filter on the cleaned text is not pushed below
# it, which would run the Python worker twice per row.
fold_compatibility, fold_or_clean = _fold.asNondeterministic(), _fold_or_clean.asNondeterministic()


def _rewrite(col: Column, rule: Rule) -> Column:
    return F.regexp_replace(col, rule.pattern, rule.replacement)


def _may_match(col: Column, rule: Rule) -> Column:
    guards = [col.contains(need) for need in rule.needs]
    return reduce(lambda a, b: a | b, guards) if guards else F.lit(True)


def _rewrite_column(df: DataFrame, name: str, rules: list[Rule], only: Column | None = None) -> DataFrame:
    """Apply rules to a column, one projection each, skipping texts they cannot match."""
    for rule in rules:
        value = F.col(name)
        guard = _may_match(value, rule)
        guard = guard if only is None else only & guard
        df = df.withColumn(name, F.when(guard, _rewrite(value, rule)).otherwise(value))
    return df


def strip(col: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def null_to_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def markup_step(col: Column, name: str) -> Column:
    """One named cleaning rule on its own."""
    return reduce(_rewrite, [r for r in ALL_RULES if r.name == name], col)


def markup_digests(col: Column, names: Sequence[str]) -> Column:
    """A struct with the MD5 of what each named rule on its own makes of the text.

    The text goes to Python once for all rules and only digests come back.
    """

    def digests(texts: pd.Series) -> pd.DataFrame:
        def each(name: str) -> pd.Series:
            return texts.map(lambda t: hashlib.md5(python_step(t, name).encode()).hexdigest(), na_action="ignore")

        return pd.DataFrame({name: each(name) for name in names})

    return F.pandas_udf(digests, ", ".join(f"{name} string" for name in names)).asNondeterministic()(col)


def compact_lines(col: Column) -> Column:
    """Strip every line, drop empty ones and join the rest with ``\\n``."""
    lines = F.transform(F.split(col, LINE_END, -1), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def clean_text(col: Column) -> Column:
    """The whole cleaning chain as one expression, for use in any projection."""
    bare = reduce(_rewrite, [*MARKUP_RULES, *SYMBOL_RULES], null_to_empty(col))
    return compact_lines(reduce(_rewrite, [*PRINT_RULES, *LAYOUT_RULES], fold_compatibility(bare)))


def with_clean_text(df: DataFrame, source: str = "body", target: str = "text") -> DataFrame:
    """Add the cleaned text; the fast form of :func:`clean_text` with the same result.

    Rules that cannot match a text are skipped. Only texts that folding may change go to
    Python, and those that ``MANY_RULES`` rules may match, for the whole chain. What follows folding is one short expression, since a later filter on
    the text repeats it. Works on batch and streaming frames.
    """
    bare, plain, folded, whole = (f"__{target}_{part}" for part in ("bare", "plain", "folded", "whole"))
    odd = ~F.col(plain)
    body = F.col(source)
    rules = reduce(lambda a, b: a + b, [F.when(_may_match(body, rule), 1).otherwise(0) for rule in MARKUP_RULES])
    staged = df.withColumn(whole, F.when(rules >= MANY_RULES, body))
    staged = staged.withColumn(bare, F.when(F.col(whole).isNull(), null_to_empty(body)).otherwise(""))
    staged = _rewrite_column(staged, bare, MARKUP_RULES)
    staged = staged.withColumn(plain, F.col(bare).rlike(PLAIN_LATIN))
    staged = _rewrite_column(staged, bare, SYMBOL_RULES, odd)
    staged = _rewrite_column(staged, bare, SPACE_RUNS, F.col(plain))
    to_fold = F.when(odd & ~F.col(bare).rlike(FOLD_STABLE), F.col(bare))
    staged = staged.withColumn(folded, fold_or_clean(to_fold, F.col(whole)))
    # Line ends are white space, so stripping lines and dropping empty ones amounts to
    # making each white-space run that holds a line end a single one.
    plain_lines = strip(F.regexp_replace(F.col(bare), PLAIN_LINE_ENDS, "\n"))
    printed = reduce(_rewrite, [*PRINT_RULES, *LAYOUT_RULES], F.coalesce(folded, bare))
    text = F.when(F.col(whole).isNotNull(), F.col(folded)).when(F.col(plain), plain_lines).otherwise(compact_lines(printed))
    return staged.withColumn(target, text).drop(bare, plain, folded, whole)


def words(col: Column) -> Column:
    """White-space separated words; the empty text has none."""
    is_ascii = F.octet_length(col) == F.length(col)
    parts = F.when(is_ascii, F.split(col, ASCII_WHITE_SPACE)).otherwise(F.split(col, WHITE_SPACE))
    return F.filter(parts, lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


def tokens(col: Column, max_length: int | None = None) -> Column:
    """Lower-cased words, optionally only the first ``max_length`` as a model window."""
    found = words(F.lower(null_to_empty(col)))
    return found if max_length is None else F.slice(found, 1, max_length)


def preprocess_text(col: Column, max_length: int = 512) -> Column:
    """Keep ``max_length`` characters, then collapse white space and strip."""
    return strip(F.regexp_replace(F.substring(col, 1, max_length), WHITE_SPACE, " "))


def text_hash(col: Column) -> Column:
    return F.sha2(col, 256)
