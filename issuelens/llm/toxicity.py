"""Toxicity of texts after their disguises are undone.

A token is seen as the output of a noisy channel: letters replaced by look-alikes, put
apart, or repeated. Its possible sources form a lattice, and Viterbi search under a
character model of the corpus picks the likeliest. The restored words are then weighed by
a naive Bayes model over words and word beginnings and a two-variable calibration.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import small_batches, strings
from issuelens.session import materialize

TRAIN_ROWS = 10_000
SUPPORT = 0.005
MIN_DOCS = 3
SIGNIFICANT = 15.0
PREFIXES = range(4, 9)
CACHE = 500_000
SYMBOLS = 28
MARGIN = 10.0
PATHS = 4
OWN_SHARE = 0.8

# Which letters a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "ѕ": "s", "у": "y",
}
SEPARATORS = set("._-*~^'`’​‌‍⁠﻿­")
CLASSES = {"l": "i", "g": "b"}

PARTS = re.compile(r"[^\s,;:?()\[\]{}\"<>/\\=#&%]+")
PLAIN = re.compile(r"[^\W\d_]+")
PIECES = re.compile("[^" + re.escape("".join(sorted(SEPARATORS))) + "]+")
TWICE = re.compile(r"(.)\1")
SIGNS = "@$!|+"
PART_ENDS = set(",;:?()[]{}\"<>/\\=#&%")
MARKS = "".join(sorted(SEPARATORS | PART_ENDS))
LONG_TOKEN = 64
LONG_RUN = 8
SPARE = 8


def symbol(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27


def letter(char: str) -> bool:
    """Whether a character that stands apart may be a letter of a word."""
    return char.isalnum() or char in SIGNS


def opens(token: str) -> bool:
    """Whether the last character of ``token`` may be the first letter of a word set apart:
    before it come only marks, back to a blank or to a mark that ends a part. A word's
    apostrophe is none.
    """
    if not letter(token[-1]):
        return False
    for char in reversed(token[:-1]):
        if char in PART_ENDS:
            return True
        if char.isalnum() or char in SIGNS:
            return False
    return True


def spaced_letters(tokens: list[str]) -> Iterator[str]:
    """Runs of three or more letters that stand apart; marks may surround a run."""
    at = 0
    for i, token in enumerate(tokens):
        if i < at or len(token) != 1 or not letter(token):
            continue
        at = i
        while at < len(tokens) and len(tokens[at]) == 1 and letter(tokens[at]):
            at += 1
        run = "".join(tokens[i:at])
        if i and len(tokens[i - 1]) > 1 and opens(tokens[i - 1]):
            run = tokens[i - 1][-1] + run
        if at < len(tokens) and letter(tokens[at][0]) and not tokens[at][1:2].isalnum():
            run += tokens[at][0]
        if len(run) > 2:
            yield run


@lru_cache(maxsize=65536)
def bare(char: str) -> str:
    """The letter under accents or in another width; other characters as they are."""
    if char < "\x80":
        return char
    first = unicodedata.normalize("NFKD", char)[:1].lower()
    return first if "a" <= first <= "z" else char


@lru_cache(maxsize=65536)
def shape_of(char: str) -> str:
    """The letter that stands for a character and its look-alikes; none for separators."""
    if char in SEPARATORS:
        return ""
    char = bare(LOOKALIKES.get(char, char)[0])
    return CLASSES.get(char, char)


def skeleton(token: str) -> str:
    """What a token and all its possible sources have in common."""
    out, last = [], ""
    for char in map(shape_of, token):
        if char and char != last:
            out.append(char)
            last = char
    return "".join(out)


def beginning(token: str, runs: int) -> str:
    """``token`` up to its first ``runs`` runs of equal characters, separators not counted;
    of longer runs ``LONG_RUN`` characters are kept, as no word repeats a letter so often.
    """
    out, last, length = [], "", 0
    for char in token:
        if char != last:
            if char not in SEPARATORS:
                runs -= 1
                if runs < 0:
                    break
            last, length = char, 0
        length += 1
        if length <= LONG_RUN:
            out.append(char)
    return "".join(out)


def plain(word: str) -> bool:
    """Whether a word can be no other word in disguise: letters only, none twice in a row."""
    return word.isascii() and word.isalpha() and not TWICE.search(word)


def features_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if n < len(word)]]


def plain_words(text: str) -> Iterator[str]:
    for token in text.split():
        yield from (w for w in re.findall(r"[^\W\d_]+", token) if len(w) > 1)


class CharacterModel:
    """Trigram log probabilities from counts, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray, words=()):
        counts = counts.astype(float).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        if words:  # the model's own words get a small share, so that rare ones can be restored
            own = np.zeros_like(counts)
            for word in words:
                s = [0, 0, *map(symbol, word), 0]
                for a, b, c in zip(s, s[1:], s[2:]):
                    own[a, b, c] += 1
            counts = counts + own * (0.02 * max(counts.sum(), 1.0) / max(own.sum(), 1.0))
        one = counts.sum((0, 1)) + 1.0
        one /= one.sum()
        two = counts.sum(0) + 5.0 * one
        two /= two.sum(1, keepdims=True)
        three = counts + 5.0 * two[None]
        self.log = np.log(three / three.sum(2, keepdims=True)).tolist()

    def decode(self, token: str) -> str:
        """The likeliest source of ``token``."""
        return self.sources(token)[0]

    def sources(self, token: str) -> list[str]:
        """Likely sources, best first: of the ``PATHS`` best paths to each state (last two
        letters) at the end those with a log probability within ``MARGIN`` of the best.
        """
        # A path is its score, a code of its letters, and (path before, last letters).
        best: list[dict[tuple[int, int], list]] = [{} for _ in range(len(token) + 1)]
        best[0][(0, 0)] = [(0.0, 0, None)]
        run = 0
        for at, char in enumerate(token):
            if run <= at:
                run = at + 1
                while run < len(token) and token[run] == char:
                    run += 1
            if not best[at]:
                continue
            arcs: list[tuple[str, int, float]] = []
            if char in SEPARATORS:
                arcs.append(("", run, 0.1))
            elif char in LOOKALIKES:
                for letter in LOOKALIKES[char]:
                    arcs.append((letter, at + 1, 0.5))
                    if run > at + 1:
                        arcs += [(letter, run, 1.0), (letter * 2, run, 1.0)]
                arcs.append(("", run, 6.0))
            else:
                arcs.append((char, at + 1, 0.0))
                if bare(char) != char:
                    arcs.append((bare(char), at + 1, 0.5))
                if run > at + 1:
                    arcs += [(char, run, 1.0), (char * 2, run, 0.5)]
            for (a, b), paths in best[at].items():
                for letters, to, cost in arcs:
                    x, y, gain = a, b, -cost
                    for one in letters:
                        z = symbol(one)
                        gain += self.log[x][y][z]
                        x, y = y, z
                    held = best[to].setdefault((x, y), [])
                    for score, code, node in paths:
                        held.append((score + gain, coded(code, letters), (node, letters) if letters else node))
                    if len(held) > PATHS:
                        held[:] = leading(held)
            if at:
                best[at] = {}
        ends = {}
        for (a, b), paths in best[-1].items():
            for score, _, node in paths:
                text = spelled(node)
                ends[text] = max(score + self.log[a][b][0], ends.get(text, -np.inf))
        ranked = sorted(((score, text) for text, score in ends.items()), reverse=True)
        return [text for score, text in ranked if score >= ranked[0][0] - MARGIN]


def coded(code: int, letters: str) -> int:
    for one in letters:
        code = (code * 1_000_003 + ord(one)) % ((1 << 61) - 1)
    return code


def spelled(node) -> str:
    """The letters of a path, followed back to its start."""
    out = []
    while node is not None:
        node, letters = node
        out.append(letters)
    return "".join(reversed(out))


def leading(held: list) -> list:
    """The ``PATHS`` best paths; of equal scores with equal letters one."""
    out: list = []
    for path in sorted(held, key=lambda p: (p[0], p[1]), reverse=True):
        if not out or out[-1][:2] != path[:2]:
            out.append(path)
    return out[:PATHS]


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams in all documents; each batch is summed before the shuffle."""
    small_batches(docs.sparkSession)
    code = np.zeros(256, np.int64)
    for i in range(26):
        code[65 + i] = code[97 + i] = i + 1
    code[128:] = 27

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, _ = strings(batch.column(0))
            for at in range(0, len(data), 1 << 20):
                part = code[data[max(0, at - 2) : at + (1 << 20)]]
                if len(part) > 2:
                    trigram = (part[:-2] * SYMBOLS + part[1:-1]) * SYMBOLS + part[2:]
                    total += np.bincount(trigram, minlength=SYMBOLS**3)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["trigram", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "trigram long, n long")
    out = np.zeros(SYMBOLS**3, np.int64)
    for trigram, n in rows.groupBy("trigram").agg(F.sum("n")).collect():  # at most 28^3 rows
        out[trigram] = n
    return out


class Restorer:
    """Words of a text that the classifier knows, plain or disguised."""

    def __init__(self, weights: dict[str, float], counts: np.ndarray):
        self.weights = weights
        self.model = CharacterModel(counts, [w.rstrip("*") for w in weights])
        self.skeletons = {skeleton(w.rstrip("*")) for w in weights}
        self.lengths = sorted({len(s) for s in self.skeletons})
        self.heads = {w.rstrip("*")[: PREFIXES.start] for w in weights}
        self.shortest = self.lengths[0] if self.lengths else 0
        self.starts = {s[:n] for s in self.skeletons for n in range(self.shortest + 1)}
        self.longest = max((len(w) for w in weights), default=0)
        # No known word, and no beginning of one, takes more runs of characters than these.
        self.runs = 2 * max(self.longest, max(PREFIXES)) + SPARE
        self.cache: dict[str, float] = {}

    def word(self, word: str) -> float:
        """Evidence of a restored word: that of its strongest feature, or zero."""
        if word[: PREFIXES.start] not in self.heads:
            return 0.0
        return max((self.weights.get(f, 0.0) for f in features_of(word)), default=0.0)

    def token(self, token: str) -> float:
        """Evidence of a token between blanks. Disguises are tried where one could fit."""
        bare_token = token.strip(MARKS)
        if bare_token.isascii() and bare_token.isalpha():
            found = self.word(bare_token)
            if found or not TWICE.search(bare_token) or not self.begins(skeleton(bare_token), 0):
                return found
        return sum(self.word(part) if plain(part) else self.part(part) for part in PARTS.findall(token))

    def begins(self, shape: str, longer_than: int) -> bool:
        """Whether ``shape`` begins with a known skeleton of more than so many letters."""
        if shape[: self.shortest] not in self.starts:
            return False
        return any(longer_than < n <= len(shape) and shape[:n] in self.skeletons for n in self.lengths)

    def part(self, part: str) -> float:
        """Known plain words count each; what is left is decoded from the start of every
        piece between separators that could begin with a known word.
        """
        total, groups = 0.0, [[]]
        for piece in PIECES.finditer(part):
            at = piece.start()
            for word in PLAIN.finditer(part, at, piece.end()):
                if found := self.word(word.group()):
                    total += found
                    if at < word.start():
                        groups[-1].append((at, word.start()))
                    groups.append([])
                    at = word.end()
            if at < piece.end():
                groups[-1].append((at, piece.end()))
        for pieces in groups:
            i = 0
            while i < len(pieces):
                found, used = self.disguised(part, pieces, i)
                total += found
                i += used
        return total

    def disguised(self, part: str, pieces: list[tuple[int, int]], i: int) -> tuple[float, int]:
        """Best evidence of a disguised word from piece ``i`` on, and how many pieces it takes."""
        shape, ends = "", []
        for j in range(i, min(len(pieces), i + self.runs)):
            piece = beginning(part[pieces[j][0] : pieces[j][1]], self.runs)
            before, shape = len(shape), skeleton(shape + piece)
            if shape[: self.shortest] not in self.starts:
                break
            if self.begins(shape, before):
                ends += [j, j + 1]  # a beginning may go on in the next piece
            if len(shape) >= max(self.lengths, default=0):
                break
        if ends and i == 0:
            ends.append(len(pieces) - 1)
        best, used = 0.0, 1
        for j in sorted({j for j in ends if j < len(pieces)}):
            span = beginning(part[pieces[i][0] : pieces[j][1]], self.runs)
            if plain(span):  # looked up before
                continue
            cores = {span, span.rstrip("!|+"), span.strip("!|+@$")}
            hidden = not span.isalpha() or not span.isascii() or re.search(r"(.)\1\1", span)
            most = None if hidden else 1  # ordinary words keep their likeliest reading
            found = max((self.word(w) for core in sorted(cores) for w in self.model.sources(core)[:most]), default=0.0)
            if found > best:
                best, used = found, j - i + 1
        return best, used

    def spaced(self, run: str) -> float:
        """Evidence of letters that were set apart: known words anywhere in the restored run.

        Only stretches around known skeletons are decoded; the rest can't hold a known word.
        """
        places, shape = [], []
        for at, char in enumerate(run):
            char = shape_of(char)
            if char and (not shape or shape[-1] != char):
                places.append(at)
                shape.append(char)
        shape, places = "".join(shape), [*places, len(run)]
        total, start, stop = 0.0, 0, 0
        for i in range(len(shape)):
            ends = [i + n for n in self.lengths if i + n <= len(shape) and shape[i : i + n] in self.skeletons]
            if not ends:
                continue
            first, last = places[max(i - 2, 0)], places[min(max(ends) + 2, len(shape))]
            if first >= stop:
                total += self.stretch(run[start:stop])
                start = first
            stop = max(stop, last)
        return total + self.stretch(run[start:stop])

    def stretch(self, letters: str) -> float:
        """Evidence of the source of ``letters`` that has most of it."""
        letters = beginning(letters, len(letters))
        return max((self.inside(restored) for restored in self.model.sources(letters)), default=0.0) if letters else 0.0

    def inside(self, restored: str) -> float:
        """Evidence of the known words in a run of letters, longest first from the left."""
        total, at = 0.0, 0
        while at < len(restored):
            most = min(len(restored), at + self.longest)
            end = next((e for e in range(most, at + 2, -1) if restored[at:e] in self.weights), 0)
            total += self.weights[restored[at:end]] if end else 0.0
            at = end or at + 1
        return total

    def text(self, text: str) -> tuple[float, int]:
        """Evidence of a text and its number of tokens."""
        tokens = text.lower().split()
        if len(self.cache) > CACHE:
            self.cache.clear()
        total, cache = 0.0, self.cache
        for token, n in Counter(tokens).items():
            if (found := cache.get(token)) is None:
                found = self.token(token)
                if len(token) <= LONG_TOKEN:
                    cache[token] = found
            total += found * n
        for run in spaced_letters(tokens):
            total += self.spaced(run)
        return total, len(tokens)


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from: crc32 of the id as text is divisible by five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[DataFrame, float]:
    """Texts and labels of at most ``limit`` rows of either class, and the share of toxic rows.

    The rows are those with the smallest hash of their id, so the list of ids is bounded
    and is sent to the scan. The share comes from all rows that may be learnt from.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(limit) for c in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(texts.join(chosen, "id").select("text", "toxic"), "training"), share


def word_weights(rows: DataFrame) -> dict[str, float]:
    """Log rate ratios of the words and beginnings that tell the classes apart.

    Only features in ``SUPPORT`` of the toxic rows (``MIN_DOCS`` at least) can be in the
    result, which bounds their number by the words of a row over that share.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(part["text"], part["toxic"]):
                own: Counter = Counter()
                for word, n in Counter(plain_words(text.lower())).items():
                    for feature in features_of(word):
                        own[feature] += n
                for feature, n in own.items():
                    row = seen.setdefault(feature, [0, 0, 0, 0])
                    row[toxic] += 1
                    row[2 + toxic] += n
            yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["feature", "clean", "toxic", "clean_n", "toxic_n"])

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return {}
    sums = rows.mapInPandas(count, "feature string, clean long, toxic long, clean_n long, toxic_n long").groupBy("feature")
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "clean_n", "toxic_n")])
    table = sums.where(F.col("toxic") >= max(MIN_DOCS, SUPPORT * toxic)).where(F.col("toxic") * clean > F.col("clean") * toxic * 3)
    out = {}
    for r in table.collect():
        n, p = r["clean"] + r["toxic"], toxic / (clean + toxic)
        a = r["toxic"] * np.log(r["toxic"] / (n * p))
        b = r["clean"] * np.log(r["clean"] / (n * (1 - p))) if r["clean"] else 0.0
        if 2 * (a + b) >= SIGNIFICANT:
            out[r["feature"]] = (r["toxic_n"], float(np.log((r["toxic_n"] + 0.5) / toxic) - np.log((r["clean_n"] + 0.5) / clean)))
    # A beginning says more than its words only if no single longer feature explains it.
    longest: dict[str, int] = {}
    for feature, (n, _) in out.items():
        for shorter in features_of(feature.rstrip("*"))[1:]:
            longest[shorter] = max(longest.get(shorter, 0), n)
    return {f: w for f, (n, w) in out.items() if longest.get(f, 0) < OWN_SHARE * n}


def _design(evidence, words) -> np.ndarray:
    evidence = np.asarray(evidence, float)
    size = np.log1p(np.asarray(words, float))
    return np.stack([np.ones(len(evidence)), evidence > 0, np.minimum(evidence, 30.0), size * (evidence > 0)], axis=1).astype(float)


def calibrate(evidence, words, toxic, share: float) -> np.ndarray:
    """Weights of a logistic model by Newton steps; classes count as their share of all labels."""
    x, y = _design(evidence, words), np.asarray(toxic, float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[dict, np.ndarray, np.ndarray]:
    """Word weights, character counts and calibration."""
    rows, share = training_rows(docs, labels, limit)
    weights = word_weights(rows)
    counts = character_counts(docs)
    if not weights:
        return {}, counts, np.array([np.log(max(share or 0.0, 1e-9) / max(1 - (share or 0.0), 1e-9)), 0.0, 0.0, 0.0])
    scored = _evidence(rows.select("toxic", "text"), weights, counts, "toxic int").collect()  # 2 x limit rows at most
    return weights, counts, calibrate([r[1] for r in scored], [r[2] for r in scored], [r[0] for r in scored], share)


def _evidence(rows: DataFrame, weights: dict, counts: np.ndarray, key: str) -> DataFrame:
    """The key column, evidence and token count of each row of (key, text)."""
    small_batches(rows.sparkSession)
    model = rows.sparkSession.sparkContext.broadcast((weights, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*model.value)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            found = [restorer.text(t) for t in texts]
            arrays = [batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key.split()[0], "evidence", "words"])

    return rows.mapInArrow(run, f"{key}, evidence double, words long")


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The whole text is read; ids, languages, sources and labels are no input of a score.
    Null and empty texts get the score of a text without evidence. Repeated rows are
    scored each on its own. Without labels of both classes every score is the share of
    toxic labels (zero without any). Other columns are not read.
    """
    weights, counts, beta = train(docs, labels, limit)
    rows = _evidence(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), weights, counts, "doc_id long")
    b = [F.lit(float(x)) for x in beta]
    some = (F.col("evidence") > 0).cast("double")
    logit = b[0] + b[1] * some + b[2] * F.least("evidence", F.lit(30.0)) + b[3] * F.log1p(F.col("words").cast("double")) * some
    score = 1 / (1 + F.exp(-logit))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were.

    The score rides along with the row, so no join and no identity of rows is needed.
    """
    weights, counts, beta = train(docs, labels)
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((weights, counts, beta))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, counts, beta = model.value
        restorer = Restorer(weights, counts)
        for batch in batches:
            found = [restorer.text(t) for t in batch.column(at).fill_null("").to_pylist()]
            logit = _design([f[0] for f in found], [f[1] for f in found]) @ beta
            yield batch.filter(pa.array(logit < 0))

    return docs.mapInArrow(run, docs.schema)
