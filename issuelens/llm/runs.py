"""Periodic runs of words in texts, and the texts with their repetitions collapsed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import fresh, strings, text_slices
from issuelens.llm.repair import periodic_runs

LEAST = 12
POWERS = 2
MIX = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


def _repeating(words: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Whether each word is of a text in which some ``width`` words may occur twice.

    Told by 64-bit values: equal words always have equal ones, so no text is missed.
    """
    n = len(words) - width + 1
    if n < 2:
        return np.zeros(len(words), bool)
    value = text[:n].astype(np.uint64)
    for k in range(width):
        value = (value ^ (words[k : k + n].astype(np.uint64) + np.uint64(1))) * MIX
        value ^= value >> np.uint64(29)
    inside = np.flatnonzero(text[:n] == text[width - 1 :])
    order = inside[np.argsort(value[inside], kind="stable")]
    same = np.flatnonzero(value[order][1:] == value[order][:-1])
    marked = np.zeros(int(text[-1]) + 1, bool)
    marked[text[order[same]]] = True
    return marked[text]


def _collapsed(lists: list[list[bytes]], at: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words of each text joined by one space, without those after the first period of any run."""
    change = np.zeros(int(at[-1]) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    cut = np.zeros(len(lists), bool)
    cut[np.searchsorted(at, start, "right") - 1] = True
    out = []
    for i, words in enumerate(lists):
        if cut[i]:
            words = [words[k] for k in np.flatnonzero(kept[at[i] : at[i + 1]])]
        out.append(b" ".join(words))
    return out


def find_runs(docs: DataFrame, least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """The columns of ``docs`` but its text, and n_words, runs and collapsed of each whole text.

    Words are split at ASCII white space. A run is a longest stretch in which words a
    smallest period apart are equal, of ``least`` words and ``powers`` periods or more;
    ``runs`` has them by start (word numbers from 0), then period. ``collapsed`` is the
    text without the words that any run holds after its first period, joined by one space.

    Null and empty texts have no words, no runs and an empty collapsed text. Rows are
    independent of each other: repeated rows and ids give equal results, an empty table
    an empty one. A very long text is one piece of work; memory is about 100 bytes a word.
    Result columns take underscores where ``docs`` has their names; nothing is shuffled.
    """
    keys = docs.drop("text")
    names = [fresh(keys, c) for c in ("n_words", "runs", "collapsed")]
    names = [*keys.columns, *names]
    width = least - least // powers

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        *held, texts = batch.columns
        data, ends = strings(texts)
        data = data.tobytes()
        lists = [data[a:b].split() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        at = np.cumsum([0, *map(len, lists)])
        known: dict[bytes, int] = defaultdict(count().__next__)
        words = np.fromiter((known[w] for w in chain.from_iterable(lists)), np.int64, int(at[-1]))
        text = np.repeat(np.arange(len(lists)), np.diff(at))
        tried = np.flatnonzero(_repeating(words, text, width))
        start, end, period = periodic_runs(words[tried], text[tried], least, powers)
        start, end = tried[start], tried[end - 1] + 1
        first = at[np.searchsorted(at, start, "right") - 1]
        cuts = np.searchsorted(start, at)
        values = [pa.array(v) for v in (start - first, end - start, period)]
        runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(values, ["start", "length", "period"]))
        collapsed = pa.array(_collapsed(lists, at, start, end, period), pa.binary()).cast(pa.string())
        arrays = [*held, pa.array(np.diff(at)), runs, collapsed]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, batch.num_columns - 1):
                yield found(piece)

    columns = [F.col(f"`{c}`") for c in keys.columns]
    typed = keys.withColumns({names[-3]: F.lit(0).cast("long"), names[-2]: F.lit(None).cast(RUNS), names[-1]: F.lit("")})
    return docs.select(*columns, F.col("text").cast("string")).mapInArrow(run, typed.schema)


def longest_run(runs: Column) -> Column:
    """The run of the greatest length; of equal ones the first, then that of the smallest period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["n"].alias("length"), (-best["p"]).alias("period")))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; texts whose crc32 of the id ends in 0 become periodic.

    With h that number, g = floor(h / 10) and n words, all words from a = g % n on are
    the p = 1 + floor((n - a) / (3 + g % 8)) words there, over and over. Null ids have no
    such number and keep their text.
    """
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("w").cast("long")
    a = F.when(n > 0, F.col("g") % n).otherwise(0)
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("long")
    marked = marked.withColumns({"n": n, "a": a.cast("int"), "p": p.cast("int")})
    again = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), int(ceil((n - a) / p)))), 1, int(n - a))")
    periodic = F.array_join(F.concat(F.expr("slice(w, 1, a)"), again), " ")
    return marked.select("doc_id", F.when(F.size("w") > 0, periodic).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Runs of :func:`with_periods` texts: their number, the longest one, digests of all and of what is left."""
    found = find_runs(with_periods(docs.select("doc_id", F.col("text").cast("string"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    found = found.withColumn("best", longest_run(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
