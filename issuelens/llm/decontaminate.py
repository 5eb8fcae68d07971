"""Benchmark decontamination over a positional inverted index that is cut by documents.

The index has a row per segment (some megabytes of whole documents): the terms, how often
each occurs, and all their word positions, sorted by term. Positions run through the
segment with a gap after each document, so no phrase crosses documents. A phrase is found
by taking the positions of its rarest term, shifted by the term's place in the phrase, and
keeping those that the lists of the next rarest terms have too, down to the most frequent.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import LOWER, WORD, small_batches, strings
from issuelens.operators.small import shuffled
from issuelens.session import scratch_path

BLOCK_BYTES = 16 << 20
CANDIDATES = 1 << 21
INDEX = "segment string, doc_ids array<long>, n_words array<int>, terms array<int>, counts array<int>, gaps array<int>"
HIT = "segment string, doc int, start int, length int, window int, block int"
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER))


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """Lists of (item_id, text) rows; a list holds about ``limit`` bytes of text.

    The size is measured first; a benchmark beyond the limit is dealt into blocks by
    digest and each block makes a pass of its own over the index.
    """
    rows = items.select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // limit)
    for block in range(n):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()


def windows_of(rows: list, width: int) -> dict[tuple[bytes, ...], list]:
    """Each distinct window of ``width`` words (shorter items: the item) and its items."""
    found: dict[tuple[bytes, ...], set] = {}
    for item, text in rows:
        words = words_of(text.encode())
        for at in range(max(1, len(words) - width + 1) if words else 0):
            found.setdefault(tuple(words[at : at + width]), set()).add(item)
    return {w: sorted(x for x in ids if x is not None) for w, ids in found.items()}


def build_index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Postings of ``terms`` in all documents, stored. ``terms`` are numbered from 0."""
    spark = docs.sparkSession
    small_batches(spark)
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    out = INDEX

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.value.get
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = strings(batch.column(1))
            data = data.tobytes()
            parts, lengths, base = [], [], 0
            for i in range(batch.num_rows):
                words = words_of(data[at[i] : at[i + 1]])
                ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                held = np.flatnonzero(ids >= 0)
                parts.append(ids[held] << 32 | held + base)
                lengths.append(len(words))
                base += len(words) + 1
            keys = np.sort(np.concatenate(parts))
            held, counts = np.unique(keys >> 32, return_counts=True)
            places = (keys & 0xFFFFFFFF).astype(np.int32)
            row = {
                "segment": [uuid.uuid4().hex],
                "doc_ids": [batch.column(0).to_pylist()],
                "n_words": [lengths],
                "terms": [held],
                "counts": [counts],
                "gaps": [np.diff(places, prepend=np.int32(0))],
            }
            kinds = [pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds)], list(row))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(index, out)
    path = scratch_path(spark, "postings")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out).parquet(path)


def term_counts(index: DataFrame, n: int) -> np.ndarray:
    """How often each term occurs in the corpus; one number per benchmark term."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    out = np.zeros(n, np.int64)
    for term, count in pairs.groupBy("x.terms").agg(F.sum("x.counts")).collect():
        out[term] = count
    return out


class Segment:
    """The postings of one index row, as sorted (term, position) keys."""

    def __init__(self, terms, counts, gaps, n_words):
        self.terms = np.asarray(terms, np.int64)
        self.keys = np.repeat(self.terms, counts) << 32 | np.cumsum(np.asarray(gaps, np.int64))
        self.first = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
        self.bases = np.concatenate(([0], np.cumsum(np.asarray(n_words, np.int64) + 1)))

    def slices(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        return self.first[at], np.where(known, self.first[at + 1] - self.first[at], 0)

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms << 32 | places
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (places >= 0) & (self.keys[at] == wanted)

    def phrases(self, words: np.ndarray, order: np.ndarray, lengths: np.ndarray):
        """(window, place) of every exact occurrence. ``order``: places, rarest term first."""
        rarest = words[np.arange(len(words)), order[:, 0]]
        first, count = self.slices(rarest)
        live = np.flatnonzero(count)
        cuts = np.flatnonzero(np.diff(np.cumsum(count[live]) // CANDIDATES, prepend=0))
        for part in np.split(live, cuts):
            if not len(part):
                continue
            window = np.repeat(part, count[part])
            within = np.arange(len(window)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            start = (self.keys[first[window] + within] & 0xFFFFFFFF) - order[window, 0]
            for k in range(1, order.shape[1]):
                place = order[window, k]
                keep = (lengths[window] <= k) | self.has(words[window, place], start + place)
                window, start = window[keep], start[keep]
            yield window, start

    def near(self, terms: np.ndarray, within: int) -> np.ndarray:
        """Places where a stretch of ``within`` words begins that holds all ``terms``."""
        first, count = self.slices(terms)
        if not len(terms) or not count.all():
            return np.zeros(0, np.int64)
        rare = int(np.argmin(count))
        held = self.keys[first[rare] : first[rare] + count[rare]] & 0xFFFFFFFF
        starts = np.unique(np.maximum(held[:, None] - np.arange(within)[None, :], 0))
        end = np.minimum(starts + within, self.bases[np.searchsorted(self.bases, starts, "right")] - 1)
        for f, c in zip(first, count):
            own = self.keys[f : f + c] & 0xFFFFFFFF
            at = np.searchsorted(own, starts)
            keep = (at < c) & (own[np.minimum(at, c - 1)] < end)
            starts, end = starts[keep], end[keep]
        return starts


def find_phrases(index: DataFrame, windows: list[tuple[bytes, ...]], number: dict, counts: np.ndarray, block: int = 0) -> DataFrame:
    """All occurrences of the windows: segment, doc (place in it), start, length, window."""
    width = max((len(w) for w in windows), default=1)
    words = np.full((len(windows), width), -1, np.int64)
    for i, w in enumerate(windows):
        words[i, : len(w)] = [number[x] for x in w]
    lengths = np.array([len(w) for w in windows], np.int64)
    rarity = np.where(words >= 0, counts[words], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    sent = index.sparkSession.sparkContext.broadcast((words, order, lengths))

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, order, lengths = sent.value
        for part in parts:
            for row in part.itertuples(index=False):
                segment = Segment(row.terms, row.counts, row.gaps, row.n_words)
                for window, start in segment.phrases(words, order, lengths) if len(words) else ():
                    doc = np.searchsorted(segment.bases, start, "right") - 1
                    yield pd.DataFrame(
                        {
                            "segment": row.segment,
                            "doc": doc,
                            "start": start - segment.bases[doc],
                            "length": lengths[window],
                            "window": window,
                            "block": block,
                        }
                    )

    return index.select("segment", "n_words", "terms", "counts", "gaps").mapInPandas(search, HIT)


def find_near(index: DataFrame, terms: list[int], within: int) -> DataFrame:
    """doc_id, start: every stretch of ``within`` words of a document that holds all terms."""

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                segment = Segment(row.terms, row.counts, row.gaps, row.n_words)
                start = segment.near(np.array(terms, np.int64), within)
                doc = np.searchsorted(segment.bases, start, "right") - 1
                ids = np.asarray(row.doc_ids, object)[doc] if len(doc) else []
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": start - segment.bases[doc]})

    return index.mapInPandas(search, "doc_id long, start long")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, limit: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of any ``width`` consecutive words of an
    item (of the whole item, if shorter). Null texts have no words; items without words
    match nothing; an item with a null id hits words but is not counted or listed;
    repeated items count once; repeated document rows are judged each on its own. Other
    columns are not read. Without items or documents the result is clean or empty.
    """
    blocks = [windows_of(rows, width) for rows in item_blocks(items, limit)]
    terms = sorted({word for windows in blocks for window in windows for word in window})
    number = {t: i for i, t in enumerate(terms)}
    index = build_index(docs, terms)
    counts = term_counts(index, len(terms)) if terms else np.zeros(1, np.int64)
    hits, names = None, []
    for k, windows in enumerate(blocks):
        names.append(list(windows.values()))
        found = find_phrases(index, list(windows), number, counts, k)
        hits = found if hits is None else hits.unionByName(found)
    items_of = docs.sparkSession.sparkContext.broadcast(names)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                yield _judged(row.doc_ids, row.n_words, row.hits, items_of.value)

    segments = index.select("segment", "doc_ids", "n_words")
    if hits is None:
        joined = segments.withColumn("hits", F.expr("array()").cast("array<struct<doc:int,start:int,length:int,window:int,block:int>>"))
    else:
        hits = hits.groupBy("segment").agg(F.collect_list(F.struct("doc", "start", "length", "window", "block")).alias("hits"))
        joined = segments.join(shuffled(hits), "segment", "left")
    return joined.select("doc_ids", "n_words", "hits").mapInPandas(judge, RESULT)


def _judged(doc_ids, n_words, hits, names) -> pd.DataFrame:
    n_words = np.asarray(n_words, np.int64)
    bases = np.concatenate(([0], np.cumsum(n_words + 1)))
    cover = np.zeros(bases[-1] + 1, np.int64)
    items: dict[int, set] = {}
    seen = set()
    for hit in hits if hits is not None else ():
        at = bases[hit["doc"]] + hit["start"]
        cover[at] += 1
        cover[at + hit["length"]] -= 1
        if (key := (hit["doc"], hit["block"], hit["window"])) not in seen:
            seen.add(key)
            items.setdefault(hit["doc"], set()).update(names[hit["block"]][hit["window"]])
    hit_words = np.concatenate(([0], np.cumsum(np.cumsum(cover) > 0)))
    n_hit = hit_words[bases[1:]] - hit_words[bases[:-1]]
    listed = [sorted(items.get(i, ())) for i in range(len(n_words))]
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if pd.isna(x) else int(x) for x in doc_ids], "Int64"),
            "n_words": n_words,
            "n_hit": n_hit,
            "n_items": [len(x) for x in listed],
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed],
            "contaminated": n_hit > 0,
        }
    )
