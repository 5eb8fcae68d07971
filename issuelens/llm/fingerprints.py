"""SimHash document fingerprints: weighted votes of term hashes, and a search by permuted block tables.

Terms are words and pairs of neighbouring words. A term weighs the more the rarer it is
among all documents, by a table of hashed counters. Each bit of the fingerprint is the sign
of the weighted votes of all terms.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import fresh, null_safe, strings, text_slices
from issuelens.llm.components import components
from issuelens.session import materialize

BITS = 128
SEED = 7
COUNTERS = 1 << 18
RADIUS = 3
BLOCKS = 5
RANGE_BYTES = 16 << 20
MOST_RANGES = 1 << 16
HOT_BUCKET = 1024
PENDING = 1 << 20


def _mixed(value: np.ndarray, salt: int) -> np.ndarray:
    """Well spread 64-bit numbers of 64-bit numbers."""
    value = value + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and pair of neighbouring words, and the text of each, texts in order.

    Words are split at ASCII white space. Each distinct word is hashed once.
    """
    lists = [t.split() for t in texts]
    at = np.cumsum([0, *map(len, lists)])
    known: dict[bytes, int] = defaultdict(count().__next__)
    word = np.fromiter((known[w] for w in chain.from_iterable(lists)), np.int64, int(at[-1]))
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in known), np.uint64, len(known))[word]
    near = np.flatnonzero(text[1:] == text[:-1])
    pairs = _mixed(hashes[near], 1) ^ _mixed(hashes[near + 1], 2)
    value, owner = np.r_[hashes, pairs], np.r_[text, text[near]]
    order = np.argsort(owner, kind="stable")
    return value[order], owner[order]


def term_counts(docs: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """How many terms of all documents fall on each of ``counters`` hashed counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(counters, np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                value, _ = terms(_texts(part.column(0)))
                held += np.bincount((value % np.uint64(counters)).astype(np.int64), minlength=counters)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])], names=["counter", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "counter int, n long")
    found = found.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # a row per counter at most
    out = np.zeros(counters, np.int64)
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def term_weights(counts: np.ndarray) -> np.ndarray:
    """Whole-number weights: eight times the binary logarithm of how rare a counter is."""
    rare = (counts.sum() + 1) / np.maximum(counts, 1)
    return np.round(8 * np.log2(rare)).astype(np.int32) + 1


def _texts(column: pa.Array) -> list[bytes]:
    data, ends = strings(column)
    data = data.tobytes()
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def fingerprints_of(texts: list[bytes], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """``bits`` / 64 unsigned numbers a text: a bit is set if more than half the weight of its terms votes for it."""
    value, owner = terms(texts)
    weight = weights[(value % np.uint64(len(weights))).astype(np.int64)].astype(np.float64)
    signs = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") - 1
    votes = np.zeros((len(texts), bits))
    for k in range(bits // 64):
        octets = np.ascontiguousarray(_mixed(value, 3 + k)).view(np.uint8).reshape(-1, 8)
        for at in range(8):
            # The weight of each value of an octet a text; whole numbers, so sums are exact.
            held = np.bincount(owner * 256 + octets[:, at], weight, 256 * len(texts)).reshape(-1, 256)
            column = 64 * k + 8 * at
            votes[:, column : column + 8] = held @ signs
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(one ^ other).sum(axis=1) / (64 * one.shape[1])


def hexadecimal(prints: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in prints])


def id_cuts(rows: DataFrame, most_bytes: int = RANGE_BYTES) -> np.ndarray:
    """Ids between ranges of about ``most_bytes`` of text; an id that fills n ranges is there n times or so."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, 1 + size // most_bytes)
    if ranges < 2:
        return np.zeros(0, np.int64)
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    return np.array(rows.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 4 * ranges)))).first()[0], np.int64)


def range_of(ids: np.ndarray, digests: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The range of each (id, digest): from cut to cut, an id of several cuts by equal shares of its digests."""
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    many = np.maximum(high - low, 1)
    share = (digests.view(np.uint64) ^ np.uint64(1 << 63)) // (np.uint64(2**64 - 1) // many.astype(np.uint64))
    return np.where(high > low, low + 1 + np.minimum(share.astype(np.int64), many - 1), low)


def in_order(docs: DataFrame, most_bytes: int = RANGE_BYTES) -> DataFrame:
    """part, last, id, digest, doc_id, text: rows by (part, last, id, digest) in their partitions.

    Parts follow each other by doc_id, nulls first, equal ids by the digest of the text.
    The row after the end of a part, round to the first of all, is its ``last`` row. Texts
    move once.
    """
    digest = F.xxhash64("text", F.octet_length("text"))
    rows = docs.select(null_safe("doc_id").alias("id"), digest.alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = id_cuts(rows, most_bytes)

    @F.pandas_udf("int")
    def part(ids, digests):
        return pd.Series(range_of(ids.to_numpy(), digests.to_numpy(), cuts).astype(np.int32))

    placed = rows.withColumn("part", part("id", "digest") if len(cuts) else F.lit(0))
    firsts = placed.groupBy("part").agg(F.min(F.struct("id", "digest")).alias("first")).orderBy("part").collect()  # a row per range
    before = [(r["first"]["id"], r["first"]["digest"], firsts[k - 1]["part"]) for k, r in enumerate(firsts)]
    before = docs.sparkSession.createDataFrame(before, "id long, digest long, before int")
    both = placed.join(F.broadcast(before), ["id", "digest"], "left")
    own, other = F.struct("part", F.lit(0).alias("last")), F.struct(F.col("before").alias("part"), F.lit(1).alias("last"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))
    both = both.withColumn("place", F.explode(places)).select("place.part", "place.last", "id", "digest", "doc_id", "text")
    return both.repartition("part").sortWithinPartitions("part", "last", "id", "digest")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of the following one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_neighbours(docs: DataFrame, bits: int = BITS, most_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    ``near_next`` compares with the next row by doc_id, ``near_edited`` with the text whose
    last half is the first of the next row's. After the last row comes the first; a single
    row follows itself. Null ids come first, equal ids by a digest of their texts. Null
    texts are empty; without words a fingerprint is zero. An empty table gives an empty
    one; other columns are not read. A task holds some texts at a time.
    """
    weights = term_weights(term_counts(docs))
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # COUNTERS numbers
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """All rows but the last, next to the one after each."""
        part = rows.column(0).to_numpy()
        first = np.flatnonzero((part[:-1] == part[1:]) & (rows.column(1).to_numpy()[:-1] == 0))
        if not len(first):
            return None
        texts = [t or "" for t in rows.column(3).to_pylist()]
        data = [t.encode() for t in texts]
        changed = [edited(texts[i], texts[i + 1]).encode() for i in first]
        prints = fingerprints_of(data + changed, sent.value, bits)
        own, following, new = prints[first], prints[first + 1], prints[len(data) :]
        arrays = [
            rows.column(2).take(pa.array(first)),
            pa.array([len(texts[i]) for i in first], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
            hexadecimal(own),
            hexadecimal(new),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, following)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for rows in text_slices(batch, 3, 1 << 20):
                if held is not None:
                    rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                out = compared(rows)
                held = rows.slice(rows.num_rows - 1)
                if out is not None:
                    yield out

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, most_bytes).select("part", "last", "doc_id", "text").mapInArrow(run, schema)


def block_tables(radius: int = RADIUS, blocks: int = BLOCKS, bits: int = BITS) -> list[Column]:
    """The key of a fingerprint (hex text ``node``) in every table: fingerprints within ``radius`` share one.

    With more blocks of bits than bits may differ, ``blocks`` - ``radius`` blocks are equal;
    a table puts that many blocks first, for every choice of them.
    """
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    digits = bits // 4
    cuts = [digits * i // blocks for i in range(blocks + 1)]
    tables = []
    for at, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        lead = F.concat(*[F.substring("node", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in chosen])
        tables.append(F.concat(F.lit(f"{at}:"), lead))
    return tables


def _connected(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``label``, the smallest row connected with each row, after some more pairs of rows."""
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def bucket_forest(group: np.ndarray, own: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row of its group that each row is connected with, over prints within ``radius`` bits.

    ``group`` ascends. Rows of a group of two shares, told by ``own``, meet those of the
    other share only; a group of one share has ``own`` -1.
    """
    label, pairs, held = np.arange(len(group)), [], 0
    end = np.searchsorted(group, group, "right")
    live, apart = np.arange(len(group)), 1
    while len(live := live[live + apart < end[live]]):
        i, j = live, live + apart
        meet = (own[i] < 0) | (own[i] != own[j])
        i, j = i[meet], j[meet]
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= radius
        pairs.append((i[near], j[near]))
        held += int(near.sum())
        if held > PENDING:
            label, pairs, held = _connected(label, pairs), [], 0
        apart += 1
    return _connected(label, pairs) if pairs else label


def near_links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bits: int = BITS, hot: int = HOT_BUCKET) -> DataFrame:
    """a, b: links between the distinct fingerprints ``node`` that connect all within ``radius`` bits.

    Each bucket of a table gives a spanning forest. A bucket of more than ``hot`` rows is
    dealt into shares; every two shares meet in a group of their own.
    """
    keyed = nodes.select("node", F.explode(F.array(*block_tables(radius, blocks, bits))).alias("key"))
    keyed = keyed.select("node", F.xxhash64("key").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(materialize(sizes, "tables"), "key").withColumn("shares", F.ceil(F.col("n") / hot).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, shares - 1)")))
    share = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("own")
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), share, "node")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")

    def links(rows: pa.Table) -> pa.RecordBatch:
        bucket, own, node = (rows[c].combine_chunks() for c in ("bucket", "own", "node"))
        names = node.to_pylist()
        prints = np.frombuffer(bytes.fromhex("".join(names)), np.uint64).reshape(len(names), -1)
        ids = bucket.to_numpy()
        label = bucket_forest(np.cumsum(np.r_[0, ids[1:] != ids[:-1]]), own.to_numpy(), prints, radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([node.take(pa.array(label[linked])), node.take(pa.array(linked))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = pa.concat_tables([*([rest] if rest is not None else []), pa.Table.from_batches([batch])])
            ids = rest["bucket"].to_numpy()
            change = np.flatnonzero(ids[1:] != ids[:-1])
            if len(change):
                yield links(rest.slice(0, change[-1] + 1))
                rest = rest.slice(change[-1] + 1)
        if rest is not None and rest.num_rows:
            yield links(rest)

    return rows.mapInArrow(run, "a string, b string")


def near_classes(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bits: int = BITS) -> DataFrame:
    """``prints`` and class_id: the smallest doc_id reachable over fingerprints within ``radius`` bits.

    Equal fingerprints are one node. Null ids do not count; null if there is no other.
    """
    name, low = fresh(prints, "node"), fresh(prints, "label")
    nodes = materialize(prints.select(F.col("fingerprint").alias("node")).distinct(), "nodes")
    labels = components(near_links(nodes, radius, blocks, bits)).toDF(name, low)
    joined = prints.join(labels, prints["fingerprint"] == labels[name], "left")
    joined = joined.withColumn(low, F.coalesce(low, "fingerprint")).drop(name)
    firsts = joined.groupBy(low).agg(F.min("doc_id").alias("class_id"))
    return joined.join(firsts, low).drop(low)


def document_fingerprints(docs: DataFrame, bits: int = BITS, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Fingerprints of documents and their edited texts, and the class of fingerprints near each.

    See :func:`compare_neighbours` for nulls, ties and empty tables, and :func:`near_classes`.
    """
    compared = materialize(compare_neighbours(docs, bits), "fingerprints")
    return near_classes(compared, radius, blocks, bits)
