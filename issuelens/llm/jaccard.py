"""Near copies by exact Jaccard similarity of word shingles: fingerprints, then a prefix-filtered join.

SimHash fingerprints of the sets meet by their distances to references, and what is near
is verified on whole sets. Sets of that similarity may differ in more bits than
fingerprints can be searched for, so an exact join looks at all that is not connected then.

Two sets with similarity t share one of the first n - ceil(t n) + 1 shingles of either in
any order common to all, so only sets that share one of those meet. Shingles are ordered
by how often they occur in all texts, in hashed counters, so common passages come last;
every order gives the same result. Sets that meet are compared by length, by the place
of the shared shingle and by a bitmap of parities before any pair becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.common import LOWER, Scratch, strings, text_slices
from issuelens.llm.components import components
from issuelens.llm.keep import sifted
from issuelens.llm.simhash import majority, near_links
from issuelens.operators.small import shuffled, sized

SEED = 42
COUNTERS = 1 << 18
HOT_BUCKET = 1024
SMALL_SIDE = 1 << 18
PRINT_BITS = 6


def shingles_of(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of all ``width``-word shingles.

    Words as in ``simhash.fingerprint_of``; fewer words than ``width`` make one shingle.
    """
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(words)) - 1
    digest, total = xxhash.xxh64_intdigest, len(words) - span
    pairs = zip(starts[:total].tolist(), ends[span:].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, total).view(np.int64))


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    data, at = strings(texts)
    data = data.tobytes()
    return [shingles_of(data[a:b], width) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """The columns of ``rows`` but its text, and the shingles of each whole text."""
    keys = rows.drop("text")
    names = [*keys.columns, "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1):
                *held, texts = part.columns
                yield pa.RecordBatch.from_arrays([*held, _lists(_sets(texts, width))], names=names)

    schema = keys.withColumn("shingles", F.array().cast("array<long>")).schema
    return rows.select(*keys.columns, F.col("text").cast("string")).mapInArrow(run, schema)


def shingle_counts(rows: DataFrame, width: int, counters: int = COUNTERS) -> np.ndarray:
    """How many (text, shingle) pairs of all rows fall on each of ``counters`` hashed counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(counters, np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                own = np.concatenate([np.zeros(0, np.int64), *_sets(part.column(0), width)])
                held += np.bincount((own.view(np.uint64) % np.uint64(counters)).astype(np.int64), minlength=counters)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])], names=["counter", "n"])

    found = rows.select(F.col("text").cast("string")).mapInArrow(run, "counter int, n long")
    found = found.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # a row per counter at most
    out = np.zeros(counters, np.int64)
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def parities(own: np.ndarray) -> bytes:
    """A bitmap of one to two bits a shingle; a bit is the parity of the shingles that hash to it."""
    bits = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    count = np.bincount((own.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with ``words`` * 64 bits; ``bitmap`` has as many or more."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def prefixes(rows: DataFrame, width: int, threshold: float, counters: int = COUNTERS) -> DataFrame:
    """The columns of ``rows`` but its text; node, a digest of the set; its size, prefix, bitmap and fingerprint."""
    keys = rows.drop("text")
    names = [*keys.columns, "node", "size", "prefix", "bitmap", "fingerprint"]
    sent = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows, width, counters))  # one number a counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1):
                *held, texts = part.columns
                node, size, prefix, bitmap, prints = [], [], [], [], []
                for own in _sets(texts, width):
                    often = counts[(own.view(np.uint64) % np.uint64(counters)).astype(np.int64)]
                    first = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1 if len(own) else 0
                    node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                    size.append(len(own))
                    prefix.append(own[np.lexsort((own, often))[:first]])
                    bitmap.append(parities(own))
                    prints.append(majority(own.view(np.uint64)))
                node = pa.array(np.array(node, np.uint64).view(np.int64))
                arrays = [*held, node, pa.array(size, pa.int32()), _lists(prefix), pa.array(bitmap, pa.binary()), pa.array(prints, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    made = {"node": F.lit(0).cast("long"), "size": F.lit(0), "prefix": F.array().cast("array<long>"), "bitmap": F.lit(b""), "fingerprint": F.lit(0).cast("long")}
    return rows.select(*keys.columns, F.col("text").cast("string")).mapInArrow(run, keys.withColumns(made).schema)


def may_reach(size: np.ndarray, other: np.ndarray, apart: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets whose bitmaps differ in ``apart`` bits may have the similarity: no fewer shingles differ."""
    return (size + other - apart) / 2 >= threshold / (1 + threshold) * (size + other) - 1e-9


def _print_pairs(nodes: DataFrame, within: int, scratch: Scratch) -> DataFrame:
    """a, b: links between the first sets of fingerprints at most ``within`` bits apart, and from
    each such set to the others of its fingerprint."""
    prints = scratch.write(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "prints")
    links = near_links(prints.select("fingerprint"), within).distinct()
    firsts = sized(prints)
    for side in ("a", "b"):
        links = links.join(firsts.select(F.col("fingerprint").alias(side), F.col("first").alias(f"{side}_node")), side)
    equal = nodes.select("node", "fingerprint").join(firsts, "fingerprint").where("node <> first")
    pairs = links.select("a_node", "b_node").union(equal.select("first", "node"))
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def _first_pairs(prints: DataFrame, buckets: DataFrame, nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """a, b: the pairs of ``prints``, and for each set the smallest of the first sets of its buckets, that bitmaps may reach."""
    hubs = buckets.where(F.col("node") > F.col("hub.node")).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    pairs = hubs.withColumn("linked", F.lit(False)).union(prints.withColumn("linked", F.lit(True)))
    pairs = pairs.groupBy("a", "b").agg(F.max("linked").alias("linked"))
    for side in ("a", "b"):
        held = nodes.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("bitmap").alias(f"{side}_bits"))
        pairs = pairs.join(shuffled(held), side)
    pairs = pairs.where(F.least("a_size", "b_size") >= threshold * F.greatest("a_size", "b_size") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (5, 6)]
            words = [min(len(x), len(y)) for x, y in zip(*bits)]
            apart = [int(np.bitwise_count(folded(x, w) ^ folded(y, w)).sum()) for x, y, w in zip(*bits, words)]
            kept = may_reach(batch.column(3).to_numpy(), batch.column(4).to_numpy(), np.array(apart, np.int64), threshold)
            yield batch.select([0, 1, 2]).filter(pa.array(kept))

    pairs = pairs.select("a", "b", "linked", "a_size", "b_size", "a_bits", "b_bits")
    pairs = scratch.write(pairs.mapInArrow(run, "a long, b long, linked boolean"), "first")
    return pairs.where("linked").select("a", "b").union(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct()


def bucket_pairs(size: np.ndarray, place: np.ndarray, label: np.ndarray, own: np.ndarray, bitmaps: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j of one bucket with different labels that may reach the threshold.

    ``size`` ascends; ``place`` is where the shingle of the bucket stands in each prefix. A
    pair of sets needs to pass at the first shingle both prefixes have, so what comes
    before it is not shared. Rows of one share, told by ``own``, do not meet unless it is -1.
    """
    maps = [np.frombuffer(b, np.uint64) for b in bitmaps]
    words = np.array([len(m) for m in maps])
    cuts = {w: (int(np.searchsorted(words, w)), int(np.searchsorted(words, w, "right"))) for w in np.unique(words).tolist()}
    table = {w: np.stack(maps[a:b]) for w, (a, b) in cuts.items()}
    end = np.searchsorted(size, size / threshold + 1e-6, "right")
    left, right = [], []
    for i in range(len(size)):
        for w, (a, b) in cuts.items():
            a, b = max(a, i + 1), min(b, int(end[i]))
            if w < words[i] or a >= b:
                continue
            j = np.arange(a, b)
            shared = np.minimum(size[i] - place[i], size[j] - place[j])
            j = j[(label[j] != label[i]) & ((own[i] < 0) | (own[j] != own[i])) & (shared >= threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9)]
            if len(j):
                apart = np.bitwise_count(folded(table[w][j - cuts[w][0]], words[i]) ^ maps[i]).sum(axis=1).astype(np.int64)
                j = j[may_reach(size[i], size[j], apart, threshold)]
                left.append(np.full(len(j), i))
                right.append(j)
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *left]), np.concatenate([nothing, *right])


def _open_pairs(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: float, hot: int) -> DataFrame:
    """a, b: pairs in buckets that hold more than one label, compared where the bucket is.

    A bucket of more than ``hot`` rows is dealt into shares; every two shares meet in a
    group of their own.
    """
    by_key = Window.partitionBy("key")
    rows = buckets.drop("hub").join(sized(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = rows.withColumns({"low": F.min("label").over(by_key), "high": F.max("label").over(by_key), "n": F.count(F.lit(1)).over(by_key)})
    rows = rows.where("low < high").drop("low", "high").withColumn("shares", F.ceil(F.col("n") / hot).cast("int"))
    rows = rows.join(shuffled(nodes.select("node", "bitmap")), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "shares").cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, shares - 1)")))
    share = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("own")
    bucket = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket")
    rows = rows.select(bucket, "size", "place", "label", share, "node", "bitmap")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "size")

    def pairs(rows: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        node, size, place, label, own = (rows[c].to_numpy() for c in ("node", "size", "place", "label", "own"))
        bitmaps = rows["bitmap"].to_pylist()
        found = [np.zeros((2, 0), np.int64)]
        for a, b in zip(cuts, cuts[1:]):
            of = slice(a, b)
            i, j = bucket_pairs(size[of], place[of], label[of], own[of], bitmaps[of], threshold)
            if len(i):
                found.append(np.sort(np.stack([node[of][i], node[of][j]]), axis=0))
        low, high = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = pa.concat_tables([*([rest] if rest is not None else []), pa.Table.from_batches([batch])])
            ids = rest["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()]
            if len(cuts) > 1:
                yield pairs(rest, cuts)
                rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield pairs(rest, [0, rest.num_rows])

    return rows.mapInArrow(run, "a long, b long").where("a < b").distinct()


def _verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame, width: int, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    pairs = scratch.write(pairs, "near")
    wanted = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    held = prints.join(sized(wanted, SMALL_SIDE), "node").groupBy("node").agg(F.min("text_key").alias("text_key"))
    held = scratch.write(held, "wanted")
    small = held.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    texts = rows.select("text_key", "text").join(F.broadcast(held) if small else shuffled(held), "text_key")
    texts = texts.groupBy("node").agg(F.first("text").alias("text")) if not small else texts.dropDuplicates(["node"])
    sets = scratch.write(shingle_sets(texts.select("node", "text"), width), "sets")
    for side in ("a", "b"):
        pairs = pairs.join(shuffled(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_shingles"))), side)
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    union = F.size("a_shingles") + F.size("b_shingles") - shared
    return scratch.write(pairs.where(shared >= threshold * union - 1e-9).select("a", "b"), "links")


def _nodes(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """node, size, prefix, bitmap and fingerprint of each distinct set; those of one text stay in the scan of ``prints``."""
    again = prints.groupBy("node").count().where("count > 1").select("node")
    sets = prints.select("node", "size", "prefix", "bitmap", "fingerprint")
    alone, others = sifted(sets, ["node"], again, scratch.write)
    return alone.unionByName(scratch.write(others.dropDuplicates(["node"]), "copies"))


def similar_classes(rows: DataFrame, width: int = 5, threshold: float = 0.8, hot: int = HOT_BUCKET, counters: int = COUNTERS) -> DataFrame:
    """id_key, text_key and ``label``: the smallest node reachable over pairs of sets of
    ``width``-word shingles with a Jaccard similarity of ``threshold`` or more.

    ``rows`` has id_key, text_key and text. Equal sets are one node, so copies are never
    paired; texts without words are equal. First sets meet whose fingerprints are linked
    over at most ``PRINT_BITS`` bits, and each set meets one of the first sets of its
    buckets; what passes is verified. Only buckets whose sets are not all connected then are compared in full,
    inside a task, and only pairs that pass all bounds leave it. Tables written on the way
    are removed at the end.
    """
    scratch = Scratch(rows.sparkSession)
    prints = scratch.write(prefixes(rows, width, threshold, counters), "prefixes")
    nodes = _nodes(prints, scratch)
    keyed = nodes.select("node", "size", F.posexplode("prefix").alias("place", "key"))
    own = Window.partitionBy("key")
    hub = F.min(F.struct("node", "size")).over(own)
    buckets = keyed.select("key", "node", "size", "place", F.count(F.lit(1)).over(own).alias("n"), hub.alias("hub"))
    buckets = scratch.write(buckets.where("n > 1").drop("n"), "buckets")

    near = _first_pairs(_print_pairs(nodes, PRINT_BITS, scratch), buckets, nodes, threshold, scratch)
    first = _verified(near, prints, rows, width, threshold, scratch)
    labels = components(first)
    second = _verified(_open_pairs(buckets, labels, nodes, threshold, hot), prints, rows, width, threshold, scratch)
    labels = components(first.union(second)) if not second.isEmpty() else labels
    joined = prints.select("id_key", "text_key", "node").join(sized(labels), "node", "left")
    classes = Scratch(rows.sparkSession).write(joined.select("id_key", "text_key", F.coalesce("label", "node").alias("label")), "classes")
    scratch.clear()
    return classes
