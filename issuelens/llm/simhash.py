"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import LOWER, small_batches, strings
from issuelens.llm.components import components
from issuelens.operators.small import sized
from issuelens.session import materialize

SEED = 42
PIVOTS = 16
HOT_BUCKET = 1024
PENDING = 1 << 20


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none give zero."""
    ones, total = np.zeros(64, np.int64), len(hashes)
    for at in range(0, total, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprint_of(text: bytes, width: int = 4) -> int:
    """Majority of the bits of the XXH64 values of all ``width``-word shingles, repeats included.

    Words are split at ASCII white space after A-Z is lower-cased; fewer words than
    ``width`` make one shingle; no words give zero.
    """
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - span].tolist(), ends[span:].tolist())
    total = len(words) - span
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, total))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """The columns of ``docs`` but its text, and the fingerprint of each whole text."""
    small_batches(docs.sparkSession)
    keys = docs.drop("text")
    names = [*keys.columns, "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *held, texts = batch.columns
            data, at = strings(texts)
            data = data.tobytes()
            found = [fingerprint_of(data[at[i] : at[i + 1]], width) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(found, pa.int64())], names=names)

    rows = docs.select(*keys.columns, F.col("text").cast("string"))
    return rows.mapInArrow(run, keys.withColumn("fingerprint", F.lit(0).cast("long")).schema)


def reference_fingerprints(n: int = PIVOTS) -> list[int]:
    """Spread-out 64-bit references, the same on every machine."""
    draw = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, n, np.uint64)
    return [int(x) for x in draw.view(np.int64)]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """Distances to the references, eight to a long, one byte each."""
    tables = []
    for group in range(PIVOTS // 8):
        packed = F.lit(0).cast("long")
        for i, pivot in enumerate(reference_fingerprints()[8 * group : 8 * group + 8]):
            distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(pivot))).cast("long")
            packed = packed.bitwiseOR(F.shiftleft(distance, 8 * i))
        tables.append(packed.alias(f"pivots{group}"))
    return nodes.select("fingerprint", *tables)


def band_keys(within: int) -> F.Column:
    """Keys of which two fingerprints at most ``within`` bits apart share at least one.

    ``within`` + 2 blocks of bits leave two blocks equal; a key is a pair of blocks.
    """
    n = within + 2
    cuts = [64 * i // n for i in range(n + 1)]

    def block(i):
        mask = (1 << (cuts[i + 1] - cuts[i])) - 1
        return F.shiftrightunsigned("fingerprint", cuts[i]).bitwiseAND(mask)

    keys = []
    for at, (i, j) in enumerate(combinations(range(n), 2)):
        width = cuts[j + 1] - cuts[j]
        keys.append(F.shiftleft(F.shiftleft(block(i), width).bitwiseOR(block(j)), 6).bitwiseOR(F.lit(at).cast("long")))
    return F.array(*keys)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest connected row for each of ``n`` rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(old, label):
            return label


def _links(group: np.ndarray, side: np.ndarray, prints: np.ndarray, table: np.ndarray, within: int) -> np.ndarray:
    """A spanning forest of the links inside each group of sorted rows: smallest row by row.

    Row i meets row i + s for s = 1, 2, ... while both are in one group. Coordinates drop
    pairs one reference after the other; what is left is compared itself. ``side`` is 0
    for a whole group; rows of a half of a split group meet the other half only.
    """
    n = len(group)
    end = np.searchsorted(group, group, "right")
    label, waiting, held = np.arange(n), [], 0
    live, shift = np.arange(n), 1
    while len(live := live[live + shift < end[live]]):
        i, j = live, live + shift
        keep = (side[i] == 0) | (side[i] != side[j])
        i, j = i[keep], j[keep]
        for p in range(table.shape[1]):
            keep = np.abs(table[i, p] - table[j, p]) <= within
            i, j = i[keep], j[keep]
        keep = np.bitwise_count((prints[i] ^ prints[j]).view(np.uint64)) <= within
        waiting.append((i[keep], j[keep]))
        held += int(keep.sum())
        if held > PENDING:
            a, b = (np.concatenate(x) for x in zip(*waiting, (np.arange(n), label)))
            label, waiting, held = _forest(a, b, n), [], 0
        shift += 1
    if waiting:
        a, b = (np.concatenate(x) for x in zip(*waiting, (np.arange(n), label)))
        label = _forest(a, b, n)
    return label


def near_links(nodes: DataFrame, within: int = 4, hot: int = HOT_BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all at most ``within`` bits apart.

    Each bucket of a key gives a spanning forest of its links, never all pairs. Buckets
    beyond ``hot`` rows are cut into blocks and each pair of blocks is a group of its own.
    """
    tables = [f"pivots{g}" for g in range(PIVOTS // 8)]
    keyed = pivot_table(nodes).select("fingerprint", *tables, F.explode(band_keys(within)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("n") / hot).cast("int")), "buckets")
    rows = keyed.join(sized(sizes), "key")  # the exploded side is never sent, however small it looks
    own = F.pmod(F.xxhash64("fingerprint"), "blocks").cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select(
        "key",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "fingerprint",
        *tables,
    )
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            code = [part.column(c).to_numpy() for c in ("key", "low", "high")]
            change = np.flatnonzero((code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1]) | (code[2][1:] != code[2][:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            rest = part.slice(cut)
            if cut:
                yield pairs(part.slice(0, cut), change)
        if rest is not None and rest.num_rows:
            yield pairs(rest, np.zeros(0, np.int64))

    def pairs(part: pa.Table, change: np.ndarray) -> pa.RecordBatch:
        step = np.zeros(part.num_rows, np.int64)
        step[change[change + 1 < part.num_rows] + 1] = 1
        prints = part.column("fingerprint").to_numpy()  # signed; counting bits needs unsigned
        table = np.stack([part.column(t).to_numpy() for t in tables], 1).copy().view(np.uint8).astype(np.int16)
        label = _links(np.cumsum(step), part.column("side").to_numpy(), prints, table, within)
        linked = label != np.arange(len(label))
        arrays = [pa.array(prints[label[linked]]), pa.array(prints[linked])]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_classes(rows: DataFrame, width: int = 4, within: int = 4) -> DataFrame:
    """The columns of ``rows`` but its text, the fingerprint, and ``label``, the smallest
    fingerprint reachable over links of at most ``within`` differing bits.

    Equal fingerprints are one node, so copies are never paired.
    """
    prints = materialize(fingerprints(rows, width), "fingerprints")
    nodes = materialize(prints.select("fingerprint").distinct(), "nodes")
    labels = components(near_links(nodes, within)).withColumnRenamed("node", "fingerprint")
    joined = prints.join(labels, "fingerprint", "left")
    return joined.withColumn("label", F.coalesce("label", "fingerprint"))


def near_duplicates(docs: DataFrame, width: int = 4, within: int = 4) -> DataFrame:
    """doc_id, fingerprint (signed), component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable; null ids do not count (null if there
    is no other). Null and empty texts have fingerprint zero, which links as any other.
    Repeated rows are returned as often as they occur; an empty table gives an empty one.
    Other columns are not read.
    """
    classes = materialize(near_classes(docs.select(F.col("doc_id").cast("long"), "text"), width, within), "classes")
    firsts = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return classes.join(firsts, "label").select("doc_id", "fingerprint", "component_id")


def fingerprint_hex(column: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
