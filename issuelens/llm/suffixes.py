"""Repeated substrings of a corpus, found on Burrows-Wheeler transforms of blocks.

A window of ``LENGTH`` bytes belongs to the gram of ``GRAM`` bytes in it with the smallest
hash, so equal windows belong to the same gram wherever they stand. Neighbouring windows
that belong to one place of a gram make a stretch. Stretches are dealt by gram. Equal
stretches are collapsed to the earliest (in the tasks that read the texts already), and a
gram with one stretch left holds no two equal windows. What remains is dealt by gram into
blocks; each block becomes one text, and the interval expansion of :mod:`bwt` finds the
windows that are equal. A gram with very many different stretches is not kept together:
its windows are dealt one by one, by two hashes of the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.bwt import equal_prefixes
from issuelens.llm.common import null_safe, small_batches, strings
from issuelens.session import materialize

LENGTH = 100
GRAM = 32
CHUNK = 1 << 20
BLOCK = 1 << 20
HOT = 32
OPEN, GONE, SPLIT = 0, 1, 2
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
# A place: 24 bits of tie, 31 of start, 8 of the number of windows.
TIE, START = 1 << 39, 1 << 8

STRETCH = "gram long, content long, doc long, place long, done boolean"
DECISION = "gram long, doc long, place long, state int"
PIECE = "gram long, doc long, place long, bytes binary"
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
    ]
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


UP = _powers(BASE, CHUNK + 2 * LENGTH)
DOWN = _powers(pow(BASE, -1, 1 << 64), CHUNK + 2 * LENGTH)
BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _over(x: np.ndarray, n: int, join) -> np.ndarray:
    """Of every ``n`` neighbours what ``join`` makes of them, by doubling."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = join(out[:-step], out[step:])
        have += step
    return out


def stretches(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document, start, windows, gram, content) of all stretches of neighbouring texts.

    ``starts`` are the offsets of the texts in ``data``. Work goes in chunks of about a
    megabyte; where a chunk ends a stretch ends too, which changes no window's gram.
    """
    found = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        n = len(part) - length + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[part] * UP[: len(part)])])
        grams = _mix((sums[gram:] - sums[:-gram]) * DOWN[: len(part) - gram + 1])
        # The place fills the low bits: equal hashes count from the left.
        key = (grams & np.uint64(MASK - 0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        place = (_over(key, length - gram + 1, np.minimum)[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        where = np.arange(at, at + n)
        doc = np.searchsorted(starts, where, "right") - 1
        fits = where + length <= starts[doc + 1]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [n]]))
        keep = fits[first]
        first, count = first[keep], count[keep]
        content = _mix((sums[first + count + length - 1] - sums[first]) * DOWN[first] + count.astype(np.uint64))
        found.append((doc[first], at + first - starts[doc[first]], count, grams[place[first]], content))
    if not found:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(c) for c in zip(*found)]


def with_places(docs: DataFrame) -> DataFrame:
    """doc (the id, nulls first), tie, text. Ids are checked on their own column.

    Rows with one id are different documents, in the order of a hash of their texts, and
    get a tie number; rows equal in id and text are one document.
    """
    rows = docs.select(null_safe("doc_id").alias("doc"), F.col("text").cast("string").alias("text"))
    repeated = rows.groupBy("doc").count().where("count > 1").select("doc")
    if repeated.isEmpty():
        return rows.withColumn("tie", F.lit(0).cast("long"))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    pairs = hashed.join(repeated, "doc", "left_semi").select("doc", "hash").distinct()
    ranked = pairs.selectExpr("doc", "hash", "cast(row_number() OVER (PARTITION BY doc ORDER BY hash) - 1 AS long) AS tie")
    return hashed.join(materialize(ranked, "ties"), ["doc", "hash"], "left").select("doc", "text", F.coalesce("tie", F.lit(0)).alias("tie"))


def find_stretches(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Stretches of all texts. Of equal ones in a batch only the earliest has to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = strings(batch.column(1))
            row, start, count, gram, content = stretches(data, at, length)
            doc, tie = batch.column(0).to_numpy()[row], batch.column(2).to_numpy()[row]
            place = tie * TIE + start * START + count
            order = np.lexsort((place, doc, content, gram))
            g, c, d, p = gram[order], content[order], doc[order], place[order]
            same = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
            # Equal to an earlier one of this batch: gone, unless it is the same document row twice.
            first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0)) if len(order) else order
            done = (d != d[first]) | (p != p[first])
            g = np.where(done, _mix(d.view(np.uint64) ^ p.view(np.uint64)), g)
            arrays = [pa.array(g.view(np.int64)), pa.array(np.where(done, np.uint64(0), c).view(np.int64)), pa.array(d), pa.array(p), pa.array(done)]
            yield pa.RecordBatch.from_arrays(arrays, names=["gram", "content", "doc", "place", "done"])

    return rows.select("doc", "text", "tie").mapInArrow(run, STRETCH)


def resolve(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """What becomes of each stretch: gone (an equal one stands earlier), open or split
    (first of its kind, but its gram has other kinds), or nothing to do (not returned).

    Rows are sorted by gram and content in the shuffle's own sort, which spills, and pass
    through the task in batches; what waits is the last, unfinished gram.
    """

    def judge(part: pa.Table) -> pa.RecordBatch:
        gram, content, doc, place = (part.column(i).to_numpy() for i in range(4))
        done = part.column(4).to_numpy(zero_copy_only=False)
        n = len(gram)
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_kind = new_gram | np.concatenate([[True], content[1:] != content[:-1]])
        first = np.maximum.accumulate(np.where(new_kind, np.arange(n), 0))
        leader = (doc == doc[first]) & (place == place[first])
        kinds = np.add.reduceat(new_kind.astype(np.int64), np.flatnonzero(new_gram))[np.cumsum(new_gram) - 1]
        state = np.where(done | ~leader, GONE, np.where(kinds > hot, SPLIT, OPEN))
        keep = done | ~leader | ((kinds > 1) & new_kind)
        arrays = [pa.array(x[keep]) for x in (np.where(state == GONE, 0, gram), doc, place, state.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=["gram", "doc", "place", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            gram = batch.column(0).to_numpy()
            if not len(gram):
                continue
            change = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            if waiting and waiting[-1].column(0)[-1].as_py() != gram[0]:
                cut = int(change[-1]) if len(change) else 0
                yield judge(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = [batch.slice(cut)]
            elif len(change):
                cut = int(change[-1])
                yield judge(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = [batch.slice(cut)]
            else:
                waiting.append(batch)
        if waiting:
            yield judge(pa.Table.from_batches(waiting))

    dealt = rows.repartition("gram").sortWithinPartitions("gram", "content", "doc", "place")
    return dealt.mapInArrow(run, DECISION)


def packed(rows: DataFrame) -> DataFrame:
    """doc, tie and the compressed text, which halves what the joins move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, at = strings(batch.column(2))
            data = data.tobytes()
            texts = [squeeze.compress(data[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc", "tie", "packed"])

    return rows.select("doc", "tie", "text").mapInArrow(run, "doc long, tie long, packed binary")


def _by_document(decisions: DataFrame) -> DataFrame:
    """Decisions of a document in one row; their number is bounded by the text's length."""
    tie = F.expr(f"place div {TIE}")
    return decisions.groupBy("doc", tie.alias("tie")).agg(F.collect_list(F.struct("place", "state", "gram")).alias("held"))


def _unpack(column: pa.Array) -> Iterator[bytes]:
    loose = zstandard.ZstdDecompressor()
    for value in column:
        yield loose.decompress(value.as_py())


def open_pieces(texts: DataFrame, decisions: DataFrame, state: int, length: int = LENGTH) -> DataFrame:
    """The bytes of the stretches that are still open or split, with their gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, held in zip(batch.column(0).to_pylist(), _unpack(batch.column(1)), batch.column(2).to_pylist()):
                for x in held:
                    start, count = x["place"] % TIE // START, x["place"] % START
                    out.append((x["gram"], doc, x["place"], text[start : start + count + length - 1]))
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["gram", "doc", "place", "bytes"])

    wanted = _by_document(decisions.where(F.col("state") == state))
    return texts.join(wanted, ["doc", "tie"]).select("doc", "packed", "held").mapInArrow(run, PIECE)


def single_windows(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every window of a piece as a stretch of its own, dealt by two hashes of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows: list[tuple] = []
            for d, p, text in zip(doc.tolist(), place.tolist(), batch.column(3).to_pylist()):
                data = np.frombuffer(text, np.uint8)
                n = len(data) - length + 1
                values = BYTE[data]
                one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * UP[: len(data)])])
                two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(values) * UP[: len(data)])])
                gram = _mix((one[length:] - one[:n]) * DOWN[:n])
                content = _mix((two[length:] - two[:n]) * DOWN[:n])
                rows.append((gram, content, np.full(n, d), p - p % START + np.arange(n) * START + 1))
            if rows:
                gram, content, doc, place = (np.concatenate(c) for c in zip(*rows))
                arrays = [pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(place), pa.array(np.zeros(len(doc), bool))]
                yield pa.RecordBatch.from_arrays(arrays, names=["gram", "content", "doc", "place", "done"])

    return pieces.mapInArrow(run, STRETCH)


def compare_block(doc: np.ndarray, place: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of runs of windows that also start earlier, among the texts of a block."""
    sizes = np.array([len(t) for t in texts])
    text = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    whole = np.frombuffer(b"\0".join(texts), np.uint8)
    text[: len(whole)] = whole
    text[: len(whole)] += 1
    text[at[1:] - 1] = 0
    text[-1] = 0
    order, group = equal_prefixes(text, length)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(text)) - at[owner]
    valid = (offset + length <= sizes[owner])[order]
    order, group = order[valid], group[valid]
    many = np.bincount(group)[group] > 1
    order, group = order[many], group[many]
    who = owner[order]
    start = place[who] - place[who] % START + offset[order] * START
    rank = np.lexsort((start, doc[who], group))
    d, s, g = doc[who][rank], start[rank], group[rank]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0)) if len(g) else g
    later = (d != d[first]) | (s != s[first])
    d, s = d[later], s[later]
    line = np.lexsort((s, d))
    d, s = d[line], s[line]
    # Runs of neighbouring windows, at most 255 long.
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + START)]) if len(d) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0)) if len(d) else np.zeros(0, np.int64)
    new |= (np.arange(len(d)) - lead) % (START - 1) == 0
    begin = np.flatnonzero(new)
    return d[begin], s[begin] + np.diff(np.concatenate([begin, [len(d)]]))


def compare(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Decisions on open pieces: blocks of whole grams, about a megabyte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows):
            doc, place = compare_block(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows], length)
            zero = np.zeros(len(doc), np.int64)
            arrays = [pa.array(zero), pa.array(doc), pa.array(place), pa.array(zero.astype(np.int32) + GONE)]
            return pa.RecordBatch.from_arrays(arrays, names=["gram", "doc", "place", "state"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield flush(held)

    return pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, DECISION)


def remove_spans(text: bytes, runs: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, list[int]]:
    """What is left without the bytes of the windows of each (start, windows), and the spans."""
    if not runs:
        return text, []
    starts = np.array([r[0] for r in runs])
    stops = starts + np.array([r[1] for r in runs]) + length - 1
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > stops[:-1]])
    begin, end = starts[new], stops[np.concatenate([new[1:], [True]])]
    kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
    return kept, [x for pair in zip(begin.tolist(), end.tolist()) for x in pair]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for every row of ``docs``.

    A byte goes if a string of ``length`` bytes around it also starts earlier: in a
    smaller doc_id or before in the same text. Null ids come first; rows that share an id
    are ordered by a hash of their texts; rows equal in id and text are one document and
    are all returned. Null texts are empty. ``spans`` holds start and end of each removed
    run, in bytes. Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=10_000, megabytes=4)
    rows = with_places(docs)
    decisions = materialize(resolve(find_stretches(rows, length)), "decisions")
    texts = packed(rows)
    pieces = open_pieces(texts, decisions, OPEN, length)
    gone = materialize(compare(pieces, length), "compared")
    single = single_windows(open_pieces(texts, decisions, SPLIT, length), length)
    apart = materialize(resolve(single).where(F.col("state") == GONE), "apart")
    every = decisions.where(F.col("state") == GONE).unionByName(gone).unionByName(apart)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = []
            for doc, text, held in zip(batch.column(0).to_pylist(), _unpack(batch.column(1)), batch.column(2).to_pylist()):
                kept, spans = remove_spans(text, [(x["place"] % TIE // START, x["place"] % START) for x in held or ()], length)
                digest = hashlib.sha256(kept).hexdigest()
                out.append((doc if doc != -(2**63) else None, len(text), len(text) - len(kept), len(spans) // 2, digest, spans))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=RESULT.names)

    joined = texts.join(_by_document(every), ["doc", "tie"], "left").select("doc", "packed", "held")
    return joined.mapInArrow(run, RESULT)
