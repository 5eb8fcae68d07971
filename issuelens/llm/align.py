"""Tokens of two tokenizers linked over the bytes they share, and how common their links are.

Inside a task the tokens are Arrow tables: lists of token ids are flattened with the
number of their text, running sums of token lengths give byte ends, a hash join on
(text, end) finds the ends of both, another one on the group between two such ends
gives the links, and a grouped count the id pairs of each text. Spark merges the counts
of all blocks of texts and returns them to the blocks that hold the pair.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import strings, text_slices
from issuelens.session import materialize

FOLDER = "/opt/tokenizers"
FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20
SPACE = "\u2581"
# A space after another character but white space starts a segment: a byte-level tokenizer starts
# a new word there, and no piece goes on over a space.
SEGMENT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
CUT = re.compile(r"\S ")

# Fixed value: the words that a byte-level tokenizer of this kind cuts a text into.
BYTE_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves, the others for letters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class ByteTokenizer:
    """The byte-level BPE of a JSON file; strings of special tokens are plain text."""

    def __init__(self, data: bytes):
        from tiktoken import Encoding

        rules = json.loads(data)
        vocabulary, letters = rules["model"]["vocab"], byte_letters()
        special = {t["content"] for t in rules["added_tokens"]}
        self.tokens = [b""] * (1 + max(vocabulary.values()))
        for token, at in vocabulary.items():
            self.tokens[at] = token.encode() if token in special else bytes(letters[c] for c in token)
        # Merging by the smallest id is the same as by the list of merges only if that is in the order of ids.
        merges = [m if isinstance(m, str) else " ".join(m) for m in rules["model"]["merges"]]
        made = [vocabulary[m.replace(" ", "")] for m in merges]
        if rules["normalizer"] is not None or rules["pre_tokenizer"]["type"] != "ByteLevel" or made != sorted(made):
            raise ValueError("a byte-level vocabulary without normalizer, with merges in the order of ids, is needed")
        ranks = {self.tokens[at]: at for token, at in vocabulary.items() if token not in special}
        self.model = Encoding("first", pat_str=BYTE_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.length = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in a row, and where those of each start and end.

        They are encoded in one string, as each starts with a space and ends without
        white space; those that do end with it are encoded alone.
        """
        blank = np.array([s[-1].isspace() for s in segments], bool)
        sizes = np.array([len(s.encode()) for s in segments], np.int64)
        ids = np.array(self.model.encode_ordinary("".join(s for s, b in zip(segments, blank) if not b)), np.int32)
        ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(sizes[~blank])) + 1
        counts = np.zeros(len(segments), np.int64)
        counts[~blank] = np.diff(np.r_[0, ends])
        alone = {int(i): self.model.encode_ordinary(segments[i]) for i in np.flatnonzero(blank)}
        for i, own in alone.items():
            counts[i] = len(own)
        at = np.r_[0, np.cumsum(counts)]
        out = np.zeros(int(at[-1]), np.int32)
        out[np.repeat(~blank, counts)] = ids
        for i, own in alone.items():
            out[at[i] : at[i + 1]] = own
        return out, at


class PieceTokenizer:
    """A sentence-piece model, which puts a space before the text itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in zip(ids, pieces)]
        self.space = self.model.piece_to_id(SPACE)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("no piece may have a space after another character")

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in a row, and where those of each start and end.

        The model puts the first space of each back; a text may end with one space alone.
        """
        found = self.model.encode([s[1:] for s in segments], num_threads=1)
        found = [[self.space] if s == " " else ids for s, ids in zip(segments, found)]
        at = np.cumsum([0, *map(len, found)])
        return np.fromiter(chain.from_iterable(found), np.int32, int(at[-1])), at


class Vocabulary:
    """A tokenizer with its tokens as Arrow columns: bytes, lengths, ids as text."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.bytes = pa.array(tokenizer.tokens, pa.large_binary())
        self.length = pa.array([len(t) for t in tokenizer.tokens], pa.int64())
        self.text = pa.array([str(i) for i in range(len(tokenizer.tokens))], pa.string())

    def tokens(self, segments: list[str]) -> pa.Table:
        """segment, id, and the end of each token in the bytes of its segment, in order."""
        flat, at = self.tokenizer.encode(segments)
        lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(flat))
        ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        ends = pc.cumulative_sum(self.length.take(ids)).to_numpy()
        ends = ends - np.repeat(np.r_[0, ends][at[:-1]], np.diff(at))
        return pa.table({"segment": parent, "id": ids, "end": ends})

    def spells(self, tokens: pa.Table, wanted: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of the tokens of each segment are the wanted ones."""
        made = _joined(self.bytes.take(tokens["id"].combine_chunks()))
        n = len(size)
        own = np.bincount(tokens["segment"].to_numpy(), self.length.take(tokens["id"]).to_numpy(), n).astype(np.int64)
        if len(made) == len(wanted) and np.array_equal(own, size) and np.array_equal(made, wanted):
            return np.ones(n, bool)
        a, b = np.r_[0, np.cumsum(own)], np.r_[0, np.cumsum(size)]
        return np.array([own[i] == size[i] and np.array_equal(made[a[i] : a[i + 1]], wanted[b[i] : b[i + 1]]) for i in range(n)], bool)


def _joined(column: pa.Array) -> np.ndarray:
    """The bytes of a large binary column in a row."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


@cache
def _vocabularies(first: bytes, second: bytes) -> tuple[Vocabulary, Vocabulary]:
    return Vocabulary(ByteTokenizer(first)), Vocabulary(PieceTokenizer(second))


def _listed(ids: pa.Array, group: np.ndarray, n: int, mark: str) -> pa.Array:
    """The texts of each of ``n`` ascending groups, joined by ``mark``."""
    at = np.searchsorted(group, np.arange(n + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids), mark)


def _counted(table: pa.Table, keys: list[str]) -> pa.Table:
    return table.group_by(keys, use_threads=False).aggregate([([], "count_all")]).rename_columns([*keys, "many"])


def linked_tokens(both: tuple[Vocabulary, Vocabulary], texts: list[str], owner: np.ndarray, n: int) -> dict:
    """Counts, group strings and id pairs of ``n`` rows, given as spaced pieces of text and the row of each.

    Both tokenizers end where a segment ends, so the groups of a row are those of its
    segments; each distinct segment of the batch is encoded and joined once. ``pairs``
    has row, a * 2**32 + b, and how often the row links the two.
    """
    a, b = both
    lists = [SEGMENT.findall(t) for t in texts]
    row = np.repeat(owner, np.fromiter(map(len, lists), np.int64, len(lists)))
    coded = pa.array(list(chain.from_iterable(lists)), pa.large_string()).dictionary_encode()
    codes, segments = coded.indices.to_numpy(), coded.dictionary
    many, listed = len(segments), segments.to_pylist()
    wanted = _joined(segments.cast(pa.large_binary()))
    size = pc.binary_length(segments).to_numpy()
    one, two = (v.tokens(listed) for v in both)
    whole = a.spells(one, wanted, size) & b.spells(two, wanted, size)
    if not whole.all():
        kept = pa.array(whole)
        one, two = one.filter(kept.take(one["segment"])), two.filter(kept.take(two["segment"]))
    n_a, n_b = (np.bincount(t["segment"].to_numpy(), minlength=many) for t in (one, two))

    # The end of a token in its segment, and the place of the token among all.
    ends = [pa.table({"end": t["segment"].to_numpy().astype(np.int64) << 32 | t["end"].to_numpy(), "at": np.arange(t.num_rows)}) for t in (one, two)]
    shared = ends[0].join(ends[1], "end", join_type="inner", right_suffix="_b", use_threads=False)
    total = shared.num_rows
    groups = []
    for tokens, column in ((one, "at"), (two, "at_b")):
        last = np.zeros(tokens.num_rows, np.int64)
        last[shared[column].to_numpy()] = 1
        groups.append(np.cumsum(last) - last)
    group_segment = np.zeros(total, np.int64)
    group_segment[groups[0]] = one["segment"].to_numpy()
    n_groups = np.bincount(group_segment, minlength=many)

    sides = [pa.table({"group": g, "id": t["id"], "many": np.ones(len(g), np.int64)}) for t, g in ((one, groups[0]), (two, groups[1]))]
    counts = [np.bincount(g, minlength=total) for g in groups]
    if (counts[0] * counts[1]).sum() > 8 * (len(groups[0]) + len(groups[1])):
        # Groups of many tokens on both sides: equal ids of a group are counted before the join.
        sides = [_counted(t.drop(["many"]), ["group", "id"]) for t in sides]
    links = sides[0].join(sides[1], "group", join_type="inner", right_suffix="_b", use_threads=False)
    of = group_segment[links["group"].to_numpy()]
    order = np.argsort(of, kind="stable")
    key = (links["id"].to_numpy().astype(np.int64) << 32 | links["id_b"].to_numpy())[order]
    times = pc.multiply(links["many"], links["many_b"]).to_numpy()[order]
    at = pa.array(np.searchsorted(of[order], np.arange(many + 1)), pa.int64())
    keys, times = (pa.LargeListArray.from_arrays(at, pa.array(v)).take(coded.indices) for v in (key, times))
    linked = pa.table({"row": row[pc.list_parent_indices(keys).to_numpy()], "key": pc.list_flatten(keys), "n": pc.list_flatten(times)})
    pairs = linked.group_by(["row", "key"], use_threads=False).aggregate([("n", "sum")])

    ids = [v.text.take(t["id"].combine_chunks()) for v, t in ((a, one), (b, two))]
    joined = [_listed(i, g, total, ",") for i, g in zip(ids, groups)]
    lines = _listed(pc.binary_join_element_wise(*joined, "|"), group_segment, many, ";")
    lines = _listed(lines.take(coded.indices), row, n, ";")
    bad = np.zeros(n, bool)
    bad[row[~whole[codes]]] = True
    sums = [np.bincount(row, c[codes], n).astype(np.int64) for c in (n_a, n_b, n_groups)]
    return {"whole": ~bad, "counts": np.stack(sums), "lines": lines.to_pylist(), "pairs": pairs}


def pieces_of(text: str, most: int = PIECE) -> list[str]:
    """A spaced text in pieces of about ``most`` characters; both tokenizers end where one ends.

    A piece ends before a space with no white space before it; without one it is longer.
    """
    out, start = [], 0
    while len(text) - start > most:
        cut = CUT.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.end() - 1])
        start = cut.end() - 1
    return [*out, text[start:]]


class Block:
    """Aligned texts of a task, gathered until they make a block with a table of its id pairs."""

    def __init__(self, both: tuple[Vocabulary, Vocabulary], piece: int = PIECE):
        self.both, self.piece = both, piece
        self.clear()

    def clear(self):
        self.keys, self.rows, self.pairs, self.n, self.size = [], [], [], 0, 0

    def add(self, keys: pa.RecordBatch, texts: list[str | None], size: int) -> None:
        n = len(texts)
        whole, counts, lines = np.ones(n, bool), np.zeros((3, n), np.int64), [[] for _ in texts]
        lists = [pieces_of(" " + t, self.piece) if t else [] for t in texts]
        owner = np.repeat(np.arange(n), np.fromiter(map(len, lists), np.int64, n))
        pieces = list(chain.from_iterable(lists))
        ends, parts, start = np.cumsum([0, *map(len, pieces)]), [], 0
        while start < len(pieces):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + 2 * self.piece, "right")) - 1)
            found = linked_tokens(self.both, pieces[start:stop], owner[start:stop], n)
            whole &= found["whole"]
            counts += found["counts"]
            for held, line in zip(lines, found["lines"]):
                if line:
                    held.append(line)
            parts.append(found["pairs"])
            start = stop
        digests = [hashlib.sha256(";".join(held).encode()).hexdigest() if held and ok else "" for held, ok in zip(lines, whole)]
        counts[:, ~whole] = 0
        if parts:
            pairs = pa.concat_tables(parts)
            if len(parts) > 1:
                pairs = pairs.group_by(["row", "key"], use_threads=False).aggregate([("n_sum", "sum")])
            row, key, times = (c.to_numpy() for c in pairs.columns)
            kept = whole[row]
            self.pairs.append((row[kept] + self.n, key[kept], times[kept]))
        self.keys.append(keys)
        self.rows.append((counts, digests))
        self.n += n
        self.size += size

    def batch(self, block: int, names: list[str]) -> pa.RecordBatch:
        """One row a text; the first row of the block also has the block's id pairs and their text counts."""
        nothing = np.zeros(0, np.int64)
        text, key, times = (np.concatenate([nothing, *v]) for v in zip(*self.pairs)) if self.pairs else (nothing,) * 3
        self.pairs = []
        known, code, held = np.unique(key, return_inverse=True, return_counts=True)
        del key
        code = code.astype(np.int32)
        order = np.lexsort((code, text))
        text, code, times = text[order], code[order], times[order]
        del order
        at = pa.array(np.searchsorted(text, np.arange(self.n + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (code, times)]
        once = pa.array([0] + [len(known)] * self.n, pa.int32())
        absent = pa.array(np.arange(self.n) > 0)
        table = [pa.array(v) for v in ((known >> 32).astype(np.int32), (known & 0xFFFFFFFF).astype(np.int32), held)]
        tables = [pa.ListArray.from_arrays(once, v, mask=absent) for v in table]
        counts = np.concatenate([c for c, _ in self.rows], 1)
        n_links = np.bincount(text, times, self.n).astype(np.int64)
        digests = pa.array(list(chain.from_iterable(d for _, d in self.rows)))
        keys = pa.Table.from_batches(self.keys).combine_chunks()
        columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in keys.columns]
        own = [pa.array(np.full(self.n, block)), *map(pa.array, (*counts, n_links)), digests, *lists, *tables]
        self.clear()
        return pa.RecordBatch.from_arrays([*columns, *own], names=names)


BLOCK = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<long>, a array<int>, b array<int>, n array<long>"


def aligned_blocks(docs: DataFrame, first: str, second: str, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """doc_id and the alignment of each whole text, in blocks of texts with a table of id pairs each."""
    files = []
    for path in (first, second):
        with open(path, "rb") as f:
            files.append(f.read())
    sent = docs.sparkSession.sparkContext.broadcast(tuple(files))  # two vocabulary files
    names = ["doc_id", *(c.split()[0] for c in BLOCK.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(_vocabularies(*sent.value), piece), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, 1):
                data, _ = strings(part.column(1))
                block.add(part.select([0]), part.column(1).to_pylist(), len(data))
                if block.size >= block_bytes:
                    yield block.batch(number, names)
                    pa.default_memory_pool().release_unused()
                    number += 1
        if block.n:
            yield block.batch(number, names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, {BLOCK}")


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """block, code, a, b of all blocks, and for every id pair the texts that hold it, and whether no pair of its a has more."""
    tables = blocks.where("a IS NOT NULL").select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("code", "p"))
    tables = tables.select("block", "code", "p.a", "p.b", "p.n")
    counts = materialize(tables.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair_counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    return tables.drop("n"), counts


def align_tokens(
    docs: DataFrame,
    first: str = f"{FOLDER}/{FIRST}",
    second: str = f"{FOLDER}/{SECOND}",
    block_bytes: int = BLOCK_BYTES,
    piece: int = PIECE,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    ``first`` is a byte-level JSON vocabulary and gets a space and the text; ``second`` is
    a sentence-piece model and gets the text. Bytes between two ends that both share make
    a group; every token of one side there is linked with every one of the other. The
    count of an id pair is the number of rows that hold it linked; n_best counts the links
    with the highest count of their first id (ties too), count_sum adds up the counts.

    Null and empty texts, and texts that the tokens of a side do not spell, have zeros and
    an empty digest. Rows are told apart even if ids or texts repeat; null ids are kept,
    other columns not read, an empty table gives an empty one. A long text is cut at
    spaces where both sides end; only its list of id pairs is held as a whole.
    """
    blocks = materialize(aligned_blocks(docs, first, second, block_bytes, piece), "aligned")
    tables, counts = pair_counts(blocks)
    found = tables.join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "code", "count", "best")

    def rated(rows: pa.Table, found: pa.Table) -> pa.Table:
        count, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        code = found["code"].to_numpy()
        count[code], best[code] = found["count"].to_numpy(), found["best"].to_numpy()
        codes, times = (rows[c].combine_chunks() for c in ("codes", "times"))
        text, code, times = pc.list_parent_indices(codes).to_numpy(), pc.list_flatten(codes).to_numpy(), pc.list_flatten(times).to_numpy()
        sums = []
        for value in (best[code] * times, count[code] * times):
            total = np.r_[0, np.cumsum(value)]
            at = np.searchsorted(text, np.arange(rows.num_rows + 1))
            sums.append(pa.array(total[at[1:]] - total[at[:-1]]))
        kept = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", sums[0]).append_column("count_sum", sums[1]).append_column("groups_sha256", rows["groups_sha256"])

    rows = blocks.drop("a", "b", "n")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(rated, schema)
