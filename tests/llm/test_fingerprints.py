"""Document fingerprints against plain Python, and the block tables against all pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from issuelens.llm import fingerprints as fp
from issuelens.llm.common import table
from issuelens.llm.components import components
from tests.llm.test_operators import frame, prose

MASK = 2**64 - 1


def mixed(x, salt):
    x = (x + salt * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_terms(text):
    h = [xxhash.xxh64_intdigest(w, fp.SEED) for w in text.encode().split()]
    return h + [mixed(a, 1) ^ mixed(b, 2) for a, b in zip(h, h[1:])]


def plain_print(text, weights):
    votes = [0] * fp.BITS
    for t in plain_terms(text):
        value = sum(mixed(t, 3 + k) << 64 * k for k in range(fp.BITS // 64))
        for b in range(fp.BITS):
            votes[b] += int(weights[t % len(weights)]) * (1 if value >> b & 1 else -1)
    return sum(1 << b for b in range(fp.BITS) if votes[b] > 0)


def plain_rows(rows):
    """Rows in the order of (id, digest) with what the operator gives for them."""
    counts = Counter(t % fp.COUNTERS for _, x in rows for t in plain_terms(x or ""))
    table_ = np.zeros(fp.COUNTERS, np.int64)
    for k, n in counts.items():
        table_[k] = n
    weights = fp.term_weights(table_)
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = (plain_print(x, weights) for x in (text, after, new))
        hexed = [x.to_bytes(fp.BITS // 8, "little").hex() for x in (a, c)]
        like = [1 - (a ^ x).bit_count() / fp.BITS for x in (c, b)]
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), *hexed, *like))
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 3 + 4 * i)) for i in range(60)]
    out[7], out[8], out[9], out[10] = (7, None), (8, ""), (9, "é"), (10, "日本語 " * 9 + "👍")
    out[20] = (20, out[21][1])
    out[30] = (30, prose(30, 5000))
    return [(None, "no id"), *out]


@pytest.mark.parametrize("size", [fp.RANGE_BYTES, 2000])
def test_against_plain_python(spark, rows, size):
    docs = frame(spark, rows).repartition(5)
    got = sorted((tuple(r) for r in fp.compare_neighbours(docs, most_bytes=size).collect()), key=str)
    assert got == sorted(plain_rows(rows), key=str)


def test_repeated_ids_and_few_rows(spark):
    rows = [(5, f"text {i} of one id") for i in range(200)] + [(i, prose(i, 20)) for i in (1, 2, 9)] + [(5, "text 3 of one id")] * 20
    docs = frame(spark, rows)
    digests = docs.select("doc_id", "text", F.xxhash64("text", F.octet_length("text")).alias("d")).collect()
    rows = [(r["doc_id"], r["text"]) for r in sorted(digests, key=lambda r: (r["doc_id"], r["d"]))]
    for size in (fp.RANGE_BYTES, 300):
        got = sorted((tuple(r) for r in fp.compare_neighbours(docs, most_bytes=size).collect()), key=str)
        assert got == sorted(plain_rows(rows), key=str)
    cuts = fp.id_cuts(docs.select(F.col("doc_id").alias("id"), "text"), 300)
    parts = fp.in_order(docs, 300).where("last = 0 AND id = 5").select("part").distinct().count()
    assert len(cuts) > 5 and parts > 3
    assert [tuple(r) for r in fp.compare_neighbours(frame(spark, [(1, "one")])).collect()] == plain_rows([(1, "one")])
    assert fp.document_fingerprints(frame(spark, rows).limit(0)).count() == 0


def around(seed, n, flips):
    """Fingerprints in families, each some bits off another."""
    draw = random.Random(seed)
    out = [draw.getrandbits(fp.BITS) for _ in range(n // 6)]
    while len(out) < n:
        x = draw.choice(out)
        for _ in range(draw.randrange(1, flips)):
            x ^= 1 << draw.randrange(fp.BITS)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("radius, blocks, hot", [(3, 5, 1024), (3, 4, 3), (6, 8, 5)])
def test_tables_find_all(spark, radius, blocks, hot):
    prints = around(radius + hot, 240, radius + 3)
    names = [x.to_bytes(fp.BITS // 8, "little").hex() for x in prints]
    label = list(range(len(prints)))
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    classes = {}
    for i, own in enumerate(label):
        classes.setdefault(own, set()).add(names[i])
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    links = fp.near_links(nodes, radius, blocks, hot=hot)
    got = {}
    for node, own in components(links).collect():
        got.setdefault(own, set()).add(node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_classes(spark):
    base = prose(1, 2000)
    rows = [(4, base), (2, base), (7, base + " end"), (1, prose(2, 300)), (None, base), (9, None), (8, "")]
    got = {(r["doc_id"], r["class_id"]) for r in fp.document_fingerprints(frame(spark, rows)).collect()}
    assert got == {(4, 2), (2, 2), (7, 2), (1, 1), (None, 2), (9, 8), (8, 8)}


def test_edited_is_nearer_than_next(spark, sf_dir):
    got = fp.compare_neighbours(table(spark, sf_dir, "documents")).where("n_chars > 200").collect()
    better = sum(r["near_edited"] > r["near_next"] for r in got)
    assert better > 0.97 * len(got)
