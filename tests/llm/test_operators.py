"""Operators against plain Python on small tables with the awkward rows in them."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import neighbours, sharding, simhash, suffixes, warc
from issuelens.llm.bwt import equal_prefixes
from issuelens.llm.common import table
from issuelens.llm.components import components
from issuelens.llm.decontaminate import build_index, contamination, find_near
from issuelens.llm.licenses import scan_licenses
from issuelens.llm.mixing import fit_domains, memberships, mix_documents, repeat_documents, solve
from issuelens.llm.quality import score_quality, site_of, site_rates
from issuelens.llm.toxicity import CharacterModel, Restorer, character_counts, score_toxicity, skeleton
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, _part int, label int"
VOCABULARY = "the of and thin ration mont hedge ouvert sein alpha beta gamma delta é ß zeta".split()


def frame(spark, rows):
    """A document table with columns whose names the operators use themselves."""
    full = [(i, t, "en", "src1", len(t or ""), "x", 1, 7) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) + str(draw.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 300)
    passage = prose(2, 60)
    near = base.split()
    near[150] = "changed"
    return [
        (0, base),
        (1, base),
        (2, " ".join(near)),
        (3, prose(3, 20) + " " + passage + " " + prose(4, 20)),
        (4, passage + "\n" + passage),
        (5, None),
        (6, ""),
        (7, "a" * 450),
        (8, "word"),
        (9, prose(5, 4000) + passage),
        (10, "é" * 120 + base[:130]),
        (None, base[100:400]),
    ]


def test_equal_prefixes_against_strings():
    draw = np.random.default_rng(3)
    for _ in range(120):
        length = int(draw.integers(1, 8))
        texts = [draw.integers(1, 1 + draw.integers(1, 4), draw.integers(0, 40)) for _ in range(draw.integers(1, 5))]
        whole = np.concatenate([np.append(t, 0) for t in texts]).astype(np.int64)
        order, group = equal_prefixes(whole, length)
        classes = {}
        for place, g in zip(order, group):
            part = whole[place : place + length]
            if len(part) == length and part.all():
                classes.setdefault(g, set()).add(tuple(part))
        assert all(len(v) == 1 for v in classes.values())
        assert len({s for v in classes.values() for s in v}) == len(classes)


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeats(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(suffixes.resolve, "__defaults__", (hot,))
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got == plain.repeats(rows)


def test_repeats_in_small_chunks_and_rows_with_one_id(spark, rows, monkeypatch):
    text = prose(9, 400)
    same = [(1, text), (1, text), (1, prose(10, 50) + text[:300]), (2, text[50:900])]
    out = suffixes.remove_repeats(frame(spark, same)).collect()
    assert len(out) == 4
    removed = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in out)
    both = [r for r in removed if r[1] == len(text.encode())]
    assert len(both) == 2 and both[0] == both[1]  # equal rows are one document
    monkeypatch.setattr(suffixes, "CHUNK", 256)
    data = np.frombuffer(text.encode(), np.uint8)
    small = suffixes.stretches(data, np.array([0, len(data)]))
    assert small[2].sum() == len(data) - 99
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


def test_spans_cover_the_removed_bytes(spark, rows):
    for r in suffixes.remove_repeats(frame(spark, rows)).collect():
        ends = r["spans"]
        assert sum(ends[1::2]) - sum(ends[::2]) == r["n_removed"] and len(ends) == 2 * r["n_spans"]


def test_simhash(spark, rows):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows)).withColumn("fingerprint", simhash.fingerprint_hex()).collect()}
    prints = [plain.fingerprint(t) for _, t in rows]
    label = plain.near_components(prints)
    for (doc, _), p, own in zip(rows, prints, label):
        ids = [d for (d, _), other in zip(rows, label) if other == own and d is not None]
        assert (got[doc]["fingerprint"], got[doc]["component_id"]) == (f"{p:016x}", min(ids, default=None))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_links_in_a_split_bucket(spark):
    draw = random.Random(5)
    center = draw.getrandbits(64)
    values = {center}
    while len(values) < 300:
        x = draw.choice(list(values))
        for _ in range(draw.randrange(1, 6)):
            x ^= 1 << draw.randrange(64)
        values.add(x)
    values |= {draw.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {r["node"]: r["label"] for r in components(simhash.near_links(nodes, hot=16)).collect()}
    label = plain.near_components([v % (1 << 64) for v in signed])
    want = {}
    for v, own in zip(signed, label):
        want.setdefault(own, []).append(v)
    for members in want.values():
        assert {got.get(v, v) for v in members} == {min(members)}


def test_decontamination(spark, rows):
    items = [(1, rows[3][1][150:500]), (2, "word"), (3, None), (None, "hedge1 alpha2"), (1, rows[3][1][150:500]), (40, prose(2, 12)), (5, " .")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *plain.contamination(t, items)) for i, t in rows)
    for limit in (1 << 24, 100):  # one block, many blocks
        got = contamination(frame(spark, rows), bench, limit=limit).collect()
        assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == want
    none = contamination(frame(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)
    assert contamination(frame(spark, []), bench).count() == 0


def test_proximity(spark):
    docs = frame(spark, [(1, "x alpha one two beta y"), (2, "beta alpha"), (3, "alpha z z z z z beta"), (4, "alpha"), (5, "beta")])
    index = build_index(docs, [b"alpha", b"beta"])
    found = {(r["doc_id"], r["start"]) for r in find_near(index, [0, 1], 4).collect()}
    assert {d for d, _ in found} == {1, 2} and (1, 1) in found and (2, 0) in found


def test_shard_rows_keeps_columns_of_any_name(spark):
    rows = [(i, 77, 5, 6, 7) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, _part int, _place int, _at int, _first int")
    got = sharding.shard_rows(df, ["id"], 2).collect()
    assert sorted(tuple(r)[:5] for r in got) == rows
    assert all((r["shard"], r["slot"]) == sharding.locate(r["row_no"], 9, 2) for r in got)
    with pytest.raises(ValueError, match="already there"):
        sharding.shard_rows(df.withColumn("slot", F.lit(1)), ["id"], 2)


def test_sharding(spark, rows):
    docs = frame(spark, [*rows, *rows[:4]])
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == len(rows) + 4
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    sizes = [len(places.get(s, [])) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    texts = {}
    for i, t in rows:
        texts[i] = ((len((t or "").encode()) + 8), zlib.crc32((t or "").encode()))
    assert all((r["size"], r["text_crc32"]) == texts[r["doc_id"]] for r in got)
    again = sharding.shard_documents(docs.repartition(7), 5).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.shard_documents(frame(spark, []), 5).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 10, 100, 1000, 4097])
def test_permutation(total):
    at = sharding.permute(np.arange(total), total, seed=3)
    assert sorted(at) == list(range(total))
    assert (sharding.permute(at, total, seed=3, back=True) == np.arange(total)).all()
    shard, slot = sharding.locate(total - 1, total, 7)
    assert sharding.row_at(shard, slot, total, 7) == total - 1


def test_warc(spark):
    pages = [(1, "http://a/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nv", None), (4, "u", ""), (None, "n", "<p>é</p>"), (5, "z", "y" * 300_000), (6, "q", "a\r\n\r\nb"), (None, "m", "alone")]
    frame_ = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, url string, html string, digest int, winner int")
    got = {(r["page_id"], r["url"]): r for r in warc.archive_pages(frame_).collect()}
    assert len(got) == len(pages)
    for page, url, html in pages:
        body = (html or "").encode()
        r = got[(page, url)]
        winner = max((p for p, _, h in pages if (h or "").encode() == body), key=lambda p: -1 if p is None else p)
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == winner else ("revisit", winner))
    assert warc.archive_pages(frame_.limit(0)).count() == 0


def test_warc_reads_a_selection(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"body {i}" * 50) for i in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archive"
    index = warc.write_archive(warc.choose_responses(pages), folder)
    picked = index.where(F.col("url").isin("http://h/3", "http://h/4", "http://h/31"))
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(picked, folder).collect()}
    assert got == {i: f"body {i}" * 50 for i in (3, 4, 31)}


def test_licenses(spark):
    rows = [
        (1, "Intro.\nReleased under the MIT License.\nmit-LICENSE again"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "apache\n license; General  Public License"),
        (4, None),
        (5, "licensed under 4 0"),
        (5, "summit license"),
        (None, "GNU mit Élicense"),
        (6, "this program is free software you can redistribute it and modify it under the terms of the general public license as is"),
    ]
    got = {(r["doc_id"], r["n_words"]): r for r in scan_licenses(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    one = got[(1, 9)]
    assert (one["n_base"], one["first_word"], one["last_word"], one["base_labels"], one["labels"], one["score"]) == (2, 4, 6, "mit", "mit", 1.0)
    assert (got[(2, 7)]["base_labels"], got[(2, 7)]["labels"], got[(2, 7)]["score"]) == ("", "cc-by-nc", 1.0)
    assert (got[(3, 5)]["n_base"], got[(3, 5)]["base_labels"], got[(3, 5)]["first_word"], got[(3, 5)]["last_word"]) == (2, "apache,gpl", 0, 2)
    assert [tuple(got[k])[1:] for k in ((4, 0), (5, 2))] == [(0, 0, None, None, "", "", 0.0), (2, 0, None, None, "", "", 0.0)]
    assert got[(None, 3)]["n_base"] == 0 and got[(6, 22)]["labels"] == "gpl"
    assert scan_licenses(frame(spark, [])).count() == 0


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((700, 16)).astype(np.float32)
    x[300:420] = x[0]  # a large group of copies
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1020, [float("nan")] * 16), (1021, [1.0, None] * 8), (1022, [1.0]), (None, [1.0] * 16), (1023, [float("inf")] * 16)]
    vectors = spark.createDataFrame([(i, v, 3, 4) for i, v in rows + odd], "vec_id long, embedding array<float>, key int, list int")
    got = {}
    for r in neighbours.nearest_neighbours(vectors).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    full = x.astype(float)
    hits = 0
    for q in range(0, 700, 20):
        score = full @ full[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(700), -score))[:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(f[2] - score[f[1]]) < 1e-9 for f in found)
        hits += len({f[1] for f in found} & set(want.tolist()))
    assert set(got) == set(range(0, 700, 20)) and hits / (35 * 20) >= 0.9
    assert [f[1] for f in sorted(got[0])] == list(range(300, 320))  # ties go to smaller ids
    few = neighbours.nearest_neighbours(vectors.where("vec_id < 3")).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few)] == [(0, 1), (0, 2)]
    assert neighbours.nearest_neighbours(vectors.where("vec_id = 1001")).count() == 0
    assert neighbours.nearest_neighbours(vectors.limit(0)).count() == 0


def test_restoration(spark):
    counts = character_counts(frame(spark, [(1, "the idea of a stupid clown is the loser"), (2, None), (3, "")]))
    assert counts.sum() > 0
    restorer = Restorer({"idiot": 5.0, "stupid": 4.0, "clown": 3.0, "réeux*": 2.0}, counts)
    for text, want in [
        ("1d10t", 5), ("i d i o t", 5), ("i.d.i.o.t", 5), ("IDIOOOT!!!", 5), ("$tup1d", 4), ("cl0wn,", 3), ("réeuxment", 2),
        ("the idea of", 0), ("", 0), ("clown clown", 6), ("you are an i d i o t", 5), ("clowning", 0),
        ("ïdîot", 5), ("ｃｌｏｗｎ", 3), ("réuxment", 0), ("id!ot", 5), ("i_d_i_o_t", 5), ("cl\u200bown", 3),
    ]:
        assert restorer.text(text)[0] == want, text
    assert skeleton("1d10t") == skeleton("idiot") == skeleton("i-d_iiot")
    assert CharacterModel(counts).decode("th3") == "the"


def test_toxicity_held_out(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = score_toxicity(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert scored.count() == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.9
    # Labels of the held-out fifth, and other columns, change nothing.
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = score_toxicity(docs.withColumn("lang", F.lit(None)).withColumn("evidence", F.lit(1)), flipped)
    assert {tuple(r) for r in other.collect()} == {tuple(r) for r in scored.collect()}


def test_toxicity_without_labels(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_toxicity(frame(spark, [*rows, rows[0]]), labels).collect()
    assert len(got) == len(rows) + 1 and {r["predicted"] for r in got} == {0}
    assert score_toxicity(frame(spark, []), labels).count() == 0


def test_mixing(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit_domains(docs, labels)
    members = memberships(docs, model)
    for low in (0.0, 1.0):
        rates, targets, reached = solve(members, low=low)
        assert np.max(np.abs(reached - targets) / targets) < 0.02
    p = np.array([r["posterior"] for r in members.collect()])
    t = np.array([r["n_tokens"] for r in members.collect()])
    rate = rates.of(p)
    assert rate.min() >= 1 and np.allclose((rate * t) @ p / t.sum(), reached)
    mixed = mix_documents(docs, labels).collect()
    assert len(mixed) == docs.count() and all(abs(r["copies"] - r["rate"]) < 1 for r in mixed)
    repeated = repeat_documents(docs, labels)
    assert repeated.columns == docs.columns and {r[0] for r in repeated.select("doc_id").collect()} == set(range(docs.count()))


def test_mixing_without_labels(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mix_documents(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and {(r["domain"], r["copies"]) for r in got} == {("all", 1)}
    assert mix_documents(frame(spark, []), labels).count() == 0


def test_quality(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = score_quality(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert scored.count() == docs.count()
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.95


def test_quality_shrinks_sparse_sites(spark):
    draw = random.Random(1)
    rows = [("good", "a", 0.9 + draw.random() / 20) for _ in range(200)] + [("bad", "a", 0.1 + draw.random() / 20) for _ in range(200)]
    rows += [("good", "b", 0.1), ("new", "c", 0.1)]
    frame_ = spark.createDataFrame([(h, q, p, p) for h, q, p in rows], "host string, path string, p double, seen double")
    rates, total = site_rates(frame_)
    got = {(r["host"], r["path"]): r["rate"] for r in rates.collect()}
    assert 0.4 < total < 0.6
    assert got[("good", "a")] > 0.85 and got[("bad", "a")] < 0.2
    assert got[("good", "b")] > got[("new", "c")] > 0.1  # the sparse path leans on its host, the new host on all


def test_quality_of_awkward_rows(spark, rows):
    labels = spark.createDataFrame([(0, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") > 3, F.col("source")))
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 < r["score"] < 1 for r in got)
    assert score_quality(frame(spark, []), labels).count() == 0
    url = spark.createDataFrame([("https://m.A.example/en/25#top",), (None,), ("x",)], "u string")
    assert [tuple(r) for r in url.select(*site_of(F.col("u"))).collect()] == [("m.a.example", "en"), (None, None), ("", "")]
