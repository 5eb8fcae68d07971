"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from issuelens.llm import jaccard, simhash
from issuelens.llm.common import Scratch, table
from issuelens.llm.keep import row_keys
from tests.llm import plain


def shingles(text, width=5):
    words = [w for w in plain.lower(text).split() if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def survivors(rows, threshold=(4, 5)):
    """Smallest id of each component of sets at the threshold or above; equal sets are linked."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or threshold[1] * len(a & sets[j]) >= threshold[0] * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if n in (x, y) else n for n in label]
    return [d for n, (d, _) in enumerate(rows) if label[n] == n]


def near_texts(seed, n, copies):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(n)]
    for share in copies:
        words = list(base)
        for at in draw.sample(range(n), round(share * n)):
            words[at] = f"x{draw.randrange(10**6)}"
        yield " ".join(words)


def test_near_copies_that_differ_in_many_bits(spark, monkeypatch):
    texts = [t for seed in range(12) for t in near_texts(seed, 90 + 30 * seed, [0, 0.01, 0.02, 0.02, 0.03, 0.05])]
    texts += ["", None, "one two", "ONE  two", "one three", texts[0].upper()]
    common = " ".join(f"c{i}" for i in range(20))
    texts += [f"{common} {t}" for seed in range(20, 40) for t in near_texts(seed, 30, [0])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = survivors([(i, t or "") for i, t in enumerate(texts)])
    prints = [plain.fingerprint(t) for t in texts]
    few_bits = {min(d for d, own in enumerate(plain.near_components(prints)) if own == x) for x in plain.near_components(prints)}
    assert len(want) < len(few_bits)  # the four-bit rule keeps near copies
    got = corpus_pipeline.drop_near_duplicates(spark, docs, None)
    assert sorted(r["doc_id"] for r in got.collect()) == want
    keyed = docs.select(*row_keys(), "text")
    for hot, counters in ((3, 1 << 18), (1024, 2)):
        classes = jaccard.similar_classes(keyed, hot=hot, counters=counters)
        assert sorted(r[0] for r in classes.groupBy("label").agg(F.min("id_key")).select("min(id_key)").collect()) == want
    monkeypatch.setattr(jaccard, "SMALL_SIDE", 0)
    got = corpus_pipeline.drop_near_duplicates(spark, docs.withColumn("more", F.lit(1)), None)
    assert got.columns == ["doc_id", "text", "more"] and sorted(r["doc_id"] for r in got.collect()) == want


def test_stage_on_the_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = survivors([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == want


def alike(n, share):
    """Texts of 200 words that have a passage in common, so that any two stay below 0.8."""
    draw = random.Random(n)
    common = [f"c{i}" for i in range(200)]
    for _ in range(n):
        words = list(common)
        start = draw.randrange(200 - share)
        words[start : start + share] = [f"x{draw.randrange(10**9)}" for _ in range(share)]
        yield " ".join(words)


def test_pairs_that_leave_a_bucket_grow_no_faster_than_the_group(spark):
    """Groups of texts that are alike but too little: all meet, next to none become rows."""
    found = []
    for n in (100, 200, 400):
        docs = spark.createDataFrame(list(enumerate(alike(n, 40))), "doc_id long, text string").select(*row_keys(), "text")
        scratch = Scratch(spark)
        prints = scratch.write(jaccard.prefixes(docs, 5, 0.8), "prefixes")
        nodes = prints.select("node", "size", "bitmap")
        keyed = prints.select("node", "size", F.posexplode("prefix").alias("place", "key")).withColumn("hub", F.lit(0))
        labels = spark.createDataFrame([], "node long, label long")
        found.append(jaccard._open_pairs(keyed, labels, nodes, 0.8, 1024).count())
        scratch.clear()
    assert all(pairs <= n for pairs, n in zip(found, (100, 200, 400)))


def test_bounds_keep_all_that_reach():
    draw = jaccard.np.random.default_rng(1)
    for _ in range(300):
        size = int(draw.integers(1, 400))
        one = draw.integers(-(2**62), 2**62, size)
        other = jaccard.np.unique(jaccard.np.r_[one[int(draw.integers(0, size // 4 + 1)) :], draw.integers(0, 99, int(draw.integers(0, 30)))])
        one = jaccard.np.unique(one)
        shared = len(jaccard.np.intersect1d(one, other))
        a, b = (jaccard.np.frombuffer(jaccard.parities(x), jaccard.np.uint64) for x in (one, other))
        words = min(len(a), len(b))
        apart = int(jaccard.np.bitwise_count(jaccard.folded(a, words) ^ jaccard.folded(b, words)).sum())
        assert apart <= len(one) + len(other) - 2 * shared
        if 5 * shared >= 4 * (len(one) + len(other) - shared):
            assert jaccard.may_reach(len(one), len(other), apart, 0.8)


def test_fingerprints_find_near_copies_before_the_join(spark, monkeypatch):
    texts = [t for seed in range(8) for t in near_texts(seed, 300, [0, 0.004, 0.004])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(*row_keys(), "text")
    scratch = Scratch(spark)
    nodes = scratch.write(jaccard.prefixes(docs, 5, 0.8), "prefixes")
    rows = {r["id_key"]: r for r in nodes.collect()}
    for i, text in enumerate(texts):
        hashes = [int(x) for x in jaccard.shingles_of(text.encode()).view("uint64")]
        assert rows[i]["fingerprint"] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    none = spark.createDataFrame([], "key long, node long, size int, place int, hub struct<node:long,size:int>")
    found = jaccard._first_pairs(jaccard._print_pairs(nodes, jaccard.PRINT_BITS, scratch), none, nodes, 0.8, scratch)
    of = {r["node"]: i // 3 for i, r in rows.items()}
    pairs = [(of[r["a"]], of[r["b"]]) for r in found.collect()]
    assert all(a == b for a, b in pairs) and len({a for a, _ in pairs}) == 8
    scratch.clear()

    called = []
    links = jaccard.near_links
    monkeypatch.setattr(jaccard, "near_links", lambda *a: called.append(a[1]) or links(*a))
    jaccard.similar_classes(docs)
    assert called == [jaccard.PRINT_BITS]  # by distances to the references, as in op9


def builds(frame):
    """The sides that the joins of a frame's plan send to every task."""
    tree = [frame._jdf.queryExecution().sparkPlan()]
    while tree:
        node = tree.pop()
        tree += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "BroadcastHashJoin":
            yield (node.left() if node.buildSide().toString() == "BuildLeft" else node.right()).toString()


def test_no_exploded_table_is_sent_to_every_task(spark, tmp_path, monkeypatch):
    """A row a key of each fingerprint: by Spark's estimate less than the buckets' file, in truth many times as much."""
    draw = random.Random(5)
    base = [draw.getrandbits(64) - 2**63 for _ in range(30000)]
    prints = base + [p ^ 1 << draw.randrange(62) for p in base[:50]]
    spark.createDataFrame([(p,) for p in prints], "fingerprint long").coalesce(1).write.parquet(str(tmp_path / "prints"))
    nodes = spark.read.parquet(str(tmp_path / "prints"))
    found = []
    for most in (1, 0):  # the buckets are sent, or nothing
        links = simhash.near_links(nodes, jaccard.PRINT_BITS)
        sent = list(builds(links))
        assert len(sent) == most and not any("Generate" in side for side in sent)
        monkeypatch.setattr("issuelens.operators.small.SIDE_ROWS", 1000)
        found.append({frozenset((r["a"], r["b"])) for r in links.collect()})
    assert found[0] == found[1] >= {frozenset(p) for p in zip(base, prints[30000:])}


def test_sides_are_sent_by_their_rows_and_not_by_their_files(spark, monkeypatch):
    texts = [t for seed in range(6) for t in near_texts(seed, 60, [0, 0.01, 0.02, 0.05])] + ["one two", "ONE two", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = survivors([(i, t or "") for i, t in enumerate(texts)])
    for rows in (0, 1 << 18):
        monkeypatch.setattr("issuelens.operators.small.SIDE_ROWS", rows)
        monkeypatch.setattr(jaccard, "SMALL_SIDE", rows)
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, None)
        sent = [side for side in builds(kept) if "__word" not in side]  # bitmaps of keys are bounded
        assert bool(sent) == bool(rows)
        assert sorted(r["doc_id"] for r in kept.collect()) == want
