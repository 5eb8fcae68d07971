"""Readers, writers and streams."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from issuelens.plans.extract import extract_texts
from issuelens.session import scratch_path
from issuelens.sources import issues as G
from issuelens.sources import sinks, tables
from issuelens.streaming import jobs as J

FORTY = [(f"This is text number {i}", int(i < 20)) for i in range(40)]


def test_formats_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\n" + "".join(f"{t},{y}\n" for t, y in FORTY))
    columns = {"text": {str(i): t for i, (t, _) in enumerate(FORTY)}, "label": {str(i): y for i, (_, y) in enumerate(FORTY)}}
    (tmp_path / "b.json").write_text(json.dumps(columns))
    (tmp_path / "c.json").write_text(json.dumps([{"text": t, "label": y} for t, y in FORTY]))
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"text": t, "label": y}) + "\n" for t, y in FORTY))
    want = sorted(FORTY)
    for name in ("a.csv", "b.json", "c.json", "d.jsonl"):
        df = tables.load_table(spark, str(tmp_path / name))
        assert sorted((r["text"], int(r["label"])) for r in df.collect()) == want, name
        typed = tables.load_table(spark, str(tmp_path / name), "text string, label int")
        assert sorted(tuple(r) for r in typed.select("text", "label").collect()) == want, name


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="Unsupported file format"):
        tables.load_table(spark, str(tmp_path / "data.txt"))


def test_csv_quoting(spark, tmp_path):
    rows = [(1, 'say "hi",\nthen leave '), (2, "  padded"), (3, None), (4, "back\\slash"), (5, "crlf\r\nline"), (6, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    path = str(tmp_path / "quoted.csv")
    sinks.write_csv(df, path)
    back = {r["id"]: r["text"] for r in tables.read_csv(spark, path, "id int, text string").collect()}
    assert [back[i] for i in (1, 2, 4, 5)] == [rows[0][1], rows[1][1], rows[3][1], rows[4][1]]
    assert not back[3] and not back[6]


def test_missing_markers(spark, tmp_path):
    (tmp_path / "na.csv").write_text("id,x\n1,NA\n2,null\n3,7\n4,\n")
    df = tables.read_csv(spark, str(tmp_path / "na.csv"), "id int, x int")
    assert {r["id"]: r["x"] for r in df.collect()} == {1: None, 2: None, 3: 7, 4: None}


def test_named_table_and_splits(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    df.createOrReplaceTempView("split_table")
    assert [r["id"] for r in tables.load_dataset(spark, "split_table", "test").collect()] == [2]
    path = str(tmp_path / "splits")
    sinks.write_splits(df, path)
    part = tables.load_dataset(spark, path, "train")
    assert [r["id"] for r in part.collect()] == [1]
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()


RAW = [
    {"id": 1, "number": 11, "title": "t1", "body": None, "state": "open", "created_at": "2024-01-02T00:00:00Z", "user": None, "labels": [], "comments": 2, "html_url": "u1"},
    {"id": 2, "number": 12, "title": "t2", "body": "b2", "state": "closed", "created_at": "2024-01-03T00:00:00Z", "user": {"login": "ann"}, "labels": [{"name": "bug"}, {"name": "debt"}], "html_url": "u2"},
    {"id": 3, "number": 13, "title": "pr", "body": "b3", "state": "open", "created_at": "2024-01-04T00:00:00Z", "user": {"login": "bob"}, "labels": [], "pull_request": {"url": "p"}},
    {"id": 4, "number": 14, "title": "t4", "body": "b4", "state": "open", "created_at": "2024-01-03T00:00:00Z", "user": {"login": "cy"}, "labels": []},
]


def test_issues(spark, tmp_path):
    (tmp_path / "issues.jsonl").write_text("".join(json.dumps(r) + "\n" for r in RAW + RAW[1:2]))
    raw = G.read_issues(spark, str(tmp_path / "issues.jsonl"))
    flat = G.newest_issues(G.flatten_issues(G.drop_pull_requests(raw)), None)
    rows = flat.collect()
    assert [r["id"] for r in rows] == [4, 2, 1]
    assert rows[1]["labels"] == ["bug", "debt"] and rows[2]["body"] == "" and rows[2]["user_login"] == ""
    assert rows[0]["comments"] == 0 and rows[1]["comments"] == 0
    assert [r["id"] for r in G.newest_issues(flat, 2).collect()] == [4, 2]
    assert {r["id"] for r in G.filter_state(flat, "open").collect()} == {1, 4}
    assert G.filter_state(flat, "all").count() == 3
    path = str(tmp_path / "out.csv")
    sinks.write_csv(flat, path)
    assert {r["labels"] for r in tables.read_csv(spark, path, ", ".join(f"{c} string" for c in flat.columns)).collect()} == {"bug,debt", None}


BODIES = ["This is a **real** issue with `code` in it, long enough", "## Heading\nA sentence that is long enough too", None, "short"]


def test_extract(spark):
    # Observations leave a manager in their session that ML closures cannot ship.
    df = spark.newSession().createDataFrame([(i, f"title {i}", b) for i, b in enumerate(BODIES)], "number long, title string, body string")
    counters = {name: Observation() for name in ("read", "cleaned", "kept")}
    out = extract_texts(df, counters=counters)
    assert out.columns == ["text", "number", "title"] and len(out.collect()) == 2
    assert [counters[n].get["rows"] for n in ("read", "cleaned", "kept")] == [4, 2, 2]
    same = spark.createDataFrame([(i, "the same long body text here") for i in range(3)] + [(9, "another long body text there")], "number long, body string")
    assert sorted(r["number"] for r in extract_texts(same).collect()) == [0, 9]
    assert extract_texts(same, drop_duplicates=False).count() == 4
    with pytest.raises(ValueError, match="no column"):
        extract_texts(same, body="missing")


def feed(spark, tmp_path, name, batches, schema):
    """One file per batch, read one file at a time."""
    folder = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def at(minute):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


SCHEMA = "id long, at string, repo string, text string"


def events(spark, tmp_path, name, batches):
    stream = feed(spark, tmp_path, name, batches, SCHEMA)
    return stream.select("id", F.to_timestamp("at").alias("ts"), "repo", "text", (F.col("id") % 2).cast("int").alias("predicted_class"))


def test_stream_dedup_across_batches(spark, tmp_path):
    batches = [[(i, at(i), "r", "same" if i % 3 else f"t{i}") for i in range(k * 10, k * 10 + 10)] for k in range(3)]
    out = J.run_to_table(J.dedup_stream(events(spark, tmp_path, "dups", batches), "ts", "1 day"), scratch_path(spark, "t"))
    texts = [r["text"] for r in out.collect()]
    assert len(texts) == len(set(texts)) == 11


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    batches = [[(1, at(10), "r", "a")], [(2, at(500), "r", "b")], [(4, at(510), "r", "c")], [(3, at(5), "r", "late")]]
    batches.append([(5, at(900), "r", "d")])
    density = J.density_tumbling(events(spark, tmp_path, "late", batches), "ts", ["repo"], "1 hour", "10 minutes")
    path = scratch_path(spark, "late")
    query = J.start_table_sink(density, path, f"{path}_checkpoint", available_now=True)
    query.awaitTermination()
    rows = spark.read.parquet(path).orderBy("window_start").collect()
    assert [r["n_rows"] for r in rows] == [1, 2]
    assert J.late_rows_dropped(query) == 1


def test_late_rows_are_logged_by_batch(spark, tmp_path):
    batches = [[(1, at(10), "r", "a")], [(2, at(500), "r", "b")], [(4, at(510), "r", "c")]]
    batches.append([(3, at(5), "r", "late"), (6, at(6), "r", "late"), (7, at(520), "r", "d")])  # a batch is measured by the watermark before the last
    stream = events(spark, tmp_path, "logged", batches).withWatermark("ts", "10 minutes").dropDuplicates(["id", "ts"])
    path, log = scratch_path(spark, "logged"), scratch_path(spark, "log")
    with J.logged_late_rows(spark, log) as listener:
        query = J.start_table_sink(stream, path, f"{path}_checkpoint", available_now=True)
        query.awaitTermination()
    rows = spark.read.parquet(log).orderBy("batch_id").collect()
    assert [(r["n_input"], r["n_dropped"]) for r in rows] == [(1, 0), (1, 0), (1, 0), (3, 2)]
    assert {r["query_id"] for r in rows} == {str(query.id)}
    last = [p for p in query.recentProgress if p.numInputRows][-1]
    listener.onQueryProgress(SimpleNamespace(progress=last))  # a batch that runs again
    assert sorted(spark.read.parquet(log).collect()) == sorted(rows)


def test_stream_clean_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    got = J.run_to_table(J.clean_stream(stream).select("doc_id", "text"), scratch_path(spark, "clean"))
    want = J.clean_stream(docs).select("doc_id", "text")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_dedup_state_stays_flat(spark, tmp_path):
    """A digest leaves the state when the watermark is past it, however long the stream."""
    days = [[(100 * day + i, f"2024-01-{day:02d}T0{i}:00:00Z", "r", f"text {i % 4} of day {day // 2}") for i in range(8)] for day in range(1, 25)]
    path = scratch_path(spark, "flat")
    with J.durable_state(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
        stream = J.dedup_stream(events(spark, tmp_path, "flat", days), "ts", "2 days")
        query = J.start_table_sink(stream, path, f"{path}_checkpoint", available_now=True)
        query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(query.recentProgress[0].stateOperators) == 1
    assert max(held) <= 12 and max(held[-5:]) <= max(held[:10])
    texts = [r["text"] for r in spark.read.parquet(path).collect()]
    assert len(texts) == len(set(texts)) == 4 * 13
    changes = [f for _, _, files in os.walk(f"{path}_checkpoint/state") for f in files]
    assert any(f.endswith(".changelog") for f in changes)


LABELS = "id long, at string, label int"


def test_quality_of_late_labels_window_by_window(spark, tmp_path):
    """Windows come from the running query, once neither stream can bring rows of them."""
    guesses = [[(h, at(60 * h), "r", "t") for h in range(d * 24, d * 24 + 24)] for d in range(2)]
    guesses = [[(i, f"2024-01-{1 + i // 24:02d}T{i % 24:02d}:00:00Z", r, t) for i, _, r, t in day] for day in [*guesses, [(h, 0, "r", "t") for h in range(240, 264)]]]
    labels = [[(i, f"2024-01-{2 + i // 24:02d}T{i % 24:02d}:30:00Z", i % 3 % 2) for i, *_ in day] for day in guesses]
    stream = events(spark, tmp_path, "guesses", guesses).select("id", "ts", "predicted_class")
    truth = feed(spark, tmp_path, "labels", labels, LABELS).select("id", F.to_timestamp("at").alias("labelled_at"), "label")
    joined = J.join_late_labels(stream, truth, "id", "ts", "labelled_at", "3 days", "1 hour", "2 hours")
    path = scratch_path(spark, "quality")
    query = J.start_quality_sink(joined, "ts", path, f"{path}_checkpoint", available_now=True)
    query.awaitTermination()
    assert [o.operatorName for o in query.recentProgress[0].stateOperators] == ["stateStoreSave", "symmetricHashJoin"]
    got = {r["window_start"].day: r for r in spark.read.parquet(path).collect()}
    assert sorted(got) == [1, 2]  # the last day may still get labels
    for day in (1, 2):
        ids = range(24 * (day - 1), 24 * day)
        hits = sum(i % 2 == i % 3 % 2 for i in ids)
        assert got[day]["accuracy"] == pytest.approx(hits / 24)
    before = spark.read.parquet(path).count()
    again = spark.read.parquet(path).filter(F.col("batch_id") == spark.read.parquet(path).agg(F.max("batch_id")).first()[0])
    from issuelens.sources.sinks import write_batch

    rows = spark.createDataFrame(again.drop("batch_id").collect(), again.drop("batch_id").schema)
    write_batch(rows, path, again.first()["batch_id"])
    assert spark.read.parquet(path).count() == before
