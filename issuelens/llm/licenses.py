"""License scan: exact set-similarity join of text blocks with license templates.

Built-in functions only. A block is a line, or a run of words over line breaks that is no
longer than a template's words over the threshold. Tokens that occur in any template are
kept in the global order of frequency, rarest first. A block and a template that share the
required number of tokens share one among the first few of the template, so only those
are joined; length and position then bound the overlap that is still possible.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.session import materialize

THRESHOLD = 0.85
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What stands between words, once A-Z is lower-cased; line breaks are kept apart.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) != "\n")

# The phrases of the base labels, and notices of well-known licenses.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited"),
]


def spaced(text: Column) -> Column:
    """The text with A-Z only lower-cased and blanks for all that is between words but line breaks; null is empty."""
    blanks = " " * len(BETWEEN)
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + BETWEEN, UPPER.lower() + blanks)


def line_words(low: Column) -> Column:
    """The words of each line, with empty strings between them."""
    return F.transform(F.split(low, "\n"), lambda line: F.split(line, " "))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def token_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """Template tokens by the number of documents that hold them, rarest first.

    Counts come from all documents and are summed before the shuffle; a row per template
    token, a number that does not grow with the documents, reaches the driver.
    """
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    every = F.split(F.translate(spaced(F.col("text")), "\n", " "), " ")
    held = docs.select(F.explode(F.array_intersect(_strings(vocabulary), every)).alias("token"))
    counts = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_rows(order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """(template, label, tokens in global order, size, required overlap) for each template."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        rows.append((number, label, tokens, len(tokens), math.ceil(threshold * len(tokens) - 1e-9)))
    return rows


def phrase_places(tokens: Column, phrase: str) -> Column:
    """Places, from 0, where the words of a phrase stand one after the other."""
    parts = phrase.split()

    def starts(i):
        here = F.get(tokens, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            here = here & (F.get(tokens, i + k) == part)
        return here

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), starts)


def template_tokens(tokens: Column, order: list[str]) -> Column:
    """Places, from 0, and tokens of the words of a text that occur in any template."""
    placed = F.transform(tokens, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    return F.filter(placed, lambda x: F.array_contains(_strings(order), x["word"]))


def holds_all(tokens: list[str]):
    return lambda line: F.size(F.array_intersect(line, _strings(tokens))) == len(tokens)


def best_run(near: Column, tokens: Column, place: Column, reach: Column) -> Column:
    """The most tokens of a template in a run of ``reach`` words that holds the word at ``place``."""
    own = F.filter(near, lambda x: F.array_contains(tokens, x["word"]) & (F.abs(x["at"] - place) < reach))

    def held(first):
        run = F.filter(own, lambda x: (x["at"] >= first["at"]) & (x["at"] < first["at"] + reach))
        return F.size(F.array_distinct(F.transform(run, lambda x: x["word"])))

    return F.array_max(F.transform(F.filter(own, lambda x: x["at"] <= place), held))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 with a base phrase, else the largest containment of a template in a
    line, or in a run of words over lines, that reaches the threshold, else 0. Null and empty texts have no words, labels
    '' and score 0. Rows with the same id are judged each on its own; an empty table
    gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    order = token_order(docs, templates)
    rows = template_rows(order, templates, threshold)
    least = min((r[4] for r in rows), default=1)

    text = docs.select(F.col("doc_id"), spaced(F.col("text")).alias("low"))
    text = text.withColumn("words", line_words(F.col("low")))
    text = text.withColumn("tokens", F.array_remove(F.flatten("words"), ""))
    places = [F.transform(phrase_places(F.col("tokens"), p), lambda i: i.cast("long")) for _, p in phrases]
    none = F.array(*[F.array().cast("array<bigint>") for _ in phrases])
    last_words = [p.split()[-1] for _, p in phrases]
    hopeful = F.lit(False)
    for word in sorted(set(last_words)):
        hopeful = hopeful | F.contains(F.col("low"), F.lit(word))
    # One row per document from here on: counts, places and the few tokens of each line.
    # A text without any token of a template's prefix holds none of them, line by line or over lines.
    rarest = sorted({token for _, _, tokens, size, required in rows for token in tokens[: size - required + 1]})
    lines = F.transform("words", lambda line: F.array_intersect(_strings(order), line))
    lines = F.when(F.arrays_overlap("tokens", _strings(rarest)), lines).otherwise(F.array().cast("array<array<string>>"))
    # Runs are looked at in texts that hold enough tokens of a template, yet in no single line all of them.
    text = text.withColumn("lines", lines).withColumn("every", F.array_distinct(F.flatten("lines")))
    split = F.lit(False)
    for _, _, tokens, _, required in rows:
        whole = F.size(F.array_intersect(F.col("every"), _strings(tokens)))
        split = split | ((whole >= required) & ~F.exists("lines", holds_all(tokens)))
    split = (F.size("every") >= least) & split
    lines = F.col("lines")
    narrow = text.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("tokens").cast("long").alias("n_words"),
        F.when(hopeful, F.array(*places)).otherwise(none).alias("places"),
        F.filter(lines, lambda b: F.size(b) >= least).alias("blocks"),
        F.when(split, template_tokens(F.col("tokens"), order)).alias("placed"),
    )
    narrow = materialize(narrow, "blocks")

    prefixes = [
        (token, at, number, label, tokens, size, required, math.floor(len(templates[number][1].split()) / threshold + 1e-9))
        for number, label, tokens, size, required in rows
        for at, token in enumerate(tokens[: size - required + 1])
    ]
    schema = "token string, at int, template int, label string, tokens array<string>, size int, required int, reach int"
    prefix = F.broadcast(spark.createDataFrame(prefixes, schema))  # a fixed list, some rows a template
    blocks = narrow.select("row", F.posexplode("blocks").alias("line", "block"))
    pairs = blocks.select("row", "line", "block", F.posexplode("block").alias("place", "token")).join(prefix, "token")
    shared = F.size(F.array_intersect("tokens", "block"))
    found = (
        pairs.where(F.size("block") >= F.col("required"))
        .where(F.least(F.col("size") - F.col("at"), F.size("block") - F.col("place")) >= F.col("required"))
        .withColumn("shared", shared)
        .where("shared >= required")
        .select("row", "label", "size", "shared")
    )
    runs = narrow.where(F.size("placed") >= least).select("row", "placed", F.posexplode("placed").alias("index", "x"))
    runs = runs.join(prefix, F.col("x.word") == F.col("token"))
    near = F.slice("placed", F.greatest(F.col("index") - F.col("reach") + 2, F.lit(1)), 2 * F.col("reach") - 1)
    runs = runs.select("row", "label", "size", "required", "tokens", "reach", F.col("x.at").alias("place"), near.alias("near"))
    runs = runs.withColumn("shared", best_run(F.col("near"), F.col("tokens"), F.col("place"), F.col("reach")))
    found = (
        found.unionByName(runs.where("shared >= required").select("row", "label", "size", "shared"))
        .groupBy("row")
        .agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("best"))
    )
    joined = narrow.drop("blocks", "placed").join(found, "row", "left")
    every = F.flatten("places")
    base = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, label) for i, (label, _) in enumerate(phrases)]))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )

