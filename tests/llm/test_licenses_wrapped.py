"""License notices that are wrapped over lines."""

import re

from pyspark.sql import functions as F

from issuelens.llm.licenses import line_words, scan_licenses, spaced

BSD = """Copyright (c) 2009, The Owners.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
ISC = """/*
 * Permission to use, copy, modify, and/or distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above
 * copyright notice and this permission notice appear in all copies.
 */"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_wrapped_notices(spark):
    filler = "\n".join(f"plain words number {i} here" for i in range(30))
    apart = "redistribution and use in source and binary forms with or without\n" + filler + "\nmodification are permitted"
    rows = [(1, BSD), (2, ISC), (3, MPL), (4, f"{filler}\n{BSD}\n{filler}\n{ISC}\r\n{filler}"), (5, apart), (6, filler), (7, None)]
    rows += [(8, BSD.replace("\n", " ")), (9, "Redistribution\nand\nuse in\n\nsource and binary forms,\nwith or without modification,\nare allowed")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(docs).collect()}
    none = ("", 0.0)
    assert got == {1: ("bsd", 1.0), 2: ("isc", 1.0), 3: ("mpl", 1.0), 4: ("bsd,isc", 1.0), 5: none, 6: none, 7: none, 8: ("bsd", 1.0), 9: ("bsd", 12 / 13)}


def test_words_are_cut_without_a_regular_expression(spark):
    """Every sign below 128 that is no letter or digit parts words; all others, and none besides, belong to them."""
    texts = ["".join(f"mit{chr(c)}License" for c in range(128)), "été MIT  license\r\n\x00MIT\nlicense", "", None, " \n ", "x\U0001f600y GENERAL\tPublic_license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = scan_licenses(docs)
    whole = docs.select(F.flatten(line_words(spaced(F.col("text")))))
    assert "regexp" not in whole._jdf.queryExecution().toString()
    cut = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    for row in found.collect():
        words = cut.findall("".join(c.lower() if c.isascii() else c for c in texts[row["doc_id"]] or ""))
        starts = [i for p in ("mit license", "general public license") for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (row["n_words"], row["n_base"]) == (len(words), len(starts))
        assert (row["first_word"], row["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
