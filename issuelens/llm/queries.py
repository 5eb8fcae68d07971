"""One query per operator, over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

import corpus_pipeline
from issuelens.llm.align import align_tokens
from issuelens.llm.common import table
from issuelens.llm.decontaminate import contamination
from issuelens.llm.fingerprints import document_fingerprints
from issuelens.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, scan_licenses
from issuelens.llm.mixing import mix_documents
from issuelens.llm.neighbours import nearest_neighbours
from issuelens.llm.quality import score_quality
from issuelens.llm.runs import run_digests
from issuelens.llm.sharding import shard_documents
from issuelens.llm.simhash import fingerprint_hex, near_duplicates
from issuelens.llm.suffixes import remove_repeats
from issuelens.llm.toxicity import score_toxicity
from issuelens.llm.warc import archive_pages

LLM_QUERIES = {}
LLM_ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    def register(function):
        LLM_QUERIES[name] = function
        if sql is not None:
            LLM_ORACLE_SQL[name] = sql
        return function

    return register


# Base32 of a SHA-1: 40 hex digits are 160 bits, five bits a letter.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, url FROM pages),
d AS (SELECT page_id, url, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
w AS (SELECT hex, max(page_id) AS winner FROM d GROUP BY hex),
bits AS (SELECT hex, array_to_string(list_transform(range(0, 40),
    lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
                4 * (instr('0123456789abcdef', substr(hex, i + 1, 1)) - 1) + 1, 4)), '') AS b FROM w),
b32 AS (SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    16 * (substr(b, 5 * i + 1, 1))::INT + 8 * (substr(b, 5 * i + 2, 1))::INT + 4 * (substr(b, 5 * i + 3, 1))::INT
    + 2 * (substr(b, 5 * i + 4, 1))::INT + (substr(b, 5 * i + 5, 1))::INT + 1, 1)), '') AS digest FROM bits)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to, url
FROM d JOIN w USING (hex) JOIN b32 USING (hex)
"""


@query("op1_suffixes")
def op1_suffixes(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_warc", OP3_SQL)
def op3_warc(spark, sf_dir):
    return archive_pages(table(spark, sf_dir, "pages"))


@query("op6_neighbours")
def op6_neighbours(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
wi AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p0, p0 + n - 1), ' ') AS phrase FROM (
    SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p0
    FROM (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
wd AS (SELECT doc_id, n, p0, array_to_string(list_slice(w, p0, p0 + n - 1), ' ') AS phrase FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p0 FROM d, (SELECT DISTINCT n FROM wi) WHERE len(w) >= n)),
m AS (SELECT doc_id, p0, wd.n AS n, item_id FROM wd JOIN wi USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op4_mixing")
def op4_mixing(spark, sf_dir):
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op5_sql() -> str:
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    places = []
    for label, phrase in PHRASES:
        tests = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(phrase.split()))
        places.append(f"SELECT doc_id, '{label}' AS label, i - 1 AS p FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {tests}")
    notices = ", ".join(f"('{label}', list_distinct(string_split('{text_}', ' ')))" for label, text_ in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, {text} AS low, regexp_extract_all({text}, {pattern}) AS w FROM documents),
places AS ({' UNION ALL '.join(places)}),
base AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, regexp_extract_all(line, {pattern}) AS b FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM d)),
notices(label, tokens) AS (VALUES {notices}),
pairs AS (SELECT doc_id, label, len(tokens) AS size, len(list_intersect(tokens, b)) AS shared FROM lines, notices
          WHERE list_has_any(b, tokens)),
found AS (SELECT doc_id, label, shared / size AS best FROM pairs WHERE shared >= ceil({THRESHOLD} * size - 1e-9)),
more AS (SELECT doc_id, max(best) AS best FROM found GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
             FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN labelled USING (doc_id)
"""


@query("op5_licenses", _op5_sql())
def op5_licenses(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op7_decontamination", OP7_SQL)
def op7_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_sharding")
def op8_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


@query("op9_simhash")
def op9_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", fingerprint_hex())


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@query("op10_quality")
def op10_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_runs")
def op11_runs(spark, sf_dir):
    return run_digests(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    return align_tokens(table(spark, sf_dir, "documents"))


@query("op12_fingerprints")
def op12_fingerprints(spark, sf_dir):
    return document_fingerprints(table(spark, sf_dir, "documents"))
