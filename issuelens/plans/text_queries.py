"""Cleaning, extraction and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.functions import text as T
from issuelens.operators import relational as R
from issuelens.plans.extract import extract_texts
from issuelens.plans.registry import query, r6, table
from issuelens.sources.tables import spread

# White space and decimal digits spelled out for an engine whose classes are ASCII.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S, NOT_S = f"[{SPACE}]", f"[^{SPACE}]"

# The cleaning rules for an engine without back-references; the emphasis
# rule is written out per marker.
SQL_RULES = {
    "fenced_backtick": (r"(?s)```.*?```", " "),
    "fenced_tilde": (r"(?s)~~~.*?~~~", " "),
    "inline_code": (r"`[^`\n]+`", " "),
    "html_comment": (r"(?s)<!--.*?-->", " "),
    "html_tag": (r"<[^>]+>", " "),
    "html_entity": (r"&[a-zA-Z]+;|&#\p{Nd}+;", " "),
    "block_quote": (rf"(?m)^{S}*>+.*$", ""),
    "image": (r"!\[.*?\]\(.*?\)", " "),
    "inline_link": (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
    "reference_link": (r"\[([^\]]*)\]\[[^\]]*\]", r"\1"),
    "raw_url": (rf"https?://{NOT_S}+", " "),
    "www_url": (rf"www\.{NOT_S}+", " "),
    "heading": (rf"(?m)^#{{1,6}}{S}+", ""),
    "emphasis": (
        r"\*\*\*(.*?)\*\*\*|\*\*(.*?)\*\*|\*(.*?)\*|___(.*?)___|__(.*?)__|_(.*?)_|~~(.*?)~~",
        r"\1\2\3\4\5\6\7",
    ),
    "rule_line": (rf"(?m)^{S}*[-*_]{{3,}}{S}*$", ""),
    "checkbox": (rf"(?m)^{S}*-{S}*\[[ xX]\]{S}*", ""),
    "bullet": (rf"(?m)^{S}*[-*+]{S}+", ""),
    "numbered": (rf"(?m)^{S}*\p{{Nd}}+\.{S}+", ""),
    "emoji": (
        r"[\x{1f600}-\x{1f64f}\x{1f300}-\x{1f5ff}\x{1f680}-\x{1f6ff}\x{1f1e0}-\x{1f1ff}\x{2700}-\x{27bf}"
        r"\x{1f900}-\x{1f9ff}\x{2600}-\x{26ff}\x{1fa00}-\x{1fa6f}\x{1fa70}-\x{1faff}\x{2300}-\x{23ff}"
        r"\x{1f700}-\x{1f77f}]+",
        " ",
    ),
    "invisible": (r"[\x{fe00}-\x{fe0f}\x{200b}-\x{200f}\x{ad}\x{feff}]", ""),
    "unprintable": (r"[^\x09\x0a\x0d\x20-\x7e\x{a0}-\x{d7ff}\x{e000}-\x{fffd}]", " "),
    "blank_lines": (r"\n{3,}", "\n\n"),
    "space_runs": (r"[ \t]{2,}", " "),
}


def sql_rule(expression: str, name: str) -> str:
    pattern, replacement = SQL_RULES[name]
    return f"regexp_replace({expression}, '{pattern}', '{replacement}', 'g')"


def sql_strip(expression: str) -> str:
    return rf"regexp_replace({expression}, '^{S}+|{S}+\z', '', 'g')"


def sql_join_lines(lines: str) -> str:
    """Strip each line, drop empty ones, join."""
    return f"array_to_string([s for s in [{sql_strip('l')} for l in {lines}] if s <> ''], chr(10))"


def sql_clean(expression: str) -> str:
    """The whole chain; composition stands in for compatibility folding, which SQL lacks
    and which changes no text of the given tables otherwise."""
    for name in SQL_RULES:
        if name == "unprintable":
            expression = f"nfc_normalize({expression})"
        expression = sql_rule(expression, name)
    lines = rf"string_split_regex({expression}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return sql_join_lines(lines)


def sql_words(expression: str) -> str:
    return f"[w for w in string_split_regex({expression}, '{S}+') if w <> '']"


# An issue body that uses every markup rule, built from a document; the same expression
# in both dialects.
BODY = (
    "'## ' || source || chr(10) || '<!-- ' || lang || ' -->' || text || chr(10)"
    " || '```python' || chr(10) || 'x = ' || cast(n_chars AS string) || chr(10) || '```' || chr(10)"
    " || '~~~' || chr(10) || source || chr(10) || '~~~' || chr(10)"
    " || '- [x] **' || source || '** and `' || lang || '` or ~~' || lang || '~~ ___' || source || '___ *y* a_b_c' || chr(10)"
    " || '- [ ] todo' || chr(10) || '+ plus' || chr(10) || '  > quoted ' || lang || chr(10)"
    " || '![img](http://e.x/' || cast(doc_id AS string) || ') [link ' || lang || '](https://e.x/a) [ref]['"
    " || cast(doc_id AS string) || ']' || chr(10) || '12. see www.e.x/' || lang || ' or https://e.x/?q=' || source || chr(10)"
    " || '---' || chr(10) || chr(10) || chr(10) || chr(10) || '<b>bold</b> &amp; &#39; end   of' || chr(9) || chr(9) || 'row "
    "\U0001f600\U0001f680 ☃ zero​width éß' || chr(13) || chr(10) || text"
)
BODIES = f"bodies AS (SELECT doc_id, {BODY} AS body FROM documents)"


def issue_bodies(spark, folder):
    documents = spread(table(spark, folder, "documents"))
    return documents.select("doc_id", F.expr(BODY).alias("body"))


@query(f"SELECT doc_id, {sql_clean('text')} AS clean FROM documents")
def clean_documents(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    rows = T.with_clean_text(documents, "text", "clean")
    return rows.select("doc_id", "clean")


@query(f"SELECT page_id, {sql_clean('html')} AS clean FROM pages")
def clean_pages(spark, folder):
    rows = T.with_clean_text(spread(table(spark, folder, "pages").select("page_id", "html")), "html", "clean")
    return rows.select("page_id", "clean")


@query(f"WITH {BODIES} SELECT doc_id, {sql_clean('body')} AS clean FROM bodies")
def clean_issue_bodies(spark, folder):
    return T.with_clean_text(issue_bodies(spark, folder), "body", "clean").select("doc_id", "clean")


@query(
    f"WITH {BODIES} SELECT doc_id, "
    + ", ".join(f"md5({sql_rule('body', name)}) AS {name}" for name in SQL_RULES)
    + " FROM bodies"
)
def clean_rules_one_by_one(spark, folder):
    rows = issue_bodies(spark, folder)
    return rows.select("doc_id", T.markup_digests(F.col("body"), list(SQL_RULES)).alias("digests")).select("doc_id", "digests.*")


@query(
    f"""WITH {BODIES}, lines AS (
      SELECT doc_id, string_split_regex(body, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS split FROM bodies)
    SELECT doc_id, md5({sql_join_lines('lines.split')}) AS compacted
    FROM lines"""
)
def compact_lines(spark, folder):
    rows = issue_bodies(spark, folder)
    return rows.select("doc_id", F.md5(T.compact_lines(F.col("body"))).alias("compacted"))


@query(f"SELECT doc_id, len({sql_words('text')}) AS n_words FROM documents WHERE len({sql_words('text')}) >= 45")
def word_count_filter(spark, folder):
    rows = R.keep_min_words(table(spark, folder, "documents"), "text", 45)
    return rows.select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query(
    f"SELECT doc_id, {sql_strip(f'''regexp_replace(substr(text, 1, 512), '{S}+', ' ', 'g')''')} AS prepared FROM documents"
)
def preprocess_text(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", T.preprocess_text(F.col("text"), 512).alias("prepared"))


@query(
    f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w[1:512], ' ')) AS model_window
    FROM (SELECT doc_id, {sql_words('lower(text)')} AS w FROM documents)"""
)
def token_window(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_tokens"),
        F.md5(F.array_join(F.slice("w", 1, 512), " ")).alias("model_window"),
    )


@query(
    """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN d.text END, '') AS text
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def null_text_to_empty(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    rows = table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    return rows.select("doc_id", T.null_to_empty(F.when(F.col("quality") == 1, F.col("text"))).alias("text"))


@query("SELECT doc_id, text FROM documents WHERE length(text) >= 2000")
def min_length_filter(spark, folder):
    return R.keep_min_length(table(spark, folder, "documents").select("doc_id", "text"), "text", 2000)


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def dedup_keep_first(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return R.keep_first_by_text(rows, "text", ["doc_id"])


@query(
    f"""WITH cleaned AS (SELECT doc_id AS number, source AS title, {sql_clean('text')} AS text
      FROM documents WHERE text IS NOT NULL),
    long_enough AS (SELECT * FROM cleaned WHERE length(text) >= 20)
    SELECT text, number, title FROM long_enough
    WHERE number IN (SELECT min(number) FROM long_enough GROUP BY text)"""
)
def extract_document_texts(spark, folder):
    issues = table(spark, folder, "documents").select(
        F.col("doc_id").alias("number"), F.col("source").alias("title"), F.col("text").alias("body")
    )
    return extract_texts(spread(issues), "body", ["number"])


@query(
    """SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    WHERE d.lang IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL"""
)
def drop_null_rows(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    return R.drop_null_rows(rows.join(table(spark, folder, "labels"), "doc_id", "left"))


@query("SELECT text, doc_id AS number FROM documents WHERE text IS NOT NULL")
def project_text(spark, folder):
    rows = table(spark, folder, "documents").select(
        "text", F.col("doc_id").alias("number"), "lang", F.col("source").alias("Unnamed: 0")
    )
    return R.project_text(R.drop_stray_index(R.drop_null_rows(rows, "text")))


EVENTS_AS_DEBT = """debt AS (SELECT user_id, ts, value, event_type,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS predicted_class FROM events)"""


def events_as_debt(spark, folder):
    is_debt = (F.col("event_type") == "error").cast("int")
    return table(spark, folder, "events").select("user_id", "ts", "value", "event_type", is_debt.alias("predicted_class"))


@query(
    f"""WITH {EVENTS_AS_DEBT} SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
      count(*) AS n_rows, CAST(sum(predicted_class) AS BIGINT) AS n_debt, round(avg(predicted_class), 6) AS density
    FROM debt GROUP BY ALL"""
)
def debt_density(spark, folder):
    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")
    return R.debt_density(events_as_debt(spark, folder), ["user_id", day]).withColumn("density", r6("density"))


LABEL_MEASURES = (
    "count(*) AS n_rows, CAST(sum(toxic) AS BIGINT) AS n_debt, round(avg(toxic), 6) AS density "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
)


@query(
    f"SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, {LABEL_MEASURES} GROUP BY ROLLUP (lang, source)"
)
def debt_rollup(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source").join(table(spark, folder, "labels"), "doc_id")
    return R.debt_rollup(rows, ["lang", "source"], "toxic").withColumn("density", r6("density"))


@query(f"SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, {LABEL_MEASURES} GROUP BY CUBE (lang, source)")
def debt_cube(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source").join(table(spark, folder, "labels"), "doc_id")
    return R.debt_cube(rows, ["lang", "source"], "toxic").withColumn("density", r6("density"))


@query(
    """SELECT toxic AS label, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM labels), 6) AS share
    FROM labels GROUP BY toxic"""
)
def class_distribution(spark, folder):
    rows = table(spark, folder, "labels").select(F.col("toxic").alias("label"))
    return R.class_distribution(rows).withColumn("share", r6("share"))
