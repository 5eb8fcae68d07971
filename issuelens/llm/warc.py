"""WARC archives with an index: written record by record, read back by byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import small_batches
from issuelens.session import materialize, scratch_path

GAP = 64 << 10
READ = 8 << 20
TASK = 32 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
NONE = -(2**63)

INDEX = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def choose_responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest and ``winner``, the page that holds the payload.

    Of rows with equal payloads of at least ``min_bytes`` the largest page_id wins; rows
    that share it are all responses. Nulls count as the smallest page_id, null html as an
    empty payload. The winners come from narrow rows, combined before their shuffle.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("payload"),
        F.unhex(F.sha1(html)).alias("digest"),
    )
    own = F.coalesce(F.col("page_id"), F.lit(NONE))
    winners = rows.groupBy("digest").agg(F.max(own).alias("winner"))
    small = F.octet_length("payload") < min_bytes
    return rows.join(winners, "digest").withColumn("winner", F.when(small, own).otherwise(F.col("winner")))


def _header(text: str | None) -> str:
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(text: str) -> str:
    return text.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def _record(page, url, payload: bytes, digest: bytes, winner: int) -> tuple[str, bytes]:
    kind = "response" if winner == (NONE if pd.isna(page) else int(page)) else "revisit"
    http = HTTP.format(len(payload)).encode()
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if pd.isna(page) else int(page)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_header(url)}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{'' if winner == NONE else winner}>")
    return kind, ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_archive(chosen: DataFrame, folder: str) -> DataFrame:
    """Writes one gzip member per record and returns the stored index.

    Each task attempt writes a file of its own and its index rows count only when the
    task ends well, so a lost executor leaves an unused file and no wrong row.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for part in parts:
            rows = []
            for page, url, payload, digest, winner in zip(
                part["page_id"], part["url"], part["payload"], part["digest"], part["winner"]
            ):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                kind, record = _record(page, url, payload, digest, winner)
                member = gzip.compress(record, 6, mtime=0)
                out.write(member)
                rows.append((name, at, len(member), url, base64.b32encode(digest).decode(), kind))
                at += len(member)
            if rows:
                yield pd.DataFrame(rows, columns=INDEX.names)
        if out is not None:
            out.close()

    columns = chosen.select("page_id", "url", "payload", "digest", "winner")
    columns = columns.withColumn("page_id", F.col("page_id").cast("decimal(20,0)"))
    return materialize(columns.mapInPandas(write, INDEX), "warc-index")


def _parse(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
    kind = fields["WARC-Type"]

    def number(name):
        return fields[name][len("<urn:page:") : -1] or None if name in fields else None

    url = fields.get("WARC-Target-URI")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return (
        number("WARC-Record-ID"),
        None if url is None else _plain(url),
        size,
        digest,
        kind,
        number("WARC-Refers-To"),
        payload if kind == "response" else None,
    )


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that index rows point to.

    Rows are dealt by file and stretch of 8 MB and sorted by offset; ranges closer than
    64 KB become one read of up to 8 MB. Any selection of index rows is allowed.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for part in parts:
            rows, group = [], []
            for row in [*part[["file", "offset", "length"]].itertuples(index=False), None]:
                if group and (
                    row is None
                    or row.file != group[0].file
                    or row.offset > group[-1].offset + group[-1].length + GAP
                    or row.offset + row.length > group[0].offset + READ
                ):
                    first = group[0].offset
                    with store.open_input_file(f"{root}/{group[0].file}") as source:
                        data = source.read_at(group[-1].offset + group[-1].length - first, first)
                    for x in group:
                        record = _parse(gzip.decompress(data[x.offset - first : x.offset - first + x.length]))
                        rows.append(record if payloads else (*record[:-1], None))
                    group = []
                if row is not None:
                    group.append(row)
            for at in range(0, len(rows), 64):
                yield pd.DataFrame(rows[at : at + 64], columns=RECORD.names)

    stretch = F.expr(f"offset div {READ}")
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK))  # by the bytes to read, not by the narrow index rows
    narrow = selected.select("file", "offset", "length").repartition(tasks, "file", stretch)
    out = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("page_id", "refers_to") else f for f in RECORD])
    records = narrow.sortWithinPartitions("file", "offset").mapInPandas(read, out)
    records = records.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))
    return records if payloads else records.drop("payload")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages to an archive and returns what reading it back by index gives.

    One row per page row: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url. A page that wins by a null page_id is a response; its revisits refer to null.
    """
    spark = pages.sparkSession
    small_batches(spark, rows=500)
    folder = scratch_path(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    index = write_archive(choose_responses(pages, min_bytes), folder)
    records = read_records(index, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
