"""WARC archives, index first.

``write_archives`` has every task write one archive of per-record gzip members
into the shared folder and return an index row for each record (archive,
offset, length, URL, digest); the index is written as a table. An archive's
name is unique to the task attempt and only committed attempts reach the
index, so files that a lost executor left behind are never read.

``read_records`` takes index rows, sorts them by archive and offset, coalesces
neighbouring byte ranges and reads each range once.

Defined results
---------------
* null html: an empty payload; null url: a record without a target URI;
* of equal payloads of at least ``min_revisit_bytes`` the smallest ``page_id``
  is the response, the others revisit it; rows that repeat that ``page_id``
  are responses too; a null ``page_id`` sorts last, and where all are null
  each row is a response;
* very long pages: one record each, written and read whole;
* empty table: no archive and no rows; other input columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, shuffle_width, text_batches, work_dir

_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f%]")

INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, record_type string"
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# The digits of base 32 as numbers are written and as RFC 4648 has them.
_DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_digest(text: Column) -> Column:
    """SHA-1 of the text in base 32: forty bits of it are eight digits."""
    hexadecimal = F.sha1(text)
    digits = [F.lpad(F.conv(F.substring(hexadecimal, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), *_DIGITS)


def with_digests(pages: DataFrame) -> DataFrame:
    """Adds ``payload_digest`` and ``payload_bytes``."""
    return pages.select("page_id", "url", "html").withColumns(
        {"payload_digest": base32_digest(F.coalesce("html", F.lit(""))), "payload_bytes": F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")}
    )


def with_revisits(digested: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the response's page for revisits, else null.

    The first page of each digest comes from a partial aggregate over two
    narrow columns. Digests seen once need no partner, so only repeated ones
    are joined; a digest of very many pages is a skewed side that can be split.
    """
    large = F.col("payload_bytes") >= min_revisit_bytes
    first = (
        digested.where(large)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    joined = digested.join(first, "payload_digest", "left")
    revisits = large & (F.col("first_page") < F.coalesce(F.col("page_id"), F.lit(2**63 - 1)))
    return joined.withColumn("refers_to", F.when(revisits, F.col("first_page"))).drop("first_page")


def encode_record(record: str, page_id, url, html, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record with its closing blank lines, not compressed. ``record`` names it alone."""
    payload = (html or "").encode()
    kind = "response" if refers_to is None else "revisit"
    body = _HEAD + payload if refers_to is None else _HEAD
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{record}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """The fields of one record; a response's digest is computed from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body[len(_HEAD) :] if fields["WARC-Type"] == "response" else None
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": urllib.parse.unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload_bytes": int(fields["X-Payload-Length"]) if payload is None else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"][5:] if payload is None else sha1_base32(payload),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"),
        "payload": payload,
    }


# Schemes of Hadoop file systems that Arrow has under another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _file_system(folder: str):
    """Arrow's file system for a folder that Spark names by URI or path, and the folder's path in it."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition("://")
    if colon:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.FileSystem.from_uri(folder if folder.startswith("file:") else os.path.abspath(folder))


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages as archives; returns the index, itself a written table."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(f"{folder}/archives")
        files.create_dir(root, recursive=True)
        name, out, offset = "", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            rows = []
            for row in batch.to_pylist():
                raw = encode_record(f"{name[:32]}:{offset}", row["page_id"], row["url"], row["html"], row["payload_digest"], row["refers_to"])
                member = gzip.compress(raw, 4, mtime=0)
                out.write(member)
                kind = "response" if row["refers_to"] is None else "revisit"
                rows.append((row["page_id"], name, offset, len(member), row["url"], row["payload_digest"], kind))
                offset += len(member)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(
                        zip(*rows),
                        (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()),
                        strict=True,
                    )
                ],
                names=["page_id", "archive", "offset", "length", "url", "payload_digest", "record_type"],
            )
        if out is not None:
            out.close()

    ready = with_revisits(with_digests(pages), min_revisit_bytes)
    text_batches(ready).mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index").withColumn("folder", F.lit(f"{folder}/archives"))


def read_records(
    index: DataFrame, with_payload: bool = True, gap_bytes: int = 1 << 16, range_bytes: int = 8 << 20
) -> DataFrame:
    """Read the records that ``index`` selects.

    Ranges at most ``gap_bytes`` apart are read as one, up to ``range_bytes``.
    Rows are dealt by archive and by 32 MiB stretch of it, so one large archive is read by many tasks.
    """
    spark = index.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                first, end = rows[at], at
                stop = first["offset"] + first["length"]
                while (
                    end + 1 < len(rows)
                    and (n := rows[end + 1])["archive"] == first["archive"]
                    and n["folder"] == first["folder"]
                    and n["offset"] - stop <= gap_bytes
                    and n["offset"] + n["length"] - first["offset"] <= range_bytes
                ):
                    end += 1
                    stop = max(stop, n["offset"] + n["length"])
                path = f"{first['folder']}/{first['archive']}"
                if path not in opened:
                    for old in opened.values():
                        old.close()
                    files, root = _file_system(first["folder"])
                    opened = {path: files.open_input_file(f"{root}/{first['archive']}")}
                data = opened[path].read_at(stop - first["offset"], first["offset"])
                found = []
                for row in rows[at : end + 1]:
                    start = row["offset"] - first["offset"]
                    record = decode_record(gzip.decompress(data[start : start + row["length"]]))
                    if not with_payload:
                        record["payload"] = None
                    found.append(record)
                schema = pa.schema(
                    [
                        ("page_id", pa.int64()),
                        ("url", pa.string()),
                        ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()),
                        ("record_type", pa.string()),
                        ("refers_to", pa.int64()),
                        ("payload", pa.binary()),
                    ]
                )
                yield pa.RecordBatch.from_pylist(found, schema=schema)
                at = end + 1
        for old in opened.values():
            old.close()

    dealt = (
        index.select("folder", "archive", "offset", "length")
        .repartition(shuffle_width(spark), "folder", "archive", F.floor(F.col("offset") / (32 << 20)))
        .sortWithinPartitions("folder", "archive", "offset")
    )
    return dealt.mapInArrow(read, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a record and read all archives back through the index."""
    index = write_archives(read_table(spark, sf_dir, "pages"))
    return read_records(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
