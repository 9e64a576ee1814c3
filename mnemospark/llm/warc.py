"""Web archives in which equal payloads are stored once.

Headers (digest, id, length) are summed by payload digest before they are shuffled,
which leaves one original per repeated payload; pages join their original by digest and
are written, each as a gzip member with fresh headers, a response with its payload or a
revisit that names the original. Payloads move once. A page below the least size gets
a join key of its own, so small or empty pages never gather; the join's large
partitions can be split.

Defined results: a null payload counts as empty; of equal payloads of at least
``least`` bytes the largest page id is the original (null ids never are, and without
another id such rows are all responses); rows that repeat the original's id and payload
are responses too; a null address is left out of the headers; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.arrow import arrow_map
from mnemospark.llm.files import read_file, spread_files, write_file
from mnemospark.plans.lineage import cut, shared_path

#: Payloads below so many bytes are always stored.
LEAST = 1000
#: A file is closed once it holds so many compressed bytes.
FILE_BYTES = 64 << 20
#: Compressed bytes that are looked at together.
PIECE = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def resolve(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, size, original, original_url): original is null for what is stored."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload")).withColumns(
        {"digest": F.sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload")}
    )
    first = (
        rows.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count("*").alias("n"))
        .where("n > 1 and original is not null")
        .select(F.col("digest").alias("key"), "original", "original_url")
    )
    key = F.when(F.col("size") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "size").cast("string")))
    same = F.col("page_id").eqNullSafe(F.col("original"))
    return rows.withColumn("key", key).join(first, "key", "left").select(
        "page_id", "url", "payload", "digest", "size", F.when(~same, F.col("original")).alias("original"), F.when(~same, F.col("original_url")).alias("original_url")
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}')}>"


def _clean(url: str) -> str:
    """An address that can't break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: str, digest: str, original: int | None, original_url: str | None, date: str) -> bytes:
    """One record, not yet compressed."""
    data = payload.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode() + (data if original is None else b"")
    head = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url and _clean(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("X-Page-Id", page_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if original is not None:
        head += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", _record_id(original, digest)),
            ("WARC-Refers-To-Target-URI", original_url and _clean(original_url)),
            ("X-Refers-To-Page-Id", original),
        ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(headers, HTTP headers, payload) of each record of a compressed file; digests are checked."""
    at, view = 0, memoryview(data)
    while at < len(data):
        member, pieces = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("the file ends inside a record")
            pieces.append(member.decompress(view[at : at + PIECE]))
            at += min(PIECE, len(data) - at) - len(member.unused_data)
        head, _, body = b"".join(pieces).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not an archive record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = body[: int(fields["Content-Length"])]
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"][5:]:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write deduplicated archives; one row per file: (path, n_records, n_bytes)."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal size
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            write_file(path, b"".join(held))
            out = pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(held)], "n_bytes": [size]})
            held.clear()
            size = 0
            return out

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                held.append(gzip.compress(record(*row, date), 6, mtime=0))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    rows = resolve(pages, page_id, url, html, least).select("page_id", "url", "payload", "digest", "original", "original_url")
    return cut(arrow_map(rows, run, "path string, n_records long, n_bytes long"), "archives")


def read_archives(files: DataFrame) -> DataFrame:
    """One row per record: (page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for fields, http, payload in records(read_file(path)):
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    kind = fields["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload in {path}")
                    number = lambda k, of=fields: int(of[k]) if k in of else None
                    rows.append((number("X-Page-Id"), fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind, number("X-Refers-To-Page-Id")))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = spread_files(files.select("path"))
    return arrow_map(spread, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
