"""WARC archives: a sequential reader and a writer with identical-payload revisits.

Reading: an archive is a chain of gzip members, one per record.  Each member is inflated
incrementally with zlib until its end, headers are parsed from its start, ``Content-Length`` frames
the block, and block and payload digests are verified.  Archives are handed over as binary rows
(``spark.read.format("binaryFile")`` or a table), so any store that Spark reads will do.

Writing: of records with equal payloads of at least ``least`` bytes the one with the largest page id
is a response, the others are revisits that refer to it and keep only the HTTP headers (whose
``Content-Length`` still names the full payload); smaller payloads are always responses.

Defined results: a null html is an empty payload; a null url is written as an empty target; rows
with the same page id and payload are all responses or all revisits of the same page; a row without
page id is a response with an empty id, neither a revisit nor revisited; other columns are ignored.
A damaged record fails the job, or with ``damaged="keep"`` becomes a row of type ``damaged`` with the
reason, and reading goes on at the next member that can be inflated.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
)
_EPOCH = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, level: int = 3) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    payload_digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {(url or '').translate({10: 32, 13: 32})}",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Payload-Digest: {payload_digest}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
        ]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(archive: bytes, step: int = 1 << 16, damaged: Callable[[str], None] | None = None) -> Iterator[bytes]:
    """The inflated gzip members of an archive, one at a time.

    A member that can't be inflated raises, or is told to ``damaged`` once per damaged stretch.
    """
    view, at, told = memoryview(archive), 0, False
    while at < len(view):
        start, z, parts = at, zlib.decompressobj(31), []
        try:
            while not z.eof:
                chunk = view[at : at + step]
                if not chunk:
                    raise ValueError("the archive ends within a member")
                parts.append(z.decompress(chunk))
                at += len(chunk) - len(z.unused_data)
        except (zlib.error, ValueError) as error:
            if damaged is None:
                raise ValueError(f"member at byte {start}: {error}") from error
            if not told:
                damaged(f"member at byte {start}: {error}")
            told, at = True, archive.find(_MAGIC, start + 1)
            if at < 0:
                return
            continue
        told = False
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; raises ValueError if framing or digest is wrong."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not blank or not lines[0].startswith("WARC/"):
        raise ValueError("no record header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block doesn't have its content length")
    if (named := headers.get("warc-block-digest")) and named != _digest(block):
        raise ValueError(f"block digest of {headers.get('warc-record-id')} differs")
    return headers, block


def _page(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _row(data: bytes, keep_payload: bool) -> tuple | None:
    """A record's row, or None if it is of another type; raises if framing or a digest is wrong."""
    headers, block = parse_record(data)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = (x.partition(b":") for x in http.split(b"\r\n"))
    length = next((int(v) for k, _, v in fields if k.lower() == b"content-length"), None)
    if length is None:
        raise ValueError(f"{headers.get('warc-record-id')} names no payload length")
    named = headers["warc-payload-digest"]
    if kind == "response" and (len(payload) != length or _digest(payload) != named):
        raise ValueError(f"payload digest of {headers['warc-record-id']} differs")
    refers = headers.get("warc-refers-to")
    return (
        _page(headers["warc-record-id"]), headers["warc-target-uri"], kind, _page(refers) if refers else None, length,
        binascii.hexlify(base64.b32decode(named.removeprefix("sha1:"))).decode(), payload if keep_payload and kind == "response" else None, None,
    )


def read_archives(archives: DataFrame, keep_payload: bool = True, damaged: str = "fail") -> DataFrame:
    """Records of archives given as rows with a binary column ``content``, in their order.

    Only ``response`` and ``revisit`` records of this writer's ids are returned; the payload of a
    revisit is null.  ``damaged`` is "fail" or "keep".
    """
    keep = damaged == "keep"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0):
                rows = []
                note = lambda text, rows=rows: rows.append((None, None, "damaged", *[None] * 4, text))
                for data in members(archive.as_py() or b"", damaged=note if keep else None):
                    try:
                        row = _row(data, keep_payload)
                    except (ValueError, KeyError) as error:
                        if not keep:
                            raise
                        note(f"{type(error).__name__}: {error}")
                        continue
                    if row:
                        rows.append(row)
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    [f.split()[0] for f in RECORDS.split(", ")],
                )

    return archives.select("content").mapInArrow(run, RECORDS)


def write_archives(pages: DataFrame, least: int = 1000, archive_bytes: int = 8 << 20) -> DataFrame:
    """Archives of all pages as rows with a binary column ``content`` of about ``archive_bytes`` at most."""
    bounded_batches(pages.sparkSession)
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).alias("n"),
    )
    # Which page holds a payload: one row per digest, combined before the shuffle.
    large = pages.filter(F.col("n") >= least)
    holders = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("uses")).filter("uses > 1")
    revisits = (
        large.select("page_id", "digest")
        .join(holders.select("digest", "holder").hint("merge"), "digest")
        .filter("page_id <> holder")
        .distinct()
    )
    marked = pages.join(revisits.hint("merge"), ["page_id", "digest"], "left").select(
        "page_id", "url", "payload", "digest", "holder"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0
        for b in batches:
            for page_id, url, payload, digest, holder in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.append(write_record(page_id, url, payload.encode(), digest, holder))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])

    return marked.mapInArrow(run, "content binary")


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write archives of all pages to the shared folder and read their records back."""
    return read_archives(materialize(write_archives(pages, least), "archives"), keep_payload=False)
