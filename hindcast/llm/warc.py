"""WARC archives: a writer with revisit records for repeated payloads, and a reader that salvages damaged files.

The writer is a shuffle and Spark's text sink, the reader Spark's binary file source, so both work on any store that
Spark reaches. Rows are dealt to as many files as their bytes ask for; a task reads one file at a time. Compressed archives
have a gzip member per record, so that damage costs the records it hits. The sink puts one byte after each row: for
members that is a zero, which readers of gzip files skip as padding.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.scalars import quoted
from hindcast.llm.common import byte_slices, text_of, total_of
from hindcast.session import materialize

REVISIT_BYTES = 1000
PIECE = 1 << 14
FILE_BYTES = 64 << 20  # of records, before compression, per file
_MARK = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_ID = re.compile(r"<urn:page:(-?\d+)>")


def _line(name: str, value: Column) -> Column:
    """A header line without line breaks in its value; empty for null."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
                   compression: str = "none", file_bytes: int = FILE_BYTES) -> None:
    """Write a record per page under ``path``: payload the html in UTF-8, null as empty.

    Of records with equal payloads of at least REVISIT_BYTES that with the largest id is a response and the others are
    revisits of it, without payload; rows that share that id are all responses. A null id is smaller than any other and
    goes without record id. Repeated rows get a record each; a null url goes without target; very long ones are kept. With
    ``compression="gzip"`` each record is a gzip member. Files hold about ``file_bytes`` of records, and a larger record by
    itself more.
    """
    if compression not in ("none", "gzip"):
        raise ValueError(f"unknown compression {compression}")
    data = text_of(html).cast("binary")
    rows = pages.select(F.col(quoted(key)).alias("page_id"), F.col(quoted(url)).alias("url"), text_of(html).alias("html"),
                        F.octet_length(data).alias("bytes"), F.sha1(data).alias("digest"))
    # Digests and ids only; equal payloads combine on the map side.
    large = pages.select(F.col(quoted(key)).alias("page_id"), data.alias("data")) \
        .where(F.octet_length("data") >= REVISIT_BYTES).select("page_id", F.sha1("data").alias("digest"))
    # Written, so that the join below meets two plain tables and Spark can split a payload that many pages share.
    large = materialize(large)
    repeated = materialize(large.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
                           .where("n > 1"))
    again = large.join(repeated, "digest").where("NOT page_id <=> best") \
        .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "best").distinct()
    # Keyed by id and digest, which no group of copies shares.
    marked = rows.join(again, F.expr("page_id <=> r_id AND digest = r_digest"), "left")
    revisit = F.col("best").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name("page_id")), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Refers-To", name("best")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("bytes")), _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(revisit, 0).otherwise(F.col("bytes"))), F.lit("\r\n"))
    body = F.when(revisit, "").otherwise(F.col("html"))
    files = total_of(pages, F.octet_length(data).cast("long") + 512) // file_bytes + 1
    if compression == "gzip":
        members = marked.select(F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("value")) \
            .mapInArrow(_members, "value string")
        members.repartition(files).write.option("lineSep", "\0").text(path)
    else:
        # The sink ends each row with the line feed that a record ends with.
        marked.select(F.concat(head, body, F.lit("\r\n\r")).alias("value")).repartition(files) \
            .write.option("lineSep", "\n").text(path)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member. The bytes travel as text, which neither Arrow nor the text sink looks into."""
    for batch in batches:
        for lo, hi in byte_slices(batch.column(0)):
            members = []
            for value in batch.column(0).slice(lo, hi - lo):
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(packer.compress(value.as_buffer()) + packer.flush())
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(members), [
                None, pa.py_buffer(offsets), pa.py_buffer(b"".join(members))])], names=["value"])


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    gap: str | None = None  # why these bytes are quarantined; None for a record

    @property
    def digest(self) -> str:
        return self.headers.get("warc-payload-digest", "").removeprefix("sha1:").lower()


def _plain(data: bytes, pos: int) -> Record | str:
    """The record at ``pos``, or what is wrong with it."""
    head_end = data.find(b"\r\n\r\n", pos)
    if head_end < 0:
        return "header without end"
    headers = {}
    for line in data[pos:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without colon"
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        return "header without type or length"
    start = head_end + 4
    end = start + int(headers["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return "length does not meet the record's end"
    found = Record(pos, end + 4 - pos, headers, data[start:end])
    if headers["warc-type"] != "revisit" and found.digest and hashlib.sha1(found.payload).hexdigest() != found.digest:
        return "payload differs from its digest"
    return found


def salvage(data: bytes) -> Iterator[Record]:
    """Records of an archive of plain records, gzip members or both, and the byte ranges given up.

    After a failed check the search goes on at the next version line or member header. A member that fails still gives
    the records that it held whole and whose digest fits. Gaps next to each other are one; zeros between members are
    padding and no gap. Offsets of records in a member are the member's.
    """
    gap: Record | None = None
    for found in _scan(data):
        if found.gap is None:
            if gap:
                yield gap
            gap = None
            yield found
        elif gap and gap.offset + gap.length == found.offset:
            gap.length += found.length
        else:
            if gap:
                yield gap
            gap = found
    if gap:
        yield gap


def _scan(data: bytes) -> Iterator[Record]:
    pos = 0
    while pos < len(data):
        if data.startswith(b"WARC/1.", pos):
            found = _plain(data, pos)
            if isinstance(found, Record):
                yield found
                pos += found.length
                continue
            reason = found
        elif data.startswith(b"\x1f\x8b\x08", pos):
            member, parts, at = zlib.decompressobj(31), [], pos
            try:
                # A piece at a time: what follows the member's end is copied, and a file has many members.
                while at < len(data) and not member.eof:
                    parts.append(member.decompress(memoryview(data)[at:at + PIECE]))
                    at = min(at + PIECE, len(data))
                text, reason = b"".join(parts), "" if member.eof else "member without end"
            except zlib.error:
                text, reason = _until_error(data, pos), "member fails its check"
            if not reason:
                size = at - pos - len(member.unused_data)
                for inner in _scan(text):
                    yield Record(pos, size if inner.gap is None else 0, inner.headers, inner.payload, inner.gap)
                pos += size
                continue
            for inner in _scan(text):
                if inner.gap is None and inner.digest and inner.headers["warc-type"] != "revisit":
                    yield Record(pos, 0, inner.headers, inner.payload)
        elif data[pos] == 0 and (pos + 1 == len(data) or data[pos + 1] == 0 or _MARK.match(data, pos + 1)):
            pos += 1
            continue
        else:
            reason = "no record here"
        mark = _MARK.search(data, pos + 1)
        after = mark.start() if mark else len(data)
        yield Record(pos, after - pos, gap=reason)
        pos = after


def _until_error(data: bytes, pos: int, step: int = 4096) -> bytes:
    """What a damaged member gives before the error."""
    member, out = zlib.decompressobj(31), []
    try:
        for at in range(pos, len(data), step):
            out.append(member.decompress(data[at:at + step]))
            if member.eof:
                break
    except zlib.error:
        pass
    return b"".join(out)


SCHEMA = ("file string, offset long, length long, gap string, record_type string, page_id long, refers_to long, "
          "target_uri string, payload_digest string, payload_bytes long, payload binary")


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record and per quarantined gap (``gap`` says why) of all files under ``path``.

    The digest is the one computed from the payload, for revisits the stored one, as is the length. An empty file gives
    no rows. Files are read whole, one at a time.
    """
    number = lambda text: int(m[1]) if (m := _ID.fullmatch(text or "")) else None

    def row(file: str, r: Record) -> tuple:
        h = r.headers
        if r.gap is not None:
            return (file, r.offset, r.length, r.gap, None, None, None, None, None, None, None)
        again = h["warc-type"] == "revisit"
        size = h.get("x-payload-length", "")
        return (file, r.offset, r.length, None, h["warc-type"], number(h.get("warc-record-id")),
                number(h.get("warc-refers-to")), h.get("warc-target-uri"),
                r.digest if again else hashlib.sha1(r.payload).hexdigest(),
                (int(size) if size.isdigit() else None) if again else len(r.payload),
                r.payload if with_payload else None)

    kinds = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()),
             ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
             ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
             ("payload", pa.binary())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)],
                                          [n for n, _ in kinds])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for files in batches:
            for file, content in zip(files.column(0), files.column(1)):
                for r in salvage(content.as_py()):
                    rows.append(row(file.as_py(), r))
                    if len(rows) >= (64 if with_payload else 4096):
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, SCHEMA)
