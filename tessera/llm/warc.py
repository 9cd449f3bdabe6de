"""WARC archives: a writer with identical-payload revisits, and a reader that salvages damaged files.

The reader checks every member and record (gzip trailer, header syntax, Content-Length, record end, block digest). After a
failed check it searches for the next gzip member that decompresses to a version line, or the next plain version line, from
which a whole valid record can be read; the bytes between are logged as a quarantined gap. Inside a gzip member it searches in the same way: of a
member with a bad record the others are kept, and of a cut or damaged one those records that come before the damage and have their block's digest;
such a member is a gap as a whole, as its compressed bytes can't be told apart.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Uncompressed payload of an archive: bounds what a row of the archive table holds (a longer record is an archive of its own).
ARCHIVE_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes given to the decompressor at once.
CHUNK = 1 << 14
#: What a member may decompress to; a larger one is treated as damaged there.
MEMBER_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_HTTP_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One uncompressed record; a revisit (refers_to given) carries the response's HTTP header but not its payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """raw as one gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(data: bytes, at: int, strict: bool = False) -> tuple[dict, bytes, int] | None:
    """Header, block and end of the record that starts at `at`; None if any check fails, or if it is to be strict and there is no digest of the block."""
    if not _VERSION.match(data, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or _VERSION.search(data, at + 1, end):  # the header was cut and another record follows
        return None
    header = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            return None
        header[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = header.get("content-length", "")
    if not length.isdigit() or "warc-type" not in header or "warc-record-id" not in header:
        return None
    start = end + 4
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[start:stop]
    algorithm, _, digest = header.get("warc-block-digest", "").partition(":")
    if algorithm == "sha1" and len(digest) == 40:
        if hashlib.sha1(block).hexdigest() != digest.lower():
            return None
    elif strict:
        return None
    return header, block, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member that starts at `at` decompresses to, as far as it goes, its end, and whether it is whole and its checksum holds."""
    z = zlib.decompressobj(31)
    parts, size, end = [], 0, at
    try:
        while not z.eof and end < len(data) and size <= MEMBER_BYTES:
            parts.append(z.decompress(data[end : end + CHUNK]))
            size += len(parts[-1])
            end += CHUNK
    except zlib.error:
        z = zlib.decompressobj(31)
        z.decompress(data[at:end])  # the bytes before the damage once more, then one by one up to it
        for i in range(end, len(data)):
            try:
                parts.append(z.decompress(data[i : i + 1]))
            except zlib.error:
                break
        return b"".join(parts), at, False
    return b"".join(parts), min(end, len(data)) - len(z.unused_data), z.eof


def _records(raw: bytes, strict: bool) -> tuple[list[tuple[dict, bytes]], bool]:
    """The valid records of decompressed bytes, and whether there is nothing else."""
    records, at, clean = [], 0, True
    while at < len(raw):
        if (got := parse_record(raw, at, strict)) is not None:
            records.append(got[:2])
            at = got[2]
            continue
        clean = False
        found = _VERSION.search(raw, at + 1)
        if not found:
            break
        at = found.start()
    return records, clean


def salvage(data: bytes) -> tuple[list[tuple[dict, bytes]], list[tuple[int, int]]]:
    """All records that can be recovered, in order, and the quarantined gaps [start, end)."""
    records, gaps, at, bad = [], [], 0, None
    while at < len(data):
        found, end, clean = [], at, False
        if data.startswith(_MAGIC, at):
            raw, end, whole = _inflate(data, at)
            found, clean = _records(raw, not whole)
            clean &= whole
            if not clean and whole and found:  # its end is known, so the search goes on behind it
                if bad is None:
                    bad = at
                records += found
                gaps.append((bad, end))
                at, bad = end, None
                continue
        elif (got := parse_record(data, at)) is not None:
            found, end, clean = [got[:2]], got[2], True
        if clean:
            if bad is not None:
                gaps.append((bad, at))
            records += found
            at, bad = end, None
            continue
        records += found
        bad = at if bad is None else bad
        next_ = _START.search(data, at + 1)
        at = next_.start() if next_ else len(data)
    if bad is not None:
        gaps.append((bad, len(data)))
    return records, gaps


def write_archives(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Archives (content binary) with one record for every row of pages (page_id, url, html; other columns are ignored).

    Null html is an empty payload. Among rows with equal payloads of at least revisit_bytes bytes those with the largest page_id are
    responses and the others revisit it (repeated rows with that page_id are all responses; a null page_id is below any other);
    a group whose page_ids are all null has responses only.
    """
    C.configure(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    small = rows.filter(F.octet_length("html") >= revisit_bytes).select("page_id", "digest")
    latest = C.materialize(small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n"), "warc-latest", False)
    revisits = small.join(latest, "digest").filter("page_id is null or page_id < refers_to").groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"))
    rows = rows.alias("r").join(revisits.alias("v"), F.expr("r.page_id <=> v.page_id and r.digest = v.digest"), "left").select("r.page_id", "r.url", "r.html", "r.digest", "v.refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])

        held, size = [], 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                if held and size + len(payload) > ARCHIVE_BYTES:
                    yield out()
                    held, size = [], 0
                held.append(member(record(page_id, url, payload, digest, refers_to)))
                size += len(payload)
        if held:
            yield out()

    return rows.mapInArrow(pack, "content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of the archives (column content): page_id, payload_bytes, payload_digest, record_type, refers_to,
    valid (a response whose payload has its digest; revisits, true), gap_start and gap_end (of a quarantined gap; the other columns are then null).
    A null or empty archive has neither."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("valid", pa.bool_()), ("gap_start", pa.int64()), ("gap_end", pa.int64())])

    def number(uri: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                records, gaps = salvage(content.as_py() or b"")
                rows = []
                for header, block in records:
                    head, _, payload = block.partition(b"\r\n\r\n")
                    told = header.get("warc-payload-digest", "").removeprefix("sha1:")
                    if header["warc-type"] == "revisit":
                        length = _HTTP_LENGTH.search(head + b"\r\n")
                        rows.append((number(header["warc-record-id"]), int(length[1]) if length else None, told, "revisit", number(header.get("warc-refers-to")), True, None, None))
                    else:
                        digest = hashlib.sha1(payload).hexdigest()
                        rows.append((number(header["warc-record-id"]), len(payload), digest, header["warc-type"], None, digest == told, None, None))
                rows += [(None, None, None, None, None, None, a, b) for a, b in gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("content").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean, gap_start long, gap_end long")
