"""The single-file archive: "ASCD", version and count, index length, index, payloads; offsets count from the payloads' start.

Writing is an ordered commit by one writer, as the format asks for; only names, dimensions and lengths are sorted together, payloads stream to the file
in order. Reading is a Python data source whose index never touches payloads; a filter on name reaches the reader.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

# fixed by the format
MAGIC, VERSION = b"ASCD", 1
HEAD, LENGTH, ENTRY = struct.Struct("<BI"), struct.Struct("<I"), struct.Struct("<HHHQI")


class ArchiveError(ValueError):
    """A file that is no archive of this version."""


def pack_index(entries: list[tuple[str, int, int, int]]) -> bytes:
    """Header and index of (name, width, height, length), payloads following in this order."""
    out, offset = bytearray(), 0
    for name, width, height, length in entries:
        raw = name.encode()
        if len(raw) > 0xFFFF:
            raise ArchiveError("a name exceeds 65535 bytes")
        out += ENTRY.pack(len(raw), width, height, offset, length) + raw
        offset += length
    return MAGIC + HEAD.pack(VERSION, len(entries)) + LENGTH.pack(len(out)) + bytes(out)


def write(results: DataFrame, path: str) -> int:
    """Writes results(name, width, height, payload; failed ones without payload are left out) in order of name; returns their number."""
    rows = results.filter(F.col("payload").isNotNull()).select("name", "width", "height", "payload").persist()
    try:
        index = [(r["name"], r["width"], r["height"], r["n"]) for r in rows.select("name", "width", "height", F.octet_length("payload").alias("n")).orderBy("name", "n").collect()]
        with open(path, "wb") as f:
            f.write(pack_index(index))
            for r in rows.orderBy("name", F.octet_length("payload")).select("payload").toLocalIterator():
                f.write(r["payload"])
        return len(index)
    finally:
        rows.unpersist()


def pack(entries: list[tuple[str, int, int, bytes]]) -> bytes:
    """An archive of (name, width, height, payload), in this order."""
    return pack_index([(name, width, height, len(payload)) for name, width, height, payload in entries]) + b"".join(bytes(e[3]) for e in entries)


def unpack(data: bytes) -> list[tuple[str, int, int, bytes]]:
    """The entries of an archive in memory."""
    index, base = parse_index(io.BytesIO(data))
    return [(name, width, height, data[base + at : base + at + n]) for name, width, height, at, n in index]


def read_index(path: str) -> tuple[list[tuple[str, int, int, int, int]], int]:
    """Entries (name, width, height, offset, length) and where the payloads begin."""
    with open(path, "rb") as f:
        return parse_index(f)


def parse_index(f) -> tuple[list[tuple[str, int, int, int, int]], int]:
    head = f.read(len(MAGIC) + HEAD.size + LENGTH.size)
    if len(head) < len(MAGIC) + HEAD.size + LENGTH.size or head[: len(MAGIC)] != MAGIC:
        raise ArchiveError("not an archive")
    version, count = HEAD.unpack_from(head, len(MAGIC))
    if version != VERSION:
        raise ArchiveError(f"version {version} is not supported")
    (size,) = LENGTH.unpack_from(head, len(MAGIC) + HEAD.size)
    raw = f.read(size)
    out, at = [], 0
    for _ in range(count):
        if at + ENTRY.size > len(raw):
            raise ArchiveError("the index ends early")
        n, width, height, offset, length = ENTRY.unpack_from(raw, at)
        at += ENTRY.size
        out.append((raw[at : at + n].decode(), width, height, offset, length))
        at += n
    return out, len(head) + size


class Entries(InputPartition):
    def __init__(self, entries: list, base: int):
        self.entries, self.base = entries, base


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, per_task: int):
        self.path, self.payload, self.per_task, self.name = path, payload, per_task, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",) and self.name is None:
                self.name = f.value
            else:
                yield f

    def partitions(self) -> list[Entries]:
        entries, base = read_index(self.path)
        entries = [e for e in entries if self.name is None or e[0] == self.name]
        return [Entries(entries[i : i + self.per_task], base) for i in range(0, len(entries), self.per_task)] or [Entries([], base)]

    def read(self, part: Entries) -> Iterator[tuple]:
        if not self.payload:
            yield from part.entries
            return
        with open(self.path, "rb") as f:
            for e in part.entries:
                f.seek(part.base + e[3])
                yield (*e, f.read(e[4]))


class ArchiveSource(DataSource):
    """Format "tessera_archive"; option payload=false reads the index only."""

    @classmethod
    def name(cls) -> str:
        return "tessera_archive"

    def schema(self) -> str:
        own = "name string, width int, height int, offset long, length long"
        return own + (", payload binary" if self._payload() else "")

    def _payload(self) -> bool:
        return str(self.options.get("payload", "true")).lower() == "true"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self._payload(), int(self.options.get("entriesPerTask", 64)))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tessera_archive").option("payload", str(payload).lower()).load(path)
