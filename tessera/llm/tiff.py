"""TIFF as a media column: a writer and reader for 8-bit grayscale pages.

The reader walks the chain of image directories, decodes PackBits, LZW or deflate strips and tiles, undoes the horizontal
predictor, and emits one row per page. Constants are those of the TIFF 6.0 specification.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Fixed values of the format: tags, compressions, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4}
CLEAR, END = 256, 257
#: Bytes that one stored byte can stand for at most; a page that claims more is rejected before its samples are allocated.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1100, OLD_DEFLATE: 1100}


class TiffError(ValueError):
    """The bytes are not a TIFF file that this reader understands."""


def pack_packbits(raw: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and raw[j] == raw[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), raw[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or raw[j] != raw[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += raw[i:j]
        i = j
    return bytes(out)


def unpack_packbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        if i >= len(data):
            raise TiffError("PackBits data end early")
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out[:size])


def pack_lzw(raw: bytes) -> bytes:
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    table = {bytes((i,)): i for i in range(256)}
    put(CLEAR, 9)
    width, free, run = 9, 258, b""
    for i in range(len(raw)):
        longer = run + raw[i : i + 1]
        if longer in table:
            run = longer
            continue
        put(table[run], width)
        table[longer] = free
        free += 1
        if free == 4094:
            put(CLEAR, width)
            table, width, free = {bytes((i,)): i for i in range(256)}, 9, 258
        elif free + 1 > 1 << width:
            width += 1
        run = raw[i : i + 1]
    if run:
        put(table[run], width)
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(END, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    out, at, bits, held = bytearray(), 0, 0, 0
    table: list[bytes] = []
    width, last = 9, None
    while len(out) < size:
        while bits < width:
            if at >= len(data):
                raise TiffError("LZW data end early")
            held, bits, at = ((held << 8) | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = (held >> bits) & ((1 << width) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW code out of range")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += entry
        last = entry
    if len(out) < size:
        raise TiffError("LZW data end early")
    return bytes(out[:size])


def _compress(raw: bytes, how: int) -> bytes:
    return {NONE: bytes, LZW: pack_lzw, PACKBITS: pack_packbits, DEFLATE: lambda x: zlib.compress(x, 1)}[how](raw)


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        raw = data[:size]
    elif how in (DEFLATE, OLD_DEFLATE):
        try:
            raw = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    elif how == LZW:
        raw = unpack_lzw(data, size)
    elif how == PACKBITS:
        raw = unpack_packbits(data, size)
    else:
        raise TiffError(f"compression {how}")
    if len(raw) < size:
        raise TiffError("a strip or tile is short")
    return raw


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, big_endian: bool = False) -> bytes:
    """A TIFF file of 8-bit grayscale pages (height x width), in strips, or in tiles of the given (height, width)."""
    e = ">" if big_endian else "<"
    out = bytearray((b"MM" if big_endian else b"II") + struct.pack(e + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w = page.shape
        if tile:
            th, tw = tile
            padded = np.pad(page, ((0, -h % th), (0, -w % tw)))
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1), np.uint8))
            data = _compress(block.astype(np.uint8).tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)

        def many(values: list[int]) -> int:
            if len(values) == 1:
                return values[0]
            out.extend(struct.pack(f"{e}{len(values)}I", *values))
            return len(out) - 4 * len(values)

        entries = [(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        if tile:
            entries += [(TILE_WIDTH, 4, 1, tw), (TILE_HEIGHT, 4, 1, th), (TILE_OFFSETS, 4, len(offsets), many(offsets)), (TILE_BYTES, 4, len(sizes), many(sizes))]
        else:
            entries += [(STRIP_OFFSETS, 4, len(offsets), many(offsets)), (ROWS_PER_STRIP, 4, 1, rows_per_strip), (STRIP_BYTES, 4, len(sizes), many(sizes))]
        struct.pack_into(e + "I", out, link, len(out))
        out += struct.pack(e + "H", len(entries))
        for tag, kind, n, value in sorted(entries):
            out += struct.pack(e + "HHI", tag, kind, n) + (struct.pack(e + "HH", value, 0) if kind == 3 and n == 1 else struct.pack(e + "I", value))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a TIFF file, in the order of its directories."""
    try:
        yield from _pages(data)
    except TiffError:
        raise
    except (struct.error, LookupError, ValueError, ArithmeticError, MemoryError) as e:
        raise TiffError(f"malformed: {e!r}") from e


def _pages(data: bytes) -> Iterator[np.ndarray]:
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None or struct.unpack_from(e + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(e + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("the directories form a circle")
        seen.add(at)
        tags = {}
        (n,) = struct.unpack_from(e + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
            if kind not in TYPE_SIZE:
                continue
            where = at + 10 + 12 * i
            if TYPE_SIZE[kind] * count > 4:
                (where,) = struct.unpack_from(e + "I", data, where)
            tags[tag] = struct.unpack_from(f"{e}{count}{'BBHI'[kind - 1]}", data, where)
        yield _page(data, tags)
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def _page(data: bytes, tags: dict) -> np.ndarray:
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    if tags.get(BITS, (1,)) != (8,) or tags.get(SAMPLES, (1,)) != (1,):
        raise TiffError("only pages of one 8-bit sample are read")
    how, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    tiled = TILE_OFFSETS in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(tags.get(ROWS_PER_STRIP, (h,))[0], h))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    if min(w, h, bw, bh) < 1:
        raise TiffError("a page without pixels")
    across, down = -(-w // bw), -(-h // bh)
    if how not in EXPANSION:
        raise TiffError(f"compression {how}")
    if len(offsets) != across * down or len(sizes) != len(offsets):
        raise TiffError("strips or tiles are missing")
    if any(o + n > len(data) for o, n in zip(offsets, sizes, strict=True)) or sum(sizes) > len(data) or w * h > sum(sizes) * EXPANSION[how] + 64:
        raise TiffError("the page is larger than what the file holds")
    if tiled and across * down * bw * bh > sum(sizes) * EXPANSION[how] + 64:
        raise TiffError("the tiles are larger than what the file holds")
    page = np.zeros((-(-h // bh) * bh, across * bw), np.uint8)
    for i, (o, n) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, h - y)
        block = np.frombuffer(_expand(data[o : o + n], how, rows * bw), np.uint8).reshape(rows, bw)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        elif predictor != 1:
            raise TiffError(f"predictor {predictor}")
        page[y : y + rows, x : x + bw] = block
    return page[:h, :w]


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy and share of edges of a page."""
    n = samples.size
    p = np.bincount(samples.ravel(), minlength=256) / max(n, 1)
    p = p[p > 0]
    edges = float((np.abs(np.diff(samples.astype(np.int16), axis=1)) > 32).mean()) if samples.shape[1] > 1 and n else 0.0
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};edges={edges:.4f}"


WIDE = 64


#: Rows of a page at most.
PAGE_ROWS = 1024


def text_pages(text: bytes) -> list[np.ndarray]:
    """Bytes, with zeros up to a positive multiple of 64, as pages 64 samples wide."""
    raw = text + b"\0" * (-len(text) % WIDE if text else WIDE)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, WIDE)
    return [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]


def encode_texts(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """doc_id, n_bytes and media (a TIFF file of the text's UTF-8 bytes); null text is empty."""
    C.configure(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [(x or "").encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(text_pages(x), compression, predictor) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pages(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per page of each file: the key, page (from 0; -1 for a file that can't be read), width, height, samples
    (binary, row by row), feature, error. A null file has no pages; pages before a damaged one are kept."""
    C.configure(media.sparkSession)
    kind = dict(media.dtypes)[key]

    def run(batches):
        for b in batches:
            rows = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for i, page in enumerate(decode(data) if data is not None else ()):
                        rows.append((k, i, page.shape[1], page.shape[0], page.tobytes(), features(page), None))
                except TiffError as e:
                    rows.append((k, -1, None, None, None, None, str(e)))
            types = [b.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], [key, "page", "width", "height", "samples", "feature", "error"])

    return media.select(key, column).mapInArrow(run, f"{key} {kind}, page int, width int, height int, samples binary, feature string, error string")


def digests(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """Stores every text as a TIFF file, reads the file back and describes what was read.

    Writing and reading share a task, so nothing is shuffled and only one file at a time is held. Returns doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null text is empty (64 zero bytes are
    stored); repeated rows each give a row; other columns are ignored.
    """
    C.configure(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                media = encode(text_pages(raw), compression, predictor)
                page = np.concatenate(list(decode(media)))
                back = page.tobytes()
                rows.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDE:]), len(media), hashlib.sha256(media).hexdigest(), features(page)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
