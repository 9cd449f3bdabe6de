"""Packing documents into training sequences along a Hilbert curve.

Every document's token ids (a word-level cache in front of the public tokenizer) are hashed to a vector that is projected to a few
dimensions; its coordinates, scaled by the corpus' means and deviations, have a Hilbert key. Documents are range-sorted by
(key, doc_id, digest) and laid end to end; sequences are cut every `length` tokens, so only the very last one is padded.

Texts are tokenized once, into a table in the shared folder. Of that, only small columns (key, tokens) are sorted and counted first, which gives each
range of the curve its bounds and its first token's place. Then the ids travel once, to their range.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bpe import CACHE_WORDS

DIMS, BITS = 4, 12
HASHED = 1024
#: Tokens of one range of the curve.
RANGE_TOKENS = 4_000_000


class WordTokenizer:
    """A tokenizers file whose encoding of a text is that of its words (at ASCII white space) put together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known = C.IdCache(CACHE_WORDS)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their n+1 offsets."""
        starts, lengths, at = C.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        inside, distinct_at, name = C.distinct_segments(data[~C.SPACE[data]], np.concatenate([[0], np.cumsum(lengths)]))

        def encode(places):
            raw = inside.tobytes()
            found = self.tokenizer.encode_batch_fast([raw[a:z].decode() for a, z in zip(distinct_at[places].tolist(), distinct_at[places + 1].tolist(), strict=True)], add_special_tokens=False)
            return [e.ids for e in found]

        begins, sizes = self.known.find(inside, distinct_at, encode)
        n = sizes[name]
        return self.known.flat[C.gather_at(begins[name], n)], np.concatenate([[0], np.cumsum(n)])[at]


@lru_cache(maxsize=4)
def load(path: str) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordTokenizer(path)


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    """Vocabulary ids hashed to signed rows of a Gaussian matrix (HASHED x DIMS); fixed point, so that sums don't depend on their order."""
    ids = np.arange(1 << 16, dtype=np.uint64)
    h = C.mix(ids + np.uint64(1))
    matrix = np.random.Generator(np.random.PCG64(11)).normal(size=(HASHED, DIMS))
    return np.rint(matrix[(h % np.uint64(HASHED)).astype(np.int64)] * np.where(h >> np.uint64(63), 1 << 20, -(1 << 20))[:, None]).astype(np.int64)


def vectors(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The projected average of each document's hashed tokens (every document ends with an id, so none is empty)."""
    table = projection()
    out = np.empty((len(at) - 1, DIMS))
    for d in range(DIMS):
        out[:, d] = np.add.reduceat(table[ids & 0xFFFF, d], at[:-1])
    return out / np.diff(at)[:, None]


def hilbert_key(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve through the grid of side 2**bits: n x d unsigned integers to n integers.

    The axes are turned to the curve's transposed index (J. Skilling, 2004), whose bits are then interleaved.
    """
    x = coordinates.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def keys(v: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    side = 1 << BITS
    return hilbert_key(np.clip((np.nan_to_num((v - mean) / spread) / 6 + 0.5) * side, 0, side - 1).astype(np.int64))


def _tokens(batch, tokenizer: WordTokenizer, end_id: int):
    """Pieces of a batch: rows [i, j), their ids with end_id after each text, and offsets."""
    data, offsets = C.text_bytes(batch.column(1))
    for i, j in C.pieces(offsets, 1 << 20):
        o = offsets[i : j + 1]
        ids, at = tokenizer.encode_bytes(data[o[0] : o[-1]], o - o[0])
        yield i, j, np.insert(ids, at[1:], end_id).astype(np.uint32), at + np.arange(len(at)), data, offsets


def _doc_digest(data, offsets, i, j) -> np.ndarray:
    raw = data[offsets[i] : offsets[j]].tobytes()
    o = offsets[i : j + 1] - offsets[i]
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(o[:-1], o[1:], strict=True)], np.int64)


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2, carry_ids: bool = False, least_ranges: int = 64) -> DataFrame:
    """Packs all documents into sequences of at most `length` tokens.

    Returns per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset,
    and with carry_ids ids (binary, little-endian unsigned 32-bit). A document is the tokenizer's ids and then end_id; null
    text is empty, so it is one piece of one id. Documents are cut where a sequence is full; all sequences but the last are
    full. Rows with equal doc_ids are documents of their own; a null doc_id sorts first. An empty table gives no rows.
    """
    spark = docs.sparkSession
    C.configure(spark)
    docs = docs.select("doc_id", "text")

    def measure(batches):
        tokenizer = load(vocabulary)
        for b in batches:
            for i, j, ids, at, data, offsets in _tokens(b, tokenizer, end_id):
                v = vectors(ids, at)
                wire = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
                blobs = pa.array([wire[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(_doc_digest(data, offsets, i, j)), pa.array(np.diff(at)), *(pa.array(v[:, d]) for d in range(DIMS)), pa.array(np.full(j - i, wire.itemsize, np.int32)), blobs], names)

    axes = [f"v{d}" for d in range(DIMS)]
    names = ["doc_id", "digest", "n", *axes, "width", "ids"]
    whole = C.materialize(docs.mapInArrow(measure, "doc_id long, digest long, n long, " + ", ".join(f"{v} double" for v in axes) + ", width int, ids binary"), "pack-ids", False)
    small = whole.select("doc_id", "digest", "n", *axes)
    stats = small.agg(F.sum("n").alias("n"), *(F.avg(v).alias(f"m{d}") for d, v in enumerate(axes)), *(F.stddev_pop(v).alias(f"s{d}") for d, v in enumerate(axes))).first()
    total = int(stats["n"] or 0)
    mean = np.array([stats[f"m{d}"] or 0.0 for d in range(DIMS)])
    spread = np.array([stats[f"s{d}"] or 1.0 for d in range(DIMS)])
    ranges = max(least_ranges, -(-total // RANGE_TOKENS))

    def place(batches):
        for b in batches:
            v = np.stack([b.column(3 + d).to_numpy() for d in range(DIMS)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys(v, mean, spread)), b.column(0), b.column(1), b.column(2)], ["key", "doc_id", "digest", "n"])

    order = ["key", "id", "digest"]
    placed = small.mapInArrow(place, "key long, doc_id long, digest long, n long").select("key", F.coalesce("doc_id", F.lit(C.LEAST_LONG)).alias("id"), "digest", "n")
    parts = placed.repartitionByRange(ranges, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n"), F.min(F.struct(*order)).alias("low"))
    bounds = sorted((tuple(r["low"]), r["n"]) for r in parts.collect())  # one row for each range
    lows = [b[0] for b in bounds]
    base = np.concatenate([[0], np.cumsum([b[1] for b in bounds])]).astype(np.int64)

    def send(batches):
        for b in batches:
            v = np.stack([b.column(3 + d).to_numpy() for d in range(DIMS)], axis=1)
            key, of = keys(v, mean, spread), b.column(0).fill_null(C.LEAST_LONG).to_numpy()
            where = np.array([_range(lows, t) for t in zip(key.tolist(), of.tolist(), b.column(1).to_pylist(), strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(key), b.column(1), b.column(0), b.column(3 + DIMS), b.column(4 + DIMS)], ["range", "key", "digest", "doc_id", "width", "ids"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if carry_ids else "")

    def lay(key_, t):
        r = key_[0].as_py()
        order = np.lexsort((t.column("digest").to_numpy(), t.column("doc_id").fill_null(C.LEAST_LONG).to_numpy(), t.column("key").to_numpy()))
        doc_id, wire, width = t.column("doc_id").to_pylist(), t.column("ids"), t.column("width").to_pylist()
        at, rows = int(base[r]), []
        for k in order.tolist():
            ids = np.frombuffer(wire[k].as_py(), f"<u{width[k]}").astype("<u4")
            cuts = [0, *range(length - at % length, len(ids), length), len(ids)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                raw = ids[a:z].tobytes()
                rows.append((doc_id[k], a, z - a, zlib.crc32(raw), len(ids), (at + a) // length, (at + a) % length, raw))
            at += len(ids)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        return pa.table([pa.array(c, pa.int64()) for c in columns[:7]] + ([pa.array(columns[7], pa.binary())] if carry_ids else []), names=names + ["ids"] * carry_ids)

    return whole.mapInArrow(send, "range int, key long, digest long, doc_id long, width int, ids binary").groupBy("range").applyInArrow(lay, schema)


def _range(lows: list[tuple], t: tuple) -> int:
    import bisect

    return bisect.bisect_right(lows, t) - 1
