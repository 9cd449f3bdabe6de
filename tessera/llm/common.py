"""Shared plumbing: durable intermediate tables, Arrow text buffers, word hashing."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch and bytes of text worked on at once in a Python worker.
BATCH_ROWS = 512
PIECE_BYTES = 2 << 20

LEAST_LONG = -(2**63)


def configure(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests, local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Folders that materialize() has written and discard() hasn't deleted.
_WRITTEN: list[str] = []


def write(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again; discard_since() leaves it there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def materialize(df: DataFrame, label: str, release_shuffles: bool = True) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it again: later stages don't depend on executors' local files."""
    out = write(df, label)
    _WRITTEN.append(out._written_to)
    if release_shuffles:
        release(df.sparkSession)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() returned, when no plan that is still to run reads them."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)


def written() -> int:
    """A mark for discard_since()."""
    return len(_WRITTEN)


def discard_since(spark: SparkSession, mark: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes all but `keep` of what materialize() has written since the mark and not discarded; only for callers that know that nothing reads it any more."""
    for path in _WRITTEN[mark:]:
        if keep is None or path != keep._written_to:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs, so that stages don't add up on disk.

    The first collection ends the plans, the second what only they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it a name that no column of df has (upper or lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_keys(rows: DataFrame, key: str = "_row_key") -> DataFrame:
    """rows and a long that no two of them share, in the order of doc_id (null: the least), then text.

    It is the doc_id itself unless an id repeats; then rows are sorted, numbered and written down, so that later reads agree on the numbers. Equal rows can be
    sorted in several tasks, as a salt comes last in the order.
    """
    of = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG))
    if not rows.groupBy(of.alias("i")).count().filter("count > 1").head(1):
        return rows.withColumn(key, of)
    salted = rows.withColumn(key, F.xxhash64(F.monotonically_increasing_id()))
    return materialize(salted.orderBy(of, "text", key).withColumn(key, F.monotonically_increasing_id()), "row-keys")


#: Ids that are sent to all executors at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't among ids (key), a table that is written: few ids are broadcast, so that rows aren't shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti")


def at_position(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are <= value, by binary search in the JVM (null: 0)."""
    if not bounds:
        return F.lit(0)
    steps = max(1, len(bounds).bit_length() + 1)
    table_ = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) < 64 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
    low_high = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(
                F.element_at(table_, F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1) <= value,
                F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi")),
            ).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
        ),
    )
    return F.when(value.isNull(), F.lit(0)).otherwise(low_high["lo"]).cast("int")


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of text."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return r["n"], int(r["b"] or 0)


def slice_bounds(docs: DataFrame, slice_bytes: int, least: int = 64) -> tuple[list[int], int, int]:
    """Bounds of doc_id between slices that hold about slice_bytes of text each; also the number of rows and of bytes."""
    n, size = text_size(docs)
    k = max(least, -(-size // slice_bytes))
    probs = [i / k for i in range(1, k)]
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(p) for p in probs]), 20 * k).alias("q")).first()["q"] if n else None
    return sorted({b for b in bounds or [] if b is not None}), n, size


def with_slices(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """(doc_id, text, slice): slices are ranges of doc_id; null ids are in slice 0."""
    return docs.select("doc_id", "text", at_position(bounds, F.col("doc_id")).alias("slice"))


# ---- text as bytes -------------------------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and their n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES):
    """Ranges [i, j) of documents of at most `most` bytes together; a longer document is a piece of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: White space that parts words: space and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed in numpy; a longer one goes through BLAKE2b.
LANES = 4


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i] : starts[i] + lengths[i]]; lengths are 1 or more.

    Eight bytes at a time are mixed into the state by a bijection that isn't linear, so no pattern of bytes cancels out. Different words of
    equal length up to 8 bytes never collide, others by chance only.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = mix(lengths.astype(np.uint64) * _BASE)
    where = slice(None)
    for lane in range(LANES):
        s, n = starts[where] + 8 * lane, np.minimum(lengths[where] - 8 * lane, 8)
        out[where] = mix(out[where] ^ (lanes[s] & (ones >> ((8 - n) * 8).astype(np.uint64))))
        where = np.flatnonzero(lengths > 8 * (lane + 1))
        if not len(where):
            return out
    for i in where.tolist():
        word = data[starts[i] : starts[i] + lengths[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def distinct_segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of data[offsets[i] : offsets[i + 1]], compared byte by byte: their bytes, offsets, and which of them each is."""
    column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    _, offs, flat = coded.dictionary.buffers()
    n = len(coded.dictionary)
    at = np.frombuffer(offs, np.int32, n + 1, coded.dictionary.offset * 4).astype(np.int64)
    flat = np.frombuffer(flat, np.uint8) if flat is not None and flat.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0], coded.indices.to_numpy(zero_copy_only=False)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words in the concatenated texts, and the n+1 word offsets of the texts."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] |= inside[cut]
    end[cut - 1] |= inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1 - starts, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of hashes[i : i + k] for every i, by doubling; len(hashes) - k + 1 values. Each step mixes, so none is linear in the words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out, done, level, width = np.array([_BASE]), None, 0, hashes, 1
    rest = k
    while rest:
        if rest & 1:
            part = level[done : done + n]
            out = part.copy() if out is None else mix(out * base + part)
            done += width
        rest >>= 1
        if rest:
            level, width = mix(level[:-width] * base + level[width:]), width * 2
    return mix(out + base)


class IdCache:
    """Token ids of the words a worker has met, found by their 64-bit hashes in sorted arrays and then compared byte by byte: a piece's words are looked up at once.

    New words go to a small array that is merged into the large one now and then. Beyond `most` words all are forgotten but those of the piece at hand.
    Of different words with equal hashes the first is remembered; the others are encoded whenever they occur.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))] * 2
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.letters, self.lettered = np.zeros(1 << 16, np.uint8), 0

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def _append(self, ids: np.ndarray) -> int:
        self.flat, at = _grown(self.flat, self.used, ids), self.used
        self.used += len(ids)
        return at

    def _remember(self, raw: np.ndarray) -> int:
        self.letters, at = _grown(self.letters, self.lettered, raw), self.lettered
        self.lettered += len(raw)
        return at

    def find(self, data: np.ndarray, offsets: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Where in `flat` the ids of the distinct words data[offsets[i] : offsets[i + 1]] start, and how many they are; encode(numbers of words) gives a list of ids for each."""
        size = np.diff(offsets)
        h = segment_hashes(data, offsets[:-1], size)
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        begin, count = self._find(ranked, data, offsets[:-1][order], size[order].astype(np.int32), lambda places: encode(order[places]))
        at, n = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        at[order], n[order] = begin, count
        return at, n

    def _find(self, h: np.ndarray, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        at, n, new, apart = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.ones(len(h), bool), np.zeros(len(h), bool)
        apart[1:] = h[1:] == h[:-1]
        for known, starts, sizes, places, letters in self.levels:
            if len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero((known[i] == h) & ~apart)
                j = i[hit]
                same = letters[j] == lengths[hit]
                hit_, j_ = hit[same], j[same]
                differ = self.letters[gather_at(places[j_], lengths[hit_])] != data[gather_at(begins[hit_], lengths[hit_])]
                wrong = np.zeros(len(hit), bool)
                wrong[~same] = True
                wrong[np.flatnonzero(same)[np.unique(np.repeat(np.arange(len(hit_)), lengths[hit_])[differ])]] = True
                apart[hit[wrong]] = True
                hit, j = hit[~wrong], j[~wrong]
                at[hit], n[hit] = starts[j], sizes[j]
                new[hit] = False
        where = np.flatnonzero(new)
        if len(where):
            fresh = where[~apart[where]]
            if len(self) + len(fresh) > self.most:
                old = np.flatnonzero(~new)
                ids, raw = self.flat[gather_at(at[old], n[old])], data[gather_at(begins[old], lengths[old])]
                self.clear()
                at[old] = self._append(ids) + np.cumsum(n[old]) - n[old]
                place = self._remember(raw) + np.cumsum(lengths[old]) - lengths[old]
                self.levels[0] = h[old], at[old], n[old].astype(np.int32), place.astype(np.int64), lengths[old]
            lists = encode(where)
            n[where] = [len(x) for x in lists]
            at[where] = self._append(np.fromiter((i for x in lists for i in x), np.uint32, int(n[where].sum()))) + np.cumsum(n[where]) - n[where]
            place = self._remember(data[gather_at(begins[fresh], lengths[fresh])]) + np.cumsum(lengths[fresh]) - lengths[fresh]
            self.levels[1] = _merged(self.levels[1], (h[fresh], at[fresh], n[fresh].astype(np.int32), place.astype(np.int64), lengths[fresh]))
            if len(self.levels[1][0]) > max(1 << 16, len(self.levels[0][0]) // 8):
                self.levels = [_merged(*self.levels), tuple(x[:0] for x in self.levels[1])]
        return at, n


def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """array with `more` from place `used` on, enlarged by doubling where it is full."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.zeros(max(used, len(more)) + len(more), array.dtype)])
    array[used : used + len(more)] = more
    return array


def _merged(a: tuple, b: tuple) -> tuple:
    """Columns a and b in the order of their first."""
    place = np.searchsorted(a[0], b[0])
    return tuple(np.insert(x, place, y) for x, y in zip(a, b, strict=True))


def gather_at(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def to_text(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The Arrow string column of data cut at offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
