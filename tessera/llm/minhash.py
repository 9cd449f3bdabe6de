"""Near-duplicate documents by improved consistent weighted sampling (S. Ioffe, 2010) over TF-IDF shingles.

1. Of equal texts one is looked at. Slices (ranges of doc_id) send the distinct shingles of their texts to buckets of the hash space, once a slice however
   many texts hold them; buckets add up document frequencies and answer each slice, in the order it sent.
2. A slice weighs its texts' shingles by count and idf. What a text shares with others can't exceed the weight of its shingles that other texts have; where that is below
   the threshold it is alone, which settles most texts. For the others consistent weighted samples are drawn, and a sketch is written: band hashes, whole and shared weight, the
   weights of the shared shingles, and its prefix (see prefixes()).
3. Of each band's bucket every text is verified by weighted Jaccard similarity against the least one and against the one that meets most others;
   components of these links are formed. Pairs inside a component can't change it, so a group of copies costs a few pairs for each of its texts.
4. Texts of a bucket that are in different components then meet again under the rarest of their shingles, in whose order two similar texts must share one early on. They are
   verified against one text of each such group, and what is still in different components pair by pair, if their weights allow a link. All filters are bounds that lose no link
   of two texts that share a bucket.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components
from .suffix_dedup import sorted_docs

ROWS, BANDS = 3, 14
#: How much more than 1, the weight of a shingle that is in every text, the rarest one weighs. The common shingles of a large group of near copies are frequent by its size alone,
#: so a larger spread parts such groups.
IDF = 0.5
#: Shingles of a bucket of the document-frequency exchange.
BUCKET_SHINGLES = 2_000_000
#: 64-bit words of the parities of a text's shared shingles.
PARITY = 4
PARITIES = [f"d{i}" for i in range(PARITY)]
#: What bounds on sums of weights allow for rounding.
ROUNDING = 1e-5


def shingles(data, offsets, k: int):
    """Distinct shingles of the texts of a piece: text number, 64-bit hash, count, ordered by (text, hash), and the offsets of the texts.

    A text of fewer than k words, but some, has one shingle: all its words.
    """
    starts, lengths, at = C.words(data, offsets)
    h = C.segment_hashes(data, starts, lengths)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    every = C.windows(h, k)
    ok = np.flatnonzero(doc[: len(every)] == doc[k - 1 :]) if len(every) else np.zeros(0, np.int64)
    value, of = every[ok], doc[ok]
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k))
    if len(short):
        value = np.concatenate([value, *(C.windows(h[at[d] : at[d + 1]], int(at[d + 1] - at[d])) for d in short)])
        of = np.concatenate([of, short])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    heads = np.flatnonzero(new)
    return of[heads], value[heads], np.diff(heads, append=len(value)), np.searchsorted(of[heads], np.arange(n + 1))


@lru_cache(maxsize=1)
def _tables():
    """Quantiles of Gamma(2, 1) at 65,536 levels, and their logarithms."""
    grid = np.linspace(0, 30, 3_000_001)
    cdf = 1 - np.exp(-grid) * (1 + grid)
    q = np.interp((np.arange(65536) + 0.5) / 65536, cdf, grid)
    return q.astype(np.float32), np.log(q).astype(np.float32), (1 / q).astype(np.float32)


def samples(value: np.ndarray, weight: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples (as hashes) of each text: texts x k. Texts without shingles get zeros."""
    r_table, lnc_table, inv_table = _tables()
    n = len(at) - 1
    out = np.zeros((n, k), np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    if not len(full):
        return out
    firsts, counts = at[full], np.diff(at)[full]
    x, lnw = C.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.log(weight).astype(np.float32)
    odd = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    which = np.repeat(np.arange(len(full)), counts)
    for i in range(k):
        y = x * odd[i : i + 1]
        r_at = (y >> np.uint64(48)).astype(np.int64)
        r = r_table[r_at]
        beta = ((y >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(lnw * inv_table[r_at] + beta)
        a = lnc_table[((y >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
        hit = np.flatnonzero(a == np.minimum.reduceat(a, firsts)[which])
        w = which[hit]
        first = np.ones(len(hit), bool)
        first[1:] = w[1:] != w[:-1]
        hit = hit[first]
        out[full, i] = C.mix(value[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def idf(df: np.ndarray, n: int, spread: float = IDF) -> np.ndarray:
    """From 1 (in every text) to 1 + spread, by the logarithm of the document frequency."""
    return 1 + spread * np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(n + 1) if n > 0 else np.ones(len(df))


def prefixes(value: np.ndarray, weight: np.ndarray, df: np.ndarray, at: np.ndarray, total: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the shared shingles that come before the share 1 - threshold of its weight, rarest first (by df, then hash), and the offsets of the texts.

    Two texts at the threshold have a shingle in both prefixes: all that comes before the first one they share is lost to their similarity.
    """
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((value, df, of))
    w = weight[order].astype(np.float64)
    before = np.cumsum(w) - w
    if len(w):
        before -= before[np.minimum(at[:-1], len(w) - 1)][of]
    keep = (before <= ((1 - threshold) * (1 + ROUNDING) * total + ROUNDING)[of]) & (df[order] > 1)
    return value[order][keep], np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(at) - 1))])


def similarity(keys_a, weights_a, total_a, keys_b, weights_b, total_b) -> float:
    """Weighted Jaccard of two texts from the weights of shingles that they may share (ascending keys) and their whole weights."""
    if not len(keys_a) or not len(keys_b):
        return 0.0
    i = np.minimum(np.searchsorted(keys_b, keys_a), len(keys_b) - 1)
    same = keys_b[i] == keys_a
    both = float(np.minimum(weights_a[same], weights_b[i[same]]).sum())
    return both / (total_a + total_b - both)


def parities(value: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Parities of the numbers of a text's distinct shingles that fall on each of 64 * PARITY places: n texts x PARITY words.

    A shingle that only one of two texts has changes one place, so the places that differ are never more than such shingles.
    """
    place = C.mix(value ^ np.uint64(0x5DEECE66D))
    out = np.zeros((n, PARITY), np.uint64)
    np.bitwise_xor.at(out, (of, ((place >> np.uint64(6)) % np.uint64(PARITY)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def may_link(threshold: float) -> str:
    """That texts x and y in different components may reach the threshold, as SQL; no link is lost.

    The weight that only one of them has is (1 - t) / (1 + t) of both weights at most. It includes what no other text has, and 1 or more for each
    shared shingle that only one of them has.
    """
    places = " + ".join(f"bit_count(x.{d} ^ y.{d})" for d in PARITIES)
    most = (1 - threshold) / (1 + threshold) * (1 + ROUNDING)
    return f"x.component <> y.component and x.total - x.common + y.total - y.common + {places} <= {most} * (x.total + y.total) + {ROUNDING}"


def sketch(docs: DataFrame, k: int = 5, threshold: float = 0.8, rows: int = ROWS, bands: int = BANDS, spread: float = IDF, slice_bytes: int = 6 << 20) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id without nulls or repeats, text): sketches (doc_id, total, common, bands, prefix, keys, weights) of one document of each group of equal texts, if
    its shared shingles allow a link, and the others (doc_id, same_as)."""
    C.configure(docs.sparkSession)
    bounds, n, size = C.slice_bounds(docs, slice_bytes)
    sliced = C.with_slices(docs, bounds)
    p = max(6, int(size / 6 / BUCKET_SHINGLES).bit_length())
    top, low = np.uint64(64 - p), np.uint64(32 - p)

    hashed = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    heads = C.materialize(hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("same_as"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "equal", False)
    copies = C.materialize(hashed.join(heads, ["h1", "h2"]).filter("doc_id <> same_as").select("doc_id", "same_as"), "copies", False)
    C.discard(heads)
    skipped = copies.select(C.at_position(bounds, F.col("doc_id")).alias("slice"), "doc_id").groupBy("slice").agg(F.collect_list("doc_id").alias("skip"))

    def live(t, skips):
        """The slice's texts that are no copies, in order."""
        skip = [np.asarray(ids, np.int64) for ids in skips if ids]
        t = sorted_docs(t)
        return t.filter(pa.array(~np.isin(t.column("doc_id").to_numpy(), np.concatenate(skip)))) if skip else t

    def slice_shingles(t):
        data, offsets = C.text_bytes(t.column("text"))
        for i, j in C.pieces(offsets, 1 << 20):
            o = offsets[i : j + 1]
            yield i, j, *shingles(data[o[0] : o[-1]], o - o[0], k)

    def distinct(t):
        """The slice's distinct shingles, ascending (to 32 bits beyond the bucket's), and in how many of its documents they are."""
        value = [v for _, _, _, v, _, _ in slice_shingles(t)]
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *value]) >> low, return_counts=True)

    def send(key, t, r):
        u, count = distinct(live(t, r.column("skip").to_pylist()))
        bucket = (u >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(u) else np.zeros(1, np.int64)
        ranges = list(zip(edge[:-1], edge[1:], strict=True))
        low32 = u.astype(np.uint32)
        more = [np.flatnonzero(count[a:z] > 1) for a, z in ranges]
        return pa.table({"bucket": pa.array(bucket[edge[:-1]], pa.int32()), "slice": pa.array(np.full(len(ranges), key[0].as_py()), pa.int32()), "keys": pa.array([low32[a:z].tobytes() for a, z in ranges], pa.binary()), "many": pa.array([np.stack([m, count[a:z][m]]).astype("<u4").tobytes() for m, (a, z) in zip(more, ranges, strict=True)], pa.binary())})

    def answer(key, t):
        blobs = [np.frombuffer(b, np.uint32) for b in t.column("keys").to_pylist()]
        counts = [np.ones(len(b), np.int64) for b in blobs]
        for c, m in zip(counts, t.column("many").to_pylist(), strict=True):
            m = np.frombuffer(m, "<u4").reshape(2, -1)
            c[m[0]] = m[1]
        _, name = np.unique(np.concatenate(blobs), return_inverse=True)
        df = np.bincount(name, weights=np.concatenate(counts)).astype("<u4")[name]
        out = np.split(df, np.cumsum([len(b) for b in blobs])[:-1])
        return pa.table({"slice": t.column("slice"), "bucket": t.column("bucket"), "shared": pa.array([np.packbits(x > 1).tobytes() for x in out], pa.binary()), "df": pa.array([x[x > 1].view(np.uint8).reshape(-1, 4).T.tobytes() for x in out], pa.binary())})

    sent = sliced.groupBy("slice").cogroup(skipped.groupBy("slice")).applyInArrow(send, "bucket int, slice int, keys binary, many binary")
    frequencies = C.materialize(sent.groupBy("bucket").applyInArrow(answer, "slice int, bucket int, shared binary, df binary"), "frequencies")
    replies = frequencies.withColumn("skip", F.lit(None).cast("array<bigint>")).unionByName(skipped.select("slice", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("shared"), F.lit(None).cast("binary").alias("df"), "skip"))
    columns = {"doc_id": pa.int64(), "total": pa.float64(), "common": pa.float64(), "bands": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64()), "keys": pa.binary(), "weights": pa.binary(), **dict.fromkeys(PARITIES, pa.int64())}

    def draw(key, t, r):
        t = live(t, r.column("skip").to_pylist())
        u, _ = distinct(t)
        bucket = (u >> np.uint64(32)).astype(np.int64)
        df = np.ones(len(u), np.int64)
        for b, shared, frequency in zip(*(r.column(c).to_pylist() for c in ("bucket", "shared", "df")), strict=True):
            if b < 0:
                continue
            a, z = np.searchsorted(bucket, [b, b + 1])
            where = a + np.flatnonzero(np.unpackbits(np.frombuffer(shared, np.uint8), count=z - a))
            df[where] = np.frombuffer(frequency, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        ids = t.column("doc_id").to_numpy()
        out: list[list] = [[] for _ in columns]
        for i, j, of, value, count, at in slice_shingles(t):
            f = df[np.searchsorted(u, value >> low)]
            weight = (count * idf(f, n, spread)).astype(np.float32)
            total, common = (np.bincount(of, weights=w, minlength=j - i) for w in (weight.astype(np.float64), np.where(f > 1, weight, 0).astype(np.float64)))
            some = (common >= threshold * (1 - ROUNDING) * total) & (total > 0)
            kept = some[of]
            value, weight, f = value[kept], weight[kept], f[kept]
            at = np.concatenate([[0], np.cumsum(np.diff(at)[some])])
            codes = samples(value, weight, at, rows * bands)
            band = np.stack([C.mix(sum(codes[:, b * rows + q] * np.uint64(2 * q + 3) for q in range(rows)) + np.uint64(b)) for b in range(bands)], axis=1).view(np.int64)
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            parity = parities(value[f > 1], of[f > 1], len(at) - 1)
            first, first_at = prefixes(value, weight, f, at, total[some], threshold)
            for d, row in enumerate(np.flatnonzero(some).tolist()):
                a, z = at[d], at[d + 1]
                shared = f[a:z] > 1
                for column, x in zip(out, (int(ids[i + row]), float(total[row]), float(common[row]), band[d], first[first_at[d] : first_at[d + 1]].view(np.int64), value[a:z][shared].tobytes(), weight[a:z][shared].tobytes(), *map(int, parity[d])), strict=True):
                    column.append(x)
        return pa.table([pa.array(c, x) for c, x in zip(out, columns.values(), strict=True)], names=list(columns))

    sketches = C.materialize(sliced.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(draw, "doc_id long, total double, common double, bands array<bigint>, prefix array<bigint>, keys binary, weights binary, " + ", ".join(f"{d} long" for d in PARITIES)), "sketches")
    C.discard(frequencies)
    return sketches, copies


def verify(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold."""
    s = sketches.select("doc_id", "total", "keys", "weights")
    both = pairs.join(s.toDF("b", "tb", "kb", "wb"), "b").join(s.toDF("a", "ta", "ka", "wa"), "a").select("a", "b", "ta", "ka", "wa", "tb", "kb", "wb")

    def run(batches):
        for batch in batches:
            a, b, ta, ka, wa, tb, kb, wb = (c.to_pylist() for c in batch.columns)
            ok = [similarity(np.frombuffer(ka[i], np.uint64), np.frombuffer(wa[i], np.float32), ta[i], np.frombuffer(kb[i], np.uint64), np.frombuffer(wb[i], np.float32), tb[i]) >= threshold for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(a, ok, strict=True) if y], pa.int64()), pa.array([x for x, y in zip(b, ok, strict=True) if y], pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _unsettled(rows: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """rows (group, doc_id, ...) with their component, of the groups that hold more than one."""
    placed = C.materialize(rows.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "placed", False)
    mixed = placed.groupBy(group).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(group)
    return placed.join(C.materialize(mixed, "mixed", False), group)


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, rows: int = ROWS, bands: int = BANDS, spread: float = IDF) -> DataFrame:
    """Groups documents whose TF-IDF weighted shingle sets have a weighted Jaccard similarity of `threshold` or more.

    Returns one row per distinct doc_id: doc_id, component_id (the least doc_id of its group of linked documents, itself included) and
    kept (whether it is that document). Equal texts are linked, null texts and those without words are not (each is kept); a text of fewer than k words
    is one shingle. spread is that of idf(). Rows that share a doc_id are one document, described by the least of their texts; a null doc_id is returned as null.
    Other columns are ignored.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(C.LEAST_LONG)).alias("doc_id"), "text")
    if docs.groupBy("doc_id").count().filter("count > 1").head(1):
        docs = C.materialize(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "one-row-each")
    sketches, copies = sketch(docs, k, threshold, rows, bands, spread)
    in_bands = sketches.select("doc_id", F.posexplode("bands").alias("band", "code")).select("doc_id", F.xxhash64("band", "code").alias("bucket"))
    heads = C.materialize(in_bands.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "heads", False)
    hits = C.materialize(in_bands.join(heads, "bucket"), "hits")
    # the document that meets most others is the likeliest origin of a group of copies: besides the least, it is compared with its buckets' documents
    scores = C.materialize(hits.groupBy("doc_id").agg(F.sum("n").alias("score")), "scores", False)
    origins = C.materialize(hits.filter("n > 2").join(scores, "doc_id").groupBy("bucket").agg(F.max(F.struct("score", "doc_id")).alias("o")).select("bucket", F.col("o.doc_id").alias("origin")), "origins", False)
    star = hits.select(*_pair("head", "doc_id")).unionByName(hits.join(origins, "bucket").select(*_pair("origin", "doc_id")))
    tried = C.materialize(star.filter("a <> b").distinct(), "pairs", False)
    links = C.materialize(verify(tried, sketches, threshold), "links")

    # what shares a bucket but not a component meets under its prefix
    parts = C.materialize(components(links), "parts", False)
    left = C.materialize(_unsettled(hits.select("bucket", "doc_id"), parts, "bucket").select("doc_id").distinct(), "unsettled", False)
    meeting = sketches.join(left, "doc_id").select("doc_id", "total", "common", *PARITIES, F.explode("prefix").alias("key"))
    meeting = C.materialize(_unsettled(meeting, parts, "key"), "meeting", False)
    allowed = may_link(threshold)
    pivots = C.materialize(meeting.groupBy("key").agg(F.max(F.struct("common", "doc_id", "total", "component", *PARITIES)).alias("p")).select("key", "p.*"), "pivots", False)
    more = pivots.alias("x").join(meeting.alias("y"), F.expr(f"x.key = y.key and {allowed}")).select(*_pair("x.doc_id", "y.doc_id")).distinct()
    more = C.materialize(more.join(tried, ["a", "b"], "left_anti"), "more", False)
    links = C.materialize(links.unionByName(verify(more, sketches, threshold)), "links")
    tried = C.materialize(tried.unionByName(more), "tried", False)
    parts = C.materialize(components(links), "parts", False)
    meeting = C.materialize(_unsettled(meeting.drop("component"), parts, "key"), "meeting", False)
    more = meeting.alias("x").join(meeting.alias("y"), F.expr(f"x.key = y.key and x.doc_id < y.doc_id and {allowed}")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = C.materialize(more.join(tried, ["a", "b"], "left_anti"), "more", False)
    found = C.materialize(verify(more, sketches, threshold), "links")
    if found.head(1):
        parts = C.materialize(components(links.unionByName(found)), "parts", False)

    same = copies.join(parts.withColumnRenamed("node", "same_as"), "same_as", "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "same_as").alias("component"))
    groups = C.materialize(parts.unionByName(same), "groups")
    back = lambda c: F.nullif(c, F.lit(C.LEAST_LONG))
    out = docs.select(F.col("doc_id").alias("node")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return out.select(back(F.col("node")).alias("doc_id"), back(F.col("component")).alias("component_id"), (F.col("component") == F.col("node")).alias("kept"))
