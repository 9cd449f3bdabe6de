"""Substring dedup by window fingerprints in prefix partitions.

They stand in for prefix-partitioned suffix trees: no tree is built, and no node deeper than the window is found, which the words removed don't depend on.

A suffix starts at every word that has at least `window` words from it to the end of its document.

1. One pass counts the suffixes under every one-word and four-word prefix (hashed to a fixed number of cells). Prefixes are
   then grouped: light one-word prefixes share a group, heavy ones are split by four words, and a cell that is still too
   heavy by the whole window, so that every group fits the memory of a task however common a word or phrase is.
2. Documents are dealt into slices, ranges of doc_id. A slice sends each group the distinct paths (the first `window` words as
   a 64-bit fingerprint, beside the group) of its suffixes: copies within the slice are one path, so a passage that is in a third of all
   documents costs one path a slice.
3. A group sorts its paths into the leaf order of its subtree. An internal node at depth >= window is a run of equal paths;
   all its leaves but the earliest start a repeat. The group answers each slice with one bit a path.
4. Slices meet their answers; overlapping windows unite to the maximal repeats, whose words are removed.

Two different windows are taken for equal only if their 64-bit fingerprints and groups agree. Words and windows are hashed without a linear structure, so that is left to
chance, and as groups grow in number with the corpus it doesn't grow faster than the corpus: about 6e-14 pairs for each suffix. `path_bits=128` makes the paths twice as long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CELLS, FINE = 1024, 64
SECOND = np.uint64(0xD6E8FEB86659FD93)


def _suffixes(data, offsets, window: int):
    """Word starts, lengths, word offsets; window starts (as word numbers) and the hashes of prefixes of 1, 4 and `window` words."""
    starts, lengths, at = C.words(data, offsets)
    h = C.segment_hashes(data, starts, lengths)
    full = C.windows(h, window)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = np.flatnonzero(doc[: len(full)] == doc[window - 1 :]) if len(full) else np.zeros(0, np.int64)
    short = min(4, window)
    return starts, lengths, at, ok, h, h[ok], C.windows(h, short)[ok] if len(ok) else full, full[ok] if len(ok) else full


def _cell(one, four):
    return (one % np.uint64(CELLS)).astype(np.int64) * FINE + (four % np.uint64(FINE)).astype(np.int64)


def prefix_counts(docs: DataFrame, window: int) -> np.ndarray:
    """Suffixes in each of the CELLS * FINE prefix cells, over the whole corpus."""

    def count(batches):
        total = np.zeros(CELLS * FINE, np.int64)
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(0))
            for i, j in C.pieces(offsets):
                o = offsets[i : j + 1]
                *_, one, four, _ = _suffixes(data[o[0] : o[-1]], o - o[0], window)
                total += np.bincount(_cell(one, four), minlength=CELLS * FINE)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["cell", "n"])

    rows = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CELLS * FINE, np.int64)
    out[[r["cell"] for r in rows]] = [r["n"] for r in rows]
    return out


def plan_groups(counts: np.ndarray, group_suffixes: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For every cell its first group and into how many groups the window splits it, and the number of groups."""
    target = max(1, min(group_suffixes, int(counts.sum()) // least))
    first, split = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group, load = 0, 0
    by_word = counts.reshape(CELLS, FINE)
    for word in range(CELLS):
        total = int(by_word[word].sum())
        units = [slice(word * FINE, (word + 1) * FINE)] if total <= target else [slice(word * FINE + i, word * FINE + i + 1) for i in range(FINE)]
        for unit in units:
            n = int(counts[unit].sum())
            if load and load + n > target:
                group, load = group + 1, 0
            first[unit] = group
            if n > target:
                split[unit] = -(-n // target)
                group, load = group + int(split[unit][0]), 0
            else:
                load += n
    return first, split, group + 1


def subtree_repeats(paths: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Of one group's subtree: which leaves hang below a deep internal node without being its earliest leaf."""
    order = np.lexsort((owners, *(paths[:, i] for i in range(paths.shape[1]))))
    ranked = paths[order]
    out = np.zeros(len(paths), bool)
    if len(paths) > 1:
        out[order[1:]] = (ranked[1:] == ranked[:-1]).all(axis=1)
    return out


def sorted_docs(t: pa.Table) -> pa.Table:
    """The order in which earlier is judged: doc_id (null first), then text, so that repeated rows have an order too."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if t.column("doc_id").null_count == 0 else t.append_column("_", pc.is_valid(t.column("doc_id")).cast(pa.int8())).sort_by([("_", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])


def _slice_paths(t: pa.Table, window: int, first, split, wide: bool):
    """Distinct paths of a slice in the order (group, path): their groups, and per piece what the last step needs."""
    data, offsets = C.text_bytes(t.column("text"))
    parts, groups, paths = [], [], []
    for i, j in C.pieces(offsets):
        o = offsets[i : j + 1]
        piece = data[o[0] : o[-1]]
        starts, lengths, at, ok, h, one, four, full = _suffixes(piece, o - o[0], window)
        cell = _cell(one, four)
        groups.append(first[cell] + ((full >> np.uint64(32)) % split[cell].astype(np.uint64)).astype(np.int64))
        paths.append(np.stack([full, C.windows(C.mix(h ^ SECOND), window)[ok]], axis=1) if wide and len(ok) else full.reshape(-1, 1) if not wide else np.zeros((0, 2), np.uint64))
        parts.append((piece, starts, lengths, at, ok))
    width = 2 if wide else 1
    groups = np.concatenate(groups) if groups else np.zeros(0, np.int64)
    paths = np.concatenate(paths) if paths else np.zeros((0, width), np.uint64)
    order = np.lexsort((*(paths[:, i] for i in reversed(range(width))), groups))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        new[1:] = (groups[a] != groups[b]) | (paths[a] != paths[b]).any(axis=1)
    heads = order[new]  # lexsort is stable: the earliest of equal paths
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new) - 1
    return parts, groups[heads], paths[heads], heads, name


def remove_repeats(docs: DataFrame, window: int = 20, slice_bytes: int = 6 << 20, group_suffixes: int = 2_000_000, least_groups: int = 256, path_bits: int = 64) -> DataFrame:
    """Removes each word covered by a window of words that also starts earlier in the corpus.

    Returns doc_id, n_words, n_removed, kept_text: one row for every row of docs. Words are runs of bytes other than
    space and 9 to 13. A null text has no words; a text shorter than the window loses none. Rows of one doc_id (repeated
    rows) are ordered by their text, so all but the first of equal rows lose their windows; a null doc_id comes before all.
    Other columns of docs are ignored, whatever their names.
    """
    return _repeats(docs.select("doc_id", "text"), True, window, slice_bytes, group_suffixes, least_groups, path_bits).select(F.col("c0").alias("doc_id"), "n_words", "n_removed", F.coalesce("kept", F.lit("")).alias("kept_text"))


def rewrite_repeats(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """docs (doc_id, text, any other columns) with remove_repeats() applied to text where it removes words, and how many it removes in a last column, n_removed or a free name like it.

    Rows take their other columns along to where their texts are rewritten, so nothing is joined.
    """
    last = C.free_name(docs, "n_removed")
    rows = _repeats(docs, False, window, **options)
    return rows.select(*[(F.col("kept") if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)], F.col("n_removed").alias(last))


def _repeats(docs: DataFrame, anew: bool, window: int = 20, slice_bytes: int = 6 << 20, group_suffixes: int = 2_000_000, least_groups: int = 256, path_bits: int = 64) -> DataFrame:
    """c0, c1 .. (the columns of docs but text, by their places), n_words, n_removed and kept: the text, put together anew from its kept words if `anew` or where it loses some."""
    spark = docs.sparkSession
    C.configure(spark)
    wide = path_bits > 64
    key = C.free_name(docs, "row_key")
    keyed = C.row_keys(docs, key)
    others = {f"c{i}": c for i, c in enumerate(docs.columns) if c != "text"}
    docs = keyed.select(F.col(key).alias("doc_id"), "text", *[F.col(c).alias(i) for i, c in others.items()])
    kinds = dict(docs.dtypes)
    first, split, n_groups = plan_groups(prefix_counts(docs, window), group_suffixes, least_groups)
    bounds = C.slice_bounds(docs, slice_bytes)[0]
    sliced = docs.withColumn("slice", C.at_position(bounds, F.col("doc_id")))

    def send(key, t):
        _, groups, paths, _, _ = _slice_paths(sorted_docs(t), window, first, split, wide)
        edges = np.flatnonzero(np.diff(groups, prepend=-1, append=-1)) if len(groups) else np.zeros(1, np.int64)
        used = groups[edges[:-1]]
        return pa.table({"grp": pa.array(used, pa.int32()), "slice": pa.array(np.full(len(used), key[0].as_py()), pa.int32()), "paths": pa.array([paths[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    def answer(key, t):
        blobs = t.column("paths").to_pylist()
        of = t.column("slice").to_numpy()
        sizes = np.array([len(b) // (16 if wide else 8) for b in blobs])
        paths = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2 if wide else 1)
        repeat = subtree_repeats(paths, np.repeat(of, sizes))
        ends = np.cumsum(sizes)
        return pa.table({"slice": pa.array(of, pa.int32()), "grp": pa.array(np.full(len(of), key[0].as_py()), pa.int32()), "bits": pa.array([np.packbits(repeat[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    answers = C.materialize(sliced.select("doc_id", "text", "slice").groupBy("slice").applyInArrow(send, "grp int, slice int, paths binary").groupBy("grp").applyInArrow(answer, "slice int, grp int, bits binary"), "repeats")

    def remove(key, t, replies):
        t = sorted_docs(t)
        parts, groups, _, heads, name = _slice_paths(t, window, first, split, wide)
        repeated = np.zeros(len(groups), bool)
        for g, bits in zip(replies.column("grp").to_numpy(), replies.column("bits").to_pylist(), strict=True):
            a, b = np.searchsorted(groups, [g, g + 1])
            repeated[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        bad = repeated[name] | (heads[name] != np.arange(len(name)))
        n_words, n_removed, kept, done = [], [], [], 0
        for data, starts, lengths, at, ok in parts:
            hit = ok[bad[done : done + len(ok)]]
            done += len(ok)
            edge = np.zeros(len(starts) + 1, np.int64)
            edge[hit] += 1  # window starts are distinct
            edge[hit + window] -= 1
            keep = np.cumsum(edge[:-1]) == 0
            count = np.concatenate([[0], np.cumsum(keep)])
            lost = np.diff(at) - np.diff(count[at])
            written = np.ones(len(lost), bool) if anew else lost > 0
            mine = keep & np.repeat(written, np.diff(at))
            place = np.concatenate([[0], np.cumsum(mine)])[at]
            s, n = starts[mine], lengths[mine] + 1
            first_byte = np.concatenate([[0], np.cumsum(n)])
            out = data[np.minimum(np.repeat(s - first_byte[:-1], n) + np.arange(first_byte[-1]), max(len(data) - 1, 0))] if len(s) else np.zeros(0, np.uint8)
            out[first_byte[1:] - 1] = 32
            cuts = first_byte[place]
            for a, b, w in zip(cuts[:-1], cuts[1:], written, strict=True):
                kept.append(out[a : max(a, b - 1)].tobytes().decode() if w else None)
            n_words.append(np.diff(at))
            n_removed.append(lost)
        n_words, n_removed = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (n_words, n_removed))
        rewritten = pc.if_else(pa.array(n_removed > 0) if not anew else pa.array(np.ones(len(kept), bool)), pa.array(kept, pa.string()), t.column("text").cast(pa.string()))
        return pa.table({c: t.column(c) for c in others} | {"n_words": n_words, "n_removed": n_removed, "kept": rewritten})

    schema = "".join(f"{c} {kinds[c]}, " for c in others) + "n_words long, n_removed long, kept string"
    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(remove, schema)
