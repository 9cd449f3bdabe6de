"""Near-duplicate embeddings by NN-descent (W. Dong, M. Charikar, K. Li, 2011).

1. Equal vectors are one node. Random hyperplanes deal nodes into cells in several trees; blocks of a cell's nodes (bounded, in the order of a
   projection) give each node its first neighbours.
2. Every round, each node's neighbours and the nodes that have it as a neighbour are compared with each other (the neighbours-of-neighbours join), and each keeps
   its best.
3. A list is saturated if even its last neighbour reaches the threshold. Such a node's list is enlarged to its whole component of threshold edges:
   the component is cut into blocks, and pairs of blocks are compared in double precision, which counts links without making pairs.
4. A bounded set of queries, drawn by the number of their links, is compared with all vectors; while those of any number find too small a share of their
   links, another round is made. If that doesn't help, all nodes are compared in blocks, so that every link counts.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .graph import components

NEIGHBOURS, TREES, CELL, BLOCK = 12, 8, 256, 512
QUERIES, LEAST_RECALL, MOST_ROUNDS = 200, 0.97, 4
#: The probability with which vectors at the threshold share a cell of some tree, and the trees made for it at most (rounds and the audit see to the rest).
COVERAGE, MOST_TREES = 0.99, 64
#: Nodes of a block where all are compared, and rows of it multiplied at once.
EXACT_BLOCK, EXACT_ROWS = 4096, 512
#: Single precision may be off by this much in a cosine; candidates within it are verified in double precision.
SLACK = 1e-4


_log = logging.getLogger(__name__)


def trees_for(bits: int, threshold: float, least: int = TREES) -> int:
    """Trees of `bits` hyperplanes so that two vectors at the threshold share a cell of one with probability COVERAGE."""
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    if same >= COVERAGE:
        return least
    return max(least, int(min(MOST_TREES, np.ceil(np.log1p(-COVERAGE) / np.log1p(-same))))) if same > 0 else max(least, MOST_TREES)


def _blobs(column, dtype) -> np.ndarray:
    """Equally long binary values as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.zeros((0, 0), dtype)


def unit_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, dim, unit): rows with a direction, as 64-bit unit vectors. Null, zero, empty vectors and those with null or non-finite components have none."""

    def run(batches):
        for batch in batches:
            ids, dims, units = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not x or None in x:
                    continue
                v = np.array(x, np.float64)
                if not np.isfinite(v).all() or not v.any():
                    continue
                v = v / np.abs(v).max()
                ids.append(i)
                dims.append(len(v))
                units.append((v / np.sqrt(v @ v) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["id", "dim", "unit"])

    return vectors.select(F.col(key).cast("long"), column).mapInArrow(run, "id long, dim int, unit binary")


def _best(x: np.ndarray, ids: np.ndarray, k: int, threshold: float):
    """For all rows of x, their k nearest others, and of those at the threshold or above the one with the least id: (id, other, cosine)."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    n, m = len(x), min(k, len(x) - 1)
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
    a, b = np.repeat(np.arange(n), m), near.ravel()
    least = np.where(s >= threshold, ids[None, :], np.iinfo(np.int64).max).argmin(axis=1)
    more = np.flatnonzero(s[np.arange(n), least] >= threshold)
    a, b = np.concatenate([a, more]), np.concatenate([b, least[more]])
    return ids[a], ids[b], s[a, b].astype(np.float32)


def _grouped_blocks(batches, key_columns: int, most: int):
    """Consecutive rows with equal first columns, in blocks of `most` rows: (ids, float32 matrix) from the columns id and unit that follow."""
    held: list = []
    now = None

    def block():
        return np.array([h[0] for h in held], np.int64), np.frombuffer(b"".join(h[1] for h in held), np.float32).reshape(len(held), -1)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[:key_columns] != now or len(held) >= most):
                yield block()
                held = []
            now = row[:key_columns]
            held.append(row[key_columns : key_columns + 2])
    if held:
        yield block()


def _compare(batches, key_columns: int, most: int, k: int, threshold: float):
    for ids, x in _grouped_blocks(batches, key_columns, most):
        a, b, s = _best(x, ids, k, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s, pa.float32())], ["a", "b", "s"])


def _top(candidates: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    return candidates.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)


def link_vectors(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", column: str = "embedding", k: int = NEIGHBOURS, trees: int = TREES, seed: int = 3) -> DataFrame:
    """Links vectors whose cosine is `threshold` or more.

    Returns one row per distinct key: the key, n_links (vectors linked directly), component_id (the least key reachable by links, itself
    included) and kept (whether it is that key). Vectors without a direction (null, zero, empty, with null or non-finite components) and of different lengths link
    with nothing. Of rows that share a key, the least unit vector counts; a null key is returned as null with no links.
    """
    spark = vectors.sparkSession
    C.configure(spark)
    units = unit_vectors(vectors.filter(F.col(key).isNotNull()), key, column).groupBy("id").agg(F.min(F.struct("dim", "unit")).alias("u")).select("id", "u.*")
    members = C.materialize(units.withColumn("h", F.xxhash64("unit")), "units", False)
    heads = members.groupBy("h", "unit").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = C.materialize(heads.select("node", "copies", "unit"), "nodes", False)
    equal = nodes.filter("copies > 1").select("node", "unit")
    equal = C.materialize(members.join(equal, "unit").select("id", "node"), "equal", False) if equal.head(1) else spark.createDataFrame([], "id long, node long")
    n = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / CELL)))))
    trees = trees_for(bits, threshold, trees)

    def deal(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in _by_size(batch.column(1)):
                if dim not in planes:
                    planes[dim] = np.random.Generator(np.random.PCG64([seed, dim])).normal(size=(dim, trees * (bits + 1)))
                x = _blobs(batch.column(1).take(pa.array(rows)), np.float64)
                p = (x @ planes[dim]).reshape(len(x), trees, bits + 1)
                code = ((p[:, :, :bits] > 0) << np.arange(bits)).sum(axis=2) if bits else np.zeros((len(x), trees), np.int64)
                single = [v.astype(np.float32).tobytes() for v in x]
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim), pa.int32()), pa.array(np.full(len(x), t), pa.int32()), pa.array(code[:, t].astype(np.int64)), pa.array(p[:, t, bits]), batch.column(0).take(pa.array(rows)), pa.array(single, pa.binary())], ["dim", "tree", "code", "place", "id", "unit"])

    parts = max(32, spark.sparkContext.defaultParallelism * 2)
    cells = nodes.select("node", "unit").mapInArrow(deal, "dim int, tree int, code long, place double, id long, unit binary")
    cells = cells.repartitionByRange(parts, "dim", "tree", "code", "place").sortWithinPartitions("dim", "tree", "code", "place").select("dim", "tree", "code", "id", "unit")
    found = C.materialize(cells.mapInArrow(lambda b: _compare(b, 3, BLOCK, k, threshold), "a long, b long, s float"), "cells")
    links = C.materialize(found.filter(F.col("s") >= threshold - SLACK).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cell-links", False)
    graph = C.materialize(_top(found, k), "graph")
    single = nodes.select(F.col("node").alias("id"), "unit")

    for round_ in range(MOST_ROUNDS):
        near = graph.select(F.col("a").alias("hub"), F.col("b").alias("id")).unionByName(graph.select(F.col("b").alias("hub"), F.col("a").alias("id"))).distinct()
        joined = C.materialize(near, "near", False).join(single, "id").select("hub", "id", "unit").repartition(parts, "hub").sortWithinPartitions("hub", F.xxhash64("id", F.lit(round_))).select("hub", "id", "unit")

        found = C.materialize(joined.mapInArrow(lambda b: _compare(_to_single(b), 1, BLOCK, k, threshold), "a long, b long, s float").groupBy("a", "b").agg(F.max("s").alias("s")), "round")
        links = C.materialize(links.unionByName(found.filter(F.col("s") >= threshold - SLACK).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct(), "links", False)
        graph = C.materialize(_top(graph.select("a", "b", "s").unionByName(found), k), "graph")
        result = C.materialize(_count(nodes, graph, links, threshold, k), "counts")
        if audit_recall(nodes, result, threshold) >= LEAST_RECALL:
            break
    else:
        _log.warning("too few links found after %d rounds: all %d vectors are compared", MOST_ROUNDS, n)
        result = C.materialize(compare_all(nodes, n, threshold), "counts")

    ids = vectors.select(F.col(key).alias("id")).distinct()
    base = members.select("id").join(equal, "id", "left").select("id", F.coalesce("node", "id").alias("node"))
    least = base.join(result, "node").select("id", "links", "component")
    return ids.join(least, "id", "left").select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce("component", "id").eqNullSafe(F.col("id")).alias("kept"))


def _by_size(column):
    sizes = np.array([len(x) // 8 for x in column.to_pylist()])
    for dim in np.unique(sizes).tolist():
        yield dim, np.flatnonzero(sizes == dim)


def _to_single(batches):
    """Batches (hub, id, unit) with the 64-bit units as 32-bit ones; a hub's neighbours all have its dimension."""
    for batch in batches:
        units = [np.frombuffer(u, np.float64).astype(np.float32).tobytes() for u in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], ["hub", "id", "unit"])


def _count(nodes: DataFrame, graph: DataFrame, links: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node, links, component): verified links of every node, copies counted, and its component."""
    units = nodes.select("node", "unit", "copies")
    both = links.join(units.toDF("a", "ua", "ca"), "a").join(units.toDF("b", "ub", "cb"), "b").select("a", "b", "ua", "ub", "ca", "cb")

    def check(batches):
        for batch in batches:
            rows = np.array([len(x) == len(y) and float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], bool)
            keep = pa.array(np.flatnonzero(rows))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in (0, 1, 4, 5)], ["a", "b", "ca", "cb"])

    edges = C.materialize(both.mapInArrow(check, "a long, b long, ca long, cb long"), "edges", False)
    parts = C.materialize(components(edges.select("a", "b")), "parts", False)
    saturated = graph.filter((F.col("r") == k) & (F.col("s") >= threshold - SLACK)).select(F.col("a").alias("node"))
    full = C.materialize(parts.join(saturated, "node").select("component").distinct(), "full", False)
    sizes = parts.join(full, "component").groupBy("component").agg(F.count(F.lit(1)).alias("size")).select("component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    inside = parts.join(C.materialize(sizes, "sizes", False), "component").join(units, "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = inside.select("component", "node", "unit", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "unit", "copies")

    def block_pair(key, t):
        i, j = key[1].as_py(), key[2].as_py()
        x, of = _blobs(t.column("unit"), np.float64), t.column("block").to_numpy()
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        a, b = np.flatnonzero(of == i), np.flatnonzero(of == j)
        near = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            return pa.table({"node": node[a], "n": (near @ copies[b]).astype(np.int64)})
        return pa.table({"node": np.concatenate([node[a], node[b]]), "n": np.concatenate([near @ copies[b], near.T @ copies[a]]).astype(np.int64)})

    blocks = dealt.groupBy("component", "i", "j").applyInArrow(block_pair, "node long, n long")
    listed = edges.select(F.col("a").alias("node"), F.col("cb").alias("n")).unionByName(edges.select(F.col("b").alias("node"), F.col("ca").alias("n")))
    listed = listed.join(parts.join(full, "component", "left_semi").select("node"), "node", "left_anti")
    counts = blocks.unionByName(listed).groupBy("node").agg(F.sum("n").alias("n"))
    return nodes.select("node", "copies").join(parts, "node", "left").join(counts, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (place, place) that connect what the matrix `near` connects; places of columns follow those of rows."""
    rows, columns = near.any(axis=1), near.any(axis=0)
    edges = []
    for root in np.flatnonzero(rows).tolist():
        if not rows[root]:
            continue
        rows[root], now = False, np.array([root])
        while len(now):
            new = np.flatnonzero(near[now].any(axis=0) & columns)
            columns[new] = False
            edges += [(root, len(near) + c) for c in new.tolist()]
            now = np.flatnonzero(near[:, new].any(axis=1) & rows)
            rows[now] = False
            edges += [(root, r) for r in now.tolist()]
    return edges


def compare_all(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, links, component) as _count() has them, by comparison of all nodes in blocks; a pair of blocks returns counts and a spanning forest, not its links."""
    blocks = max(1, -(-n // EXACT_BLOCK))
    block = nodes.select("node", "copies", "unit", F.pmod(F.xxhash64("node", F.lit("all")), F.lit(blocks)).cast("int").alias("block"), F.octet_length("unit").alias("size"))
    dealt = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "unit", "copies")

    def block_pair(key, t):
        i, j = key[1].as_py(), key[2].as_py()
        x, of = _blobs(t.column("unit"), np.float64), t.column("block").to_numpy()
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        a, b = np.flatnonzero(of == i), np.flatnonzero(of == j)
        count, pairs = np.zeros(len(node), np.int64), []
        for at in range(0, len(a), EXACT_ROWS):
            part = a[at : at + EXACT_ROWS]
            near = (x[part] @ x[b].T >= threshold) & (node[part][:, None] != node[b][None, :])
            if not near.any():
                continue
            count[part] += near @ copies[b]
            if i != j:
                count[b] += near.T @ copies[part]
            place = np.concatenate([part, b])
            pairs += [(place[u], place[v]) for u, v in _forest(near)]
        linked = np.flatnonzero(count)
        u, v = (np.array([p[c] for p in pairs], np.int64) for c in (0, 1))
        blank = pa.nulls(len(linked), pa.int64())
        counted = pa.table({"node": node[linked], "n": pa.array(count[linked]), "b": blank})
        return pa.concat_tables([counted, pa.table({"node": node[u], "n": pa.nulls(len(u), pa.int64()), "b": node[v]})])

    found = C.materialize(dealt.groupBy("size", "i", "j").applyInArrow(block_pair, "node long, n long, b long"), "all-links")
    parts = components(found.filter("b is not null").select(F.col("node").alias("a"), "b"))
    counts = found.filter("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    return nodes.select("node", "copies").join(parts, "node", "left").join(counts, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))


def audit_by_size(nodes: DataFrame, result: DataFrame, threshold: float, queries: int = QUERIES, k: int = NEIGHBOURS) -> dict[str, tuple[int, float]]:
    """Queries and mean share of a query's links that was found, by the number of its true links: "1", "2 .. k" and "more"; for those without a query there is no entry.

    A bounded set of nodes is compared with all. Half of them are drawn from all nodes, which finds links that were lost altogether; the others evenly from nodes
    with one link, with up to k and with more, so that a large group doesn't stand for pairs. Links to copies of the query's own vector are left out.
    """
    order = F.xxhash64("node", F.lit("audit"))
    drawn = nodes.orderBy(order).limit(queries // 2).select("node", "unit")
    n_found = F.col("links") - F.col("copies") + 1
    linked = nodes.join(result.select("node", "links"), "node").withColumn("n_found", n_found)
    for few in ("n_found = 1", f"n_found between 2 and {k}", f"n_found > {k}"):
        drawn = drawn.unionByName(linked.filter(few).orderBy(order).limit(queries // 6).select("node", "unit"))
    asked = {r["node"]: r["unit"] for r in drawn.collect()}
    if not asked:
        return {}
    shared = nodes.sparkSession.sparkContext.broadcast(asked)

    def count(batches):
        q = shared.value
        ids = np.array(list(q), np.int64)
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for dim, rows in _by_size(batch.column(1)):
                mine = np.array([i for i, u in enumerate(q.values()) if len(u) == 8 * dim], np.int64)
                if not len(mine):
                    continue
                x = _blobs(batch.column(1).take(pa.array(rows)), np.float64)
                y = np.stack([np.frombuffer(q[int(i)], np.float64) for i in ids[mine]])
                copies, node = batch.column(2).to_numpy()[rows], batch.column(0).to_numpy()[rows]
                near = (y @ x.T >= threshold) & (ids[mine][:, None] != node[None, :])
                total[mine] += near @ copies
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "n"])

    truth = nodes.select("node", "unit", "copies").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    share = F.least(n_found, F.col("n")) / F.col("n")
    sizes = F.when(F.col("n") == 1, "1").when(F.col("n") <= k, f"2 .. {k}").otherwise("more")
    rows = truth.filter("n > 0").join(result, "node").join(nodes.select("node", "copies"), "node").groupBy(sizes.alias("size")).agg(F.count(F.lit(1)).alias("queries"), F.avg(share).alias("recall"))
    return {r["size"]: (r["queries"], r["recall"]) for r in rows.collect()}


def audit_recall(nodes: DataFrame, result: DataFrame, threshold: float, queries: int = QUERIES) -> float:
    """The least of the recalls of audit_by_size(), 1 if no query has links."""
    found = audit_by_size(nodes, result, threshold, queries)
    _log.info("recall by number of links (queries, recall): %s", found)
    return min((recall for _, recall in found.values()), default=1.0)
