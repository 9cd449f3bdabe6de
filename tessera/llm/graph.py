"""Connected components by alternating large and small stars (R. Kiveris et al., 2014), in DataFrame operations; the driver joins a small number of links by itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links that the driver joins at most (16 bytes each). For so few the rounds below take no longer than the start of their tasks, which grows with the number of partitions.
DRIVER_LINKS = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): every u sends its larger (large) or its smaller neighbours to the least of them and itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # both sides are tables read anew, so that a hub's rows can be split between tasks
    near, least = materialize(near, "near", False), materialize(least, "least", False)
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), ascending, and the least node that each of them reaches."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while len(u):
        # the larger of two roots goes below the least one that it is linked with, then all go to their roots
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return node, node[root]


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges (a, b) of integer nodes to (node, component): the least node reachable. Only nodes with an edge to another node are returned."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges", False)
    if now.count() <= DRIVER_LINKS:
        links = now.toArrow()
        found = united(links.column("u").to_numpy(), links.column("v").to_numpy())
        return now.sparkSession.createDataFrame(pa.table([pa.array(x, links.schema.field("u").type) for x in found], ["node", "component"]))
    for _ in range(most_rounds):
        now = materialize(_star(_star(now, True), False), "stars", False)
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"), F.lit(0).alias("up")))
        found = materialize(ends.groupBy("node").agg(F.min("component").alias("component"), F.sum("up").alias("up"), F.min("up").alias("leaf")), "found", False)
        # nothing but stars is left once no node that points to another has a second such node or is pointed to itself
        if not found.filter("up > 1 or up > 0 and leaf = 0").head(1):
            return found.select("node", "component")
    raise RuntimeError("the components did not settle")
