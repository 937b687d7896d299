"""Connected components by alternating large-star and small-star rounds.

Every round is two shuffles of the edges that are left; lineage is cut by a
written table after each.  Nodes are 64-bit integers, a component is named by
its smallest node.  Within a task, edges first collapse onto local roots, so
what moves is at most one edge for each node and task.  Minima are taken with partial
aggregation, and a hub with most of the edges is one row on the small side of a join, whose
other side adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stage


def collapse(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of these edges' nodes, by minimum labels and pointer jumps."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        node, root = collapse(x["a"].to_numpy(), x["b"].to_numpy())
        keep = node != root
        yield pd.DataFrame({"a": node[keep], "b": root[keep]})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; edges: two integer columns, loops and repeats allowed."""
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).filter("a <> b")
    edges = stage(edges.mapInPandas(_local, "a long, b long").distinct(), "edges")
    before = None
    while True:  # every round that changes anything lowers a neighbour, so it ends
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # large star: each neighbour above a node is tied to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its lower neighbours are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(edges)
        edges = after
    nodes = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
