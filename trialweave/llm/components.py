"""Connected components of a large graph, by alternating large and small stars.

Each round hangs every node on the smallest node it can see: first its larger neighbours, then its
smaller ones. The number of rounds grows with the logarithm of the longest chain, not with the size
of a component. Minima are partial aggregates and the only joins are equi-joins with a unique side,
which adaptive execution can split, so one component may hold a third of all nodes.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, releasing, ship


def _fold_batches(batches):
    """Replace each batch of edges by one edge per node to the smallest node it reaches there."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())],
            ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Each node (``node``, long) that has an edge to another, with ``component``: the smallest node
    it can reach. ``edges`` holds two long columns; loops, repeats and nulls are allowed and have
    no effect. No edges give no rows.
    """
    ship(edges.sparkSession)
    a, b = edges.columns[:2]
    now = (edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
           .where("x is not null and y is not null and x <> y")
           .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
           .mapInArrow(_fold_batches, "u long, v long"))
    now = checkpointed(now.distinct())
    seen = _mark(now)
    while seen[0]:
        now = checkpointed(_small_star(_large_star(now)))
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges: equal marks mean that a round changed nothing."""
    with releasing(edges.sparkSession):
        row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                                                 F.lit(0))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    lowest = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    # a node's neighbours above it are the rows where it stands on the right
    up = edges.select(F.col("v").alias("k"), F.col("u").alias("w"))
    return (up.join(lowest, "k", "left")
            .select(F.col("w").alias("u"), F.least(F.coalesce("m", "k"), F.col("k")).alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the smallest of them."""
    lowest = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    hung = (edges.select(F.col("u").alias("k"), F.col("v").alias("w")).join(lowest, "k")
            .where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")))
    return hung.unionByName(lowest.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
