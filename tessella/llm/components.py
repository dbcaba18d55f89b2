"""Connected components of a graph in a DataFrame, by contraction: no part of it is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, checkpointed

#: Edges that one task finishes at most; a larger graph is contracted until it has no more.
TASK_EDGES = 500_000


def _within_a_task(edges: DataFrame) -> DataFrame:
    """(node, component) of at most TASK_EDGES edges, in one task and without further rounds."""
    arrow_batches(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        up, one, other = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
        while (apart := up[one] != up[other]).any():
            x, y = up[one[apart]], up[other[apart]]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while (up != up[up]).any():
                up = up[up]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[up], pa.int64())], names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the least node that is reachable.

    Each round every node takes its least neighbour, or itself, as parent and its parent's parent as label; the edges move to the
    labels, and those within one label go. A path of nodes shrinks by half at least, so the rounds grow
    as the logarithm of the longest path. Each round ends in a checkpoint. When at most TASK_EDGES edges are left, one task does what
    is left, so that a small graph costs the driver few jobs. An empty graph has no components.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        last = edges.count() <= TASK_EDGES
        if last:
            step = checkpointed(_within_a_task(edges))
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            parents = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("parent"))
            grand = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            step = checkpointed(parents.join(grand, "parent").select("node", F.col("grand").alias("component")))
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("component"), F.col("component").alias("new"))
            labels = checkpointed(labels.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component")))
        if last:
            return labels
        to = lambda c: step.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}"))
        edges = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).where("a <> b").distinct()
        edges = checkpointed(edges)
