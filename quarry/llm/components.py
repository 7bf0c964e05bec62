"""Connected components of an edge table, by alternating star contraction with durable rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

#: Edge tables up to this many rows (counted; 16 MB) are contracted in one task.
LOCAL_EDGES = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one task: least labels spread along edges and are shortcut until nothing moves."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if pairs:
        u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            step = label.copy()
            for end in (a, b, label[a], label[b]):
                np.minimum.at(step, end, low)
            step = step[step]
            if (step == label).all():
                break
            label = step
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a long, b long) reaches; roots themselves may be absent.

    Each round points every node and its larger neighbours at the least neighbour, then every
    node's smaller neighbours likewise; rounds grow with the logarithm of the longest path. Only
    minima are aggregated, so a hub costs one partial aggregate a task, and its join can be split.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e)
    if e.count() <= LOCAL_EDGES:
        return e.coalesce(1).mapInArrow(_contract, "node long, root long")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct())
        facts = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(facts) == before:
            break
        before = tuple(facts)
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
