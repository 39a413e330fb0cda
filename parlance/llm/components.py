"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import shared


def _forest(batches):
    """Replaces a partition's edges by a star for each of its local components; the components stay the same."""
    import numpy as np
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        fresh = label.copy()
        np.minimum.at(fresh, label[u], low)
        np.minimum.at(fresh, label[v], low)
        while not np.array_equal(up := fresh[fresh], fresh):
            fresh = up
        if np.array_equal(fresh, label):
            break
        label = fresh
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    for s in range(0, len(rest), 1 << 18):
        part = rest[s : s + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[label[part]])], names=["u", "v"])


def components(edges: DataFrame, scratch: shared.Scratch | None = None) -> DataFrame:
    """(u long, v long) edges, any order and repeats, to (node, component): each node's smallest reachable node.

    Nodes without an edge to another node don't appear. Rounds go on until no edge changes (their number is about the
    logarithm of the longest path); every round is written to the shared folder. First each partition contracts
    its own edges, so a hub's edges shrink to one star for each partition before any shuffle. With a scratch the result
    must be used before that is cleared.
    """
    table = scratch.table if scratch else shared.table
    norm = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()  # noqa: E731  of different edges
    now = table(norm.mapInArrow(shared.tidy(_forest), "u long, v long").distinct(), "edges")
    was = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # Large star: every larger neighbour of u goes to the smallest one around u.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = table(small.where("u != v").distinct(), "edges")
        before, was = was, mark(now)
        if before == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
