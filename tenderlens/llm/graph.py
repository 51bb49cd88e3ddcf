"""Connected components of a graph of any size: large star and small star, in turns.

Each round links every node to the smallest node it knows of; a few rounds
reach a forest of depth one.  Minima are taken with partial aggregation, written
to the shared folder, and met again in plain joins that Spark can split, so a
hub of any size is no hot task.  Each round is written too, which cuts the
lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.storage import stored


def _print_of(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal when nothing has changed."""
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    ).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node with an edge; ``edges`` has long columns a and b; root is the smallest node."""
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = stored(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0", edges.count()
    )
    before, step = None, 0
    while (found := _print_of(now)) != before:
        before, step = found, step + 1
        n = found[0]  # no round has more edges than the one before; a node is at the end of one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stored(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{step}-large", 2 * n
        )
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}-small", 2 * n)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}", 2 * n)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index of each node's component, for a graph that fits in a task."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        hooked = root.copy()
        np.minimum.at(hooked, root[a], low)
        np.minimum.at(hooked, root[b], low)
        while True:
            jumped = hooked[hooked]
            if np.array_equal(jumped, hooked):
                break
            hooked = jumped
        if np.array_equal(hooked, root):
            break
        root = hooked
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
