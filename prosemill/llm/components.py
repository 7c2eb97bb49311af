"""Connected components of a graph of links, by alternating large-star and small-star steps on DataFrames.

Every step replaces links by links to the least neighbour; neighbour lists are never gathered, so that a node with many
links is pre-aggregated like any group. Lineage is cut after each round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, durable, tidy


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of a link can reach. No links: an empty table."""
    e = compact(durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()))
    old = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(least, "u")
        e = compact(durable(near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()))
        tidy(e.sparkSession)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == old:
            break
        old = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Indexes of links (i, j) among n nodes that connect what all links connect, with no circle."""
    parent, kept, at = np.arange(n), [], np.arange(len(i))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    while len(at):
        while (parent != parent[parent]).any():
            parent = parent[parent]
        a, b = parent[i[at]], parent[j[at]]
        at, a = at[a != b], a[a != b]
        for k in at[np.unique(a, return_index=True)[1]]:
            x, y = find(int(i[k])), find(int(j[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(k)
    return np.array(kept, np.int64)
