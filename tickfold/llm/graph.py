"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of each batch of edges: fewer edges that connect the same nodes."""
    for part in parts:
        nodes, ends = np.unique(part[["u", "v"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        parent = np.arange(len(nodes))
        for a, b in ends.tolist():
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent[b] != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        child = parent != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[child], "v": nodes[parent[child]]})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of ``edges`` (u, v longs): comp is the smallest node reachable.

    Nodes without an edge to another node don't occur. Every round is written to the shared folder;
    the number of rounds grows with the logarithm of the longest path.
    """
    e = edges.where("u <> v").mapInPandas(_forest, "u long, v long").distinct()
    e, before = written(e), None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())
