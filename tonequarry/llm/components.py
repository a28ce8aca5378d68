"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import written


def local_roots(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest index that it reaches."""
    n = len(adjacent)
    root = np.arange(n)
    own = adjacent | np.eye(n, dtype=bool)
    while True:
        new = np.where(own, root[None, :], n).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def roots_of(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """As ``local_roots``, of pairs in both directions that are sorted by ``i``: work follows the pairs."""
    root = np.arange(n)
    if not len(i):
        return root
    start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    own = i[start]
    while True:
        new = root.copy()
        new[own] = np.minimum(root[own], np.minimum.reduceat(root[j], start))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link to another; component is the smallest node reached.

    ``edges`` has long columns a and b in any direction; nulls, loops and repeats do nothing;
    an empty input gives an empty result. Each round writes its edges to the shared folder.
    No node's links are gathered: joins on a hub's id are plain equi-joins that AQE can split.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
