"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under edges ``a - b``; ``label``: roots known so far."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``edges`` (``a, b``, long): the smallest node that links reach.  Self-links are allowed.

    Each round is a few aggregations with partial minima before the shuffle; the edge table is written after it, and only its
    size and checksum come to the driver.  Rounds grow with the logarithm of the longest chain.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # large star: neighbours above a node move to the smallest node around it
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        now = both.where("b > a").join(around, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        now = now.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e"))
        now = stored(now.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
