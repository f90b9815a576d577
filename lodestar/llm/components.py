"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of edges (node, smallest node) for each component of a few edges in memory."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node with an edge but the component's smallest.

    edges: u, v bigint, in any direction, repeats allowed. A node's neighbours
    are never gathered: each star is a partial minimum and a join, whose skewed
    keys Spark splits. Lineage is cut after each round.
    """
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, before = checkpoint(low), None
    while True:
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said[0] == 0 or said == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = said
        # large star: each node links its larger neighbours to the smallest it knows
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        links = large.join(least, F.col("u") == F.col("k"))
        small = links.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        now = checkpoint(small.distinct())
