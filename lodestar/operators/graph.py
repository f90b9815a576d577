"""Edge tables: compressed sparse rows and expansion by hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import numbered


def offsets(edges: DataFrame, src: str) -> DataFrame:
    """(src, degree, first): each source's number of edges and where they begin when edges are sorted by source.

    Degrees are partial counts; their running sums are taken by range partitions.
    """
    from pyspark.sql import Window

    degrees = edges.groupBy(src).agg(F.count("*").alias("degree"))
    ranked = numbered(degrees, [F.col(src).asc()], "place")
    block = F.floor((F.col("place") - 1) / 4096)
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("block", block)
    blocks = ranked.groupBy(F.col("block").alias("b")).agg(F.sum("degree").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = ranked.withColumn("run", F.coalesce(F.sum("degree").over(inside), F.lit(0))).join(blocks, F.col("block") == F.col("b"))
    return placed.select(src, "degree", (F.col("base") + F.col("run")).alias("first"))


def expand(sources: DataFrame, edges: DataFrame, key: str, src: str, dst: str, label: Column | None = None) -> DataFrame:
    """Edges of the sources, a row for each source row and edge; only edges with the label, if one is given."""
    kept = edges if label is None else edges.filter(label)
    return sources.join(kept, F.col(key) == F.col(src))


def hops(sources: DataFrame, edges: DataFrame, key: str, src: str, dst: str, n: int) -> DataFrame:
    """(node, hop): nodes first reached in 1..n hops; the frontier is distinct at each hop."""
    reached = sources.select(F.col(key).alias("node"), F.lit(0).alias("hop")).distinct()
    frontier = reached
    for hop in range(1, n + 1):
        ahead = frontier.join(edges, F.col("node") == F.col(src)).select(F.col(dst).alias("to")).distinct()
        frontier = ahead.join(reached, F.col("to") == F.col("node"), "left_anti").select(F.col("to").alias("node"), F.lit(hop).alias("hop"))
        reached = reached.unionAll(frontier)
    return reached.filter("hop > 0")
