"""Orders, ranks and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group before the exchange."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def merge(runs: list[DataFrame], key: str) -> DataFrame:
    """Sorted runs merged: their rows with run and pos, the place in the merged order; ties by run."""
    tagged = [r.select(F.lit(i).alias("run"), key) for i, r in enumerate(runs)]
    return numbered(reduce(DataFrame.unionAll, tagged), [F.col(key).asc(), F.col("run").asc()], "pos")


def numbered(df: DataFrame, order: list[Column], to: str, parts: int | None = None) -> DataFrame:
    """Adds each row's place in the total order, from 1.

    Range partitions are ranked apart and offset by the sizes of those before;
    only one count a partition meets in one task. By default there are as many
    partitions as the session has for shuffles.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))  # else the sampled bounds may differ between uses
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_rank", rank).join(sizes, F.col("_part") == F.col("_p")).withColumn(to, F.col("_base") + F.col("_rank")).drop("_part", "_p", "_n", "_base", "_rank")
