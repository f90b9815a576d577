"""Headline queries of three operators each: filter and sum, group-by, join and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register, table

MONEY = "decimal(18,4)"


@register(
    "q6_filter_sum", (73, 74, 156, 158),
    """SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
       AND l_discount BETWEEN 0.02 AND 0.09 AND l_quantity < 24""",
)
def q6(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(
        (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
        & F.col("l_discount").between(0.02, 0.09) & (F.col("l_quantity") < 24)
    )
    return rows.agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(18,2)")).cast("double").alias("revenue"))


@register(
    "q1_pricing_summary", (157, 161, 162),
    """SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
         ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price,
         ROUND(AVG(l_discount), 8) AS avg_disc, COUNT(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def q1(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_base"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 8).alias("avg_disc"),
        F.count("*").alias("n"),
    )


@register(
    "q3_join_topk", (141, 191, 198),
    """SELECT o_orderkey, o_orderdate, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_shipdate > TIMESTAMP '1996-06-01'
       GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""",
)
def q3(spark, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") > F.lit("1996-06-01").cast("timestamp_ntz"))
    joined = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        joined.groupBy("o_orderkey", "o_orderdate")
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
        .orderBy(F.desc("revenue"), "o_orderkey").limit(10)
    )
