"""Joins, aggregates, windows, sorts and set operations (survey 2.9 to 2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import setops, topk, windows

c = F.col


def pair(spark, d):
    """Customers and orders with some null keys on both sides."""
    left = table(spark, d, "customer").select(F.nullif(c("c_custkey"), F.lit(7)).alias("ck"), "c_custkey", "c_name")
    right = table(spark, d, "orders").select("o_orderkey", F.nullif(c("o_custkey"), F.lit(10)).alias("ok"), "o_totalprice")
    return left, right


CTE = "WITH l AS (SELECT NULLIF(c_custkey, 7) AS ck, c_custkey, c_name FROM customer), r AS (SELECT o_orderkey, NULLIF(o_custkey, 10) AS ok, o_totalprice FROM orders) "


@register("join_inner", (140, 141, 147, 148, 149, 154), CTE + "SELECT c_custkey, o_orderkey FROM l JOIN r ON ck = ok")
def join_inner(spark, d):
    left, right = pair(spark, d)
    return J.equi_join(left, right, {"ck": "ok"}).select("c_custkey", "o_orderkey")


@register("join_left_outer", (142,), CTE + "SELECT c_custkey, o_orderkey FROM l LEFT JOIN r ON ck = ok")
def join_left(spark, d):
    left, right = pair(spark, d)
    return J.equi_join(left, right, {"ck": "ok"}, "left").select("c_custkey", "o_orderkey")


@register("join_right_outer", (142,), CTE + "SELECT c_custkey, o_orderkey FROM l RIGHT JOIN r ON ck = ok")
def join_right(spark, d):
    left, right = pair(spark, d)
    return J.equi_join(left, right, {"ck": "ok"}, "right").select("c_custkey", "o_orderkey")


@register("join_full_outer", (142,), CTE + "SELECT c_custkey, o_orderkey FROM l FULL JOIN r ON ck = ok")
def join_full(spark, d):
    left, right = pair(spark, d)
    return J.equi_join(left, right, {"ck": "ok"}, "full").select("c_custkey", "o_orderkey")


@register("join_semi", (143, 155), CTE + "SELECT c_custkey FROM l WHERE EXISTS (SELECT 1 FROM r WHERE ok = ck)")
def join_semi(spark, d):
    left, right = pair(spark, d)
    return J.equi_join(left, right, {"ck": "ok"}, "left_semi").select("c_custkey")


@register("join_anti", (144,), CTE + "SELECT c_custkey FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE ok = ck)")
def join_anti(spark, d):
    left, right = pair(spark, d)
    return J.equi_join(left, right, {"ck": "ok"}, "left_anti").select("c_custkey")


@register("join_residual", (145,), CTE + "SELECT c_custkey, o_orderkey FROM l LEFT JOIN r ON ck = ok AND o_totalprice > 150000 AND o_orderkey % 2 = c_custkey % 2")
def join_residual(spark, d):
    left, right = pair(spark, d)
    rest = (c("o_totalprice") > 150000) & (c("o_orderkey") % 2 == c("c_custkey") % 2)
    return J.equi_join(left, right, {"ck": "ok"}, "left", rest).select("c_custkey", "o_orderkey")


@register("join_last_match", (146,), "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT * FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def join_last_match(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return J.last_match_join(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey", "o_orderkey").select("c_custkey", "o_orderkey")


@register("join_composite_keys", (140, 147), "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1")
def join_composite(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    b = table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), (c("l_linenumber") + 1).alias("n"), "l_quantity")
    return J.equi_join(a, b, {"l_orderkey": "k", "l_linenumber": "n"}).select("l_orderkey", "l_linenumber", "l_quantity")


@register("join_sort_merge", (150, 151), "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON l_orderkey = o_orderkey")
def join_merge(spark, d):
    orders = table(spark, d, "orders").filter("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    return J.equi_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders.hint("merge"), {"l_orderkey": "o_orderkey"}, "left").select("l_orderkey", "l_linenumber", "o_custkey")


@register("join_bloom_prefilter", (152, 153), "SELECT l_orderkey, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def join_bloom(spark, d):
    urgent = table(spark, d, "orders").filter(c("o_orderpriority") == "1-URGENT").select("o_orderkey")
    return J.filtered_join(table(spark, d, "lineitem").select("l_orderkey"), urgent, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("join_approximate_set", (153,), "SELECT l_orderkey, COUNT(*) AS n, true AS few FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def join_approximate_set(spark, d):
    """Lines sifted by an approximate set of urgent orders, then joined exactly; and whether few wrong lines got through."""
    urgent = table(spark, d, "orders").filter(c("o_orderpriority") == "1-URGENT").select("o_orderkey")
    keys, lines = max(1, urgent.count()), table(spark, d, "lineitem").select("l_orderkey")
    kept = J.might_contain(lines, "l_orderkey", J.approximate_set(urgent, "o_orderkey", keys), keys)
    right = J.filtered_join(kept, urgent, "l_orderkey", "o_orderkey")
    wrong = (kept.agg(F.count("*").alias("n")).scalar() - right.agg(F.count("*").alias("n")).scalar()) < 0.05 * lines.agg(F.count("*").alias("n")).scalar()
    return right.groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("few", wrong)


@register("join_skewed", (140, 141), "SELECT s, COUNT(*) AS n, CAST(SUM(n_nationkey) AS BIGINT) AS k FROM (SELECT CAST(IF(l_orderkey % 3 = 0, 0, l_suppkey % 25) AS INT) AS s FROM lineitem) JOIN nation ON s = n_nationkey GROUP BY 1")
def join_skewed(spark, d):
    lines = table(spark, d, "lineitem").select(F.when(c("l_orderkey") % 3 == 0, 0).otherwise(c("l_suppkey") % 25).cast("int").alias("s"))
    return J.salted_join(lines, table(spark, d, "nation"), "s", "n_nationkey", 8).groupBy("s").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("k"))


@register("aggregate_global", (156, 157, 160), "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, COUNT(*) AS n, ROUND(AVG(l_quantity), 8) AS a, CAST(SUM(l_linenumber) FILTER (WHERE l_tax > 0.04) AS BIGINT) AS m FROM lineitem")
def aggregate_global(spark, d):
    return table(spark, d, "lineitem").agg(F.sum("l_linenumber").alias("s"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count("*").alias("n"), F.round(F.avg("l_quantity"), 8).alias("a"), F.sum(F.when(c("l_tax") > 0.04, c("l_linenumber"))).alias("m"))


@register(
    "aggregate_grouped", (161, 162, 163, 164, 165, 166, 167, 168),
    """SELECT o_orderpriority, o_orderstatus, CAST(SUM(o_custkey) AS BIGINT) AS s, COUNT(v) AS nv, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, MIN(c) AS smin, MAX(c) AS smax,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS money FROM (SELECT *, NULLIF(o_custkey % 5, 0) AS v, CAST(o_orderkey AS VARCHAR) AS c FROM orders) GROUP BY 1, 2""",
)
def aggregate_grouped(spark, d):
    rows = table(spark, d, "orders").withColumns({"v": F.nullif(c("o_custkey") % 5, F.lit(0)), "c": c("o_orderkey").cast("string")})
    return rows.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.sum("o_custkey").alias("s"), F.count("v").alias("nv"), F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.min("c").alias("smin"), F.max("c").alias("smax"),
        F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double").alias("money"),
    )


@register("aggregate_distinct", (169,), "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS nd, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS sd, COUNT(DISTINCT o_orderpriority) AS np FROM orders GROUP BY 1")
def aggregate_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("nd"), F.sum_distinct("o_custkey").alias("sd"), F.count_distinct("o_orderpriority").alias("np"))


@register("approx_distinct", (170,), "SELECT l_returnflag, true AS within FROM lineitem GROUP BY 1")
def approx_distinct(spark, d):
    """Mergeable sketches against exact counts, both within 5 %."""
    rows = table(spark, d, "lineitem").withColumn("part", c("l_linenumber") % 3)
    sketches = rows.groupBy("l_returnflag", "part").agg(F.hll_sketch_agg("l_orderkey", 14).alias("s")).groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("e"))
    exact = rows.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n"), F.approx_count_distinct("l_orderkey", 0.01).alias("a"))
    near = (F.abs(c("e") - c("n")) <= 0.05 * c("n")) & (F.abs(c("a") - c("n")) <= 0.05 * c("n"))
    return sketches.join(exact, "l_returnflag").select("l_returnflag", near.alias("within"))


@register("quantiles", (171,), "SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.25), 6) AS q25, ROUND(median(l_extendedprice), 6) AS med, ROUND(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY 1")
def quantiles(spark, d):
    p = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.99)))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.get(p, F.lit(0)), 6).alias("q25"), F.round(F.median("l_extendedprice"), 6).alias("med"), F.round(F.get(p, F.lit(1)), 6).alias("q99"))


@register(
    "group_statistics", (172, 173, 174, 176),
    """SELECT l_returnflag, ROUND(covar_pop(l_quantity, l_extendedprice), 2) AS cp, ROUND(covar_samp(l_quantity, l_extendedprice), 2) AS cs, ROUND(corr(l_quantity, l_extendedprice), 9) AS r,
       ROUND(var_pop(l_quantity), 6) AS vp, ROUND(stddev_pop(l_quantity), 6) AS sp, ROUND(var_samp(l_quantity), 6) AS vs, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem GROUP BY 1""",
)
def group_statistics(spark, d):
    q, p = "l_quantity", "l_extendedprice"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.covar_pop(q, p), 2).alias("cp"), F.round(F.covar_samp(q, p), 2).alias("cs"), F.round(A.correlation(c(q), c(p)), 9).alias("r"), F.round(F.var_pop(q), 6).alias("vp"),
        F.round(F.stddev_pop(q), 6).alias("sp"), F.round(F.var_samp(q), 6).alias("vs"), F.min(q).alias("lo"), F.max(q).alias("hi"),
    )


@register("compensated_sum", (175,), "SELECT l_returnflag, ROUND(fsum(l_extendedprice), 4) AS s FROM lineitem GROUP BY 1")
def compensated_sum(spark, d):
    return A.compensated_sum(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").select("l_returnflag", F.round("sum", 4).alias("s"))


@register("histogram_prefix", (177,), "SELECT b, n, CAST(SUM(n) OVER (ORDER BY b) AS BIGINT) AS inclusive, CAST(COALESCE(SUM(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS exclusive FROM (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS b, COUNT(*) AS n FROM lineitem GROUP BY 1)")
def histogram_prefix(spark, d):
    return A.histogram(table(spark, d, "lineitem"), F.floor(c("l_quantity") / 10)).select("b", "n", "inclusive", "exclusive")


@register("fused_filter_aggregate", (158,), "SELECT COUNT(*) AS n, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_quantity > 30")
def fused(spark, d):
    return table(spark, d, "lineitem").filter(c("l_quantity") > 30).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.sum("l_linenumber").alias("s"))


W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@register(
    "window_ranking", (179, 180, 181, 186),
    "SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS rn, CAST(RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS INT) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS INT) AS dr, CAST(NTILE(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS nt FROM events",
)
def window_ranking(spark, d):
    w, e = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("event_type")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("rn"), F.rank().over(e).alias("rk"), F.dense_rank().over(e).alias("dr"), F.ntile(4).over(w).alias("nt"))


@register("window_navigation", (182, 183, 184, 185), f"SELECT event_id, LAG(value, 2, -1) OVER w AS lg, LEAD(value, 1, -2) OVER w AS ld, FIRST_VALUE(value) OVER p AS fv, LAST_VALUE(value) OVER p AS lv FROM events {W}")
def window_navigation(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.lag("value", 2, -1.0).over(w).alias("lg"), F.lead("value", 1, -2.0).over(w).alias("ld"), F.first("value").over(p).alias("fv"), F.last("value").over(p).alias("lv"))


FRAME = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)"


@register(
    "window_frames", (187, 188, 189),
    f"""SELECT event_id, ROUND(SUM(value) {FRAME}, 6) AS s, ROUND(AVG(value) {FRAME}, 6) AS a, MIN(value) {FRAME} AS lo, MAX(value) {FRAME} AS hi, CAST(COUNT(value) {FRAME} AS DOUBLE) AS n,
       ROUND(COALESCE(VAR_SAMP(value) {FRAME}, 0) * PI(), 4) AS vs, ROUND(VAR_POP(value) {FRAME} * PI(), 4) AS vp, ROUND(COALESCE(STDDEV_SAMP(value) {FRAME}, 0), 4) AS ss, ROUND(STDDEV_POP(value) {FRAME}, 4) AS sp FROM events""",
)
def window_frames(spark, d):
    """Variances are scaled by pi: exact decimals would be rounding ties."""
    made = windows.frame(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 3, 1)
    return made.select("event_id", *[F.round(k, 6).alias(k) for k in ("s", "a")], "lo", "hi", "n", *[F.round(c(k) * F.pi(), 4).alias(k) for k in ("vs", "vp")], *[F.round(k, 4).alias(k) for k in ("ss", "sp")])


@register("sort_multi_key", (190, 191, 192, 193, 194, 195), "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS pos FROM orders")
def sort_multi_key(spark, d):
    """The total order, numbered by range partitions: counts by partition, then ranks within."""
    return topk.numbered(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [c("o_orderpriority").asc(), c("o_totalprice").desc(), c("o_orderkey").asc()], "pos").select("o_orderkey", "pos")


@register("sort_in_row", (196,), "SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY 1")
def sort_in_row(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))


@register("merge_sorted_runs", (197,), "SELECT run, k, ROW_NUMBER() OVER (ORDER BY k, run) AS pos FROM (SELECT 0 AS run, c_custkey AS k FROM customer UNION ALL SELECT 1, s_suppkey FROM supplier)")
def merge_runs(spark, d):
    runs = [table(spark, d, "customer").select(c("c_custkey").alias("k")), table(spark, d, "supplier").select(c("s_suppkey").alias("k"))]
    return topk.merge(runs, "k").select("run", "k", "pos")


@register("top_k", (198,), "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@register("top_k_per_group", (198,), "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k_group(spark, d):
    return topk.per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), c("o_orderkey").asc()], 3).select("o_custkey", "o_orderkey")


@register("argmin", (199,), "SELECT l_suppkey, MIN(l_extendedprice) AS lo, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS at FROM lineitem GROUP BY 1")
def argmin(spark, d):
    best = F.min(F.struct("l_extendedprice", "l_orderkey"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(best.alias("m")).select("l_suppkey", c("m.l_extendedprice").alias("lo"), c("m.l_orderkey").alias("at"))


@register("search_sorted", (200,), "SELECT COUNT(*) FILTER (WHERE o_orderkey < 500) AS lower, COUNT(*) FILTER (WHERE o_orderkey <= 500) AS upper, bool_or(o_orderkey = 500) AS has FROM orders")
def search_sorted(spark, d):
    k = c("o_orderkey")
    return table(spark, d, "orders").agg(F.count_if(k < 500).alias("lower"), F.count_if(k <= 500).alias("upper"), F.bool_or(k == 500).alias("has"))


@register("partition_by_predicate", (201,), "SELECT (l_quantity < 25) AS side, COUNT(*) AS n FROM lineitem GROUP BY 1")
def partition_by_predicate(spark, d):
    return table(spark, d, "lineitem").groupBy((c("l_quantity") < 25).alias("side")).agg(F.count("*").alias("n"))


SETS = {
    "union_all": (202, "UNION ALL"), "union_distinct": (203, "UNION"), "intersect_distinct": (204, "INTERSECT"),
    "intersect_all": (205, "INTERSECT ALL"), "except_distinct": (206, "EXCEPT"), "except_all": (207, "EXCEPT ALL"),
}


def _set_query(name: str, row: int, word: str) -> None:
    @register(f"set_{name}", (row,), f"SELECT o_custkey % 50 AS k FROM orders {word} SELECT CAST(c_custkey % 70 AS BIGINT) AS k FROM customer")
    def run(spark, d) -> DataFrame:
        a = table(spark, d, "orders").select((c("o_custkey") % 50).alias("k"))
        b = table(spark, d, "customer").select((c("c_custkey") % 70).alias("k"))
        return setops.OPERATIONS[name](a, b)


for _name, (_row, _word) in SETS.items():
    _set_query(_name, _row, _word)
