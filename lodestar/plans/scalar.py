"""Filters, projections, numbers, decimals, strings and dates (survey 2.5 to 2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions import numeric as N
from ..functions import strings as S
from ..functions import temporal as D
from ..operators.topk import numbered

c = F.col


def line(spark, d) -> DataFrame:
    return table(spark, d, "lineitem")


@register("filter_compare", (73, 74, 81, 82, 94), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40 AND l_quantity < 49 AND l_discount >= 0.03 AND l_tax <= 0.06 AND l_linenumber <> 2 AND l_returnflag = 'R'")
def filter_compare(spark, d):
    rows = line(spark, d).filter((c("l_quantity") > 40) & (c("l_quantity") < 49) & (c("l_discount") >= 0.03))
    return rows.filter((c("l_tax") <= 0.06) & (c("l_linenumber") != 2) & (c("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@register("filter_columns", (75, 76), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax < l_discount AND l_quantity >= l_linenumber AND l_partkey <> l_suppkey")
def filter_columns(spark, d):
    return line(spark, d).filter((c("l_tax") < c("l_discount")) & (c("l_quantity") >= c("l_linenumber")) & (c("l_partkey") != c("l_suppkey"))).select("l_orderkey", "l_linenumber")


@register("filter_in_list", (77, 155), "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 9, 77, 301) OR o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in_list(spark, d):
    return table(spark, d, "orders").filter(c("o_custkey").isin(1, 5, 9, 77, 301) | c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@register("filter_null_aware", (78, 79), "SELECT l_orderkey, l_linenumber, (q IS NULL) AS q_null FROM (SELECT *, NULLIF(l_quantity, 10) q, NULLIF(l_tax, 0.02) t FROM lineitem) WHERE q > 45 OR (q IS NULL AND t IS NOT NULL)")
def filter_null_aware(spark, d):
    rows = line(spark, d).select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(10.0)).alias("q"), F.nullif("l_tax", F.lit(0.02)).alias("t"))
    return rows.filter((c("q") > 45) | (c("q").isNull() & c("t").isNotNull())).select("l_orderkey", "l_linenumber", c("q").isNull().alias("q_null"))


@register("filter_range_pruned", (8, 9, 80, 91, 92, 93), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_totalprice > 1000")
def filter_range_pruned(spark, d):
    return table(spark, d, "orders").filter(c("o_orderkey").between(100, 900) & (c("o_totalprice") > 1000)).select("o_orderkey", "o_totalprice")


@register(
    "selection_algebra", (84, 85, 89, 90, 178),
    """SELECT l_linestatus, COUNT(*) FILTER (WHERE a AND b) AS n_and, COUNT(*) FILTER (WHERE a OR b) AS n_or, COUNT(*) FILTER (WHERE NOT a) AS n_not,
       COUNT(*) FILTER (WHERE a <> b) AS n_xor, CAST(SUM(CAST(a AS BIGINT)) AS BIGINT) AS flags FROM (SELECT l_linestatus, l_quantity > 25 AS a, l_discount > 0.05 AS b FROM lineitem) GROUP BY 1""",
)
def selection_algebra(spark, d):
    rows = line(spark, d).select("l_linestatus", (c("l_quantity") > 25).alias("a"), (c("l_discount") > 0.05).alias("b"))
    a, b = c("a"), c("b")
    return rows.groupBy("l_linestatus").agg(F.count_if(a & b).alias("n_and"), F.count_if(a | b).alias("n_or"), F.count_if(~a).alias("n_not"), F.count_if(a != b).alias("n_xor"), F.sum(a.cast("bigint")).alias("flags"))


@register("bitmap_distinct", (85, 178), "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def bitmap_distinct(spark, d):
    bits = line(spark, d).groupBy("l_returnflag", F.bitmap_bucket_number("l_suppkey").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("l_suppkey")).alias("bits"))
    return bits.groupBy("l_returnflag").agg(F.sum(F.bitmap_count("bits")).alias("n"))


@register("gather_rows", (86,), "SELECT o.o_orderkey, o.o_totalprice, i.pos FROM orders o JOIN (SELECT UNNEST([7, 3, 3, 900]) AS k, UNNEST([0, 1, 2, 3]) AS pos) i ON o.o_orderkey = i.k")
def gather_rows(spark, d):
    ids = spark.sql("SELECT k, pos FROM VALUES (7L, 0), (3L, 1), (3L, 2), (900L, 3) AS t(k, pos)")
    return table(spark, d, "orders").join(ids, c("o_orderkey") == c("k")).select("o_orderkey", "o_totalprice", "pos")


@register("case_and_literals", (87, 88), "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, 42 AS answer, IF(o_custkey % 2 = 0, o_totalprice, -1.0) AS pick FROM orders")
def case_and_literals(spark, d):
    p = c("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(p > 200000, "big").when(p > 100000, "mid").otherwise("small").alias("size"), F.lit(42).alias("answer"), F.when(c("o_custkey") % 2 == 0, p).otherwise(F.lit(-1.0)).alias("pick"))


@register("tombstone_filter", (95, 57), "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def tombstone_filter(spark, d):
    dead = line(spark, d).filter(c("l_quantity") > 48).select("l_orderkey")
    return table(spark, d, "orders").join(dead, c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey")


@register("encoded_filters", (83, 159, 128), "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber > 2 GROUP BY 1")
def encoded_filters(spark, d):
    return line(spark, d).filter((c("l_returnflag") == "A") & (c("l_linenumber") > 2)).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@register(
    "arithmetic", (96, 97, 98, 99),
    """SELECT l_orderkey, l_linenumber, l_orderkey + l_partkey AS a, l_orderkey - l_partkey AS s, l_orderkey * l_linenumber AS m,
       CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(trunc(CAST(l_orderkey AS DOUBLE) / (l_linenumber % 3)) AS BIGINT) END AS q,
       l_orderkey + 7 AS al, 100 - l_orderkey AS ls, l_orderkey * 3 AS ml, -l_orderkey AS neg, l_extendedprice / l_quantity AS f FROM lineitem""",
)
def arithmetic(spark, d):
    o, p, n = c("l_orderkey"), c("l_partkey"), c("l_linenumber")
    return line(spark, d).select(
        "l_orderkey", "l_linenumber", (o + p).alias("a"), (o - p).alias("s"), (o * n).alias("m"), N.div_or_zero(o, n % 3).alias("q"),
        (o + 7).alias("al"), (100 - o).alias("ls"), (o * 3).alias("ml"), (-o).alias("neg"), (c("l_extendedprice") / c("l_quantity")).alias("f"),
    )


@register(
    "wrapping_add", (96,),
    """SELECT o_orderkey, CAST(CASE WHEN s > 9223372036854775807 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS w
       FROM (SELECT o_orderkey, CAST(9223372036854775800 AS HUGEINT) + (o_orderkey % 20) AS s FROM orders)""",
)
def wrapping_add(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.wrapping_add(F.lit(9223372036854775800), c("o_orderkey") % 20).alias("w"))


@register(
    "scalar_helpers", (100,),
    """SELECT l_orderkey, l_linenumber, LEAST(l_tax, l_discount) AS lo, GREATEST(l_tax, l_discount) AS hi, LEAST(GREATEST(l_quantity, 10), 40) AS cl,
       ABS(l_tax - l_discount) AS ab, CAST(SIGN(l_tax - l_discount) AS INT) AS sg FROM lineitem""",
)
def scalar_helpers(spark, d):
    t, x = c("l_tax"), c("l_discount")
    return line(spark, d).select("l_orderkey", "l_linenumber", F.least(t, x).alias("lo"), F.greatest(t, x).alias("hi"), N.clamp(c("l_quantity"), 10.0, 40.0).alias("cl"), F.abs(t - x).alias("ab"), F.signum(t - x).cast("int").alias("sg"))


@register(
    "saturating_casts", (101,),
    """SELECT l_orderkey, l_linenumber, CAST(LEAST(GREATEST(trunc(x), -128), 127) AS INT) AS i8, CAST(LEAST(GREATEST(trunc(x * 10), -32768), 32767) AS INT) AS i16,
       CAST(LEAST(GREATEST(trunc(x * 100000), -2147483648), 2147483647) AS INT) AS i32, CAST(l_quantity AS BIGINT) AS q
       FROM (SELECT *, l_extendedprice - 30000 AS x FROM lineitem)""",
)
def saturating_casts(spark, d):
    x = c("l_extendedprice") - 30000
    return line(spark, d).select(
        "l_orderkey", "l_linenumber", N.saturating_cast(x, "tinyint").cast("int").alias("i8"), N.saturating_cast(x * 10, "smallint").cast("int").alias("i16"),
        N.saturating_cast(x * 100000, "int").alias("i32"), c("l_quantity").cast("bigint").alias("q"),
    )


@register(
    "decimal_arithmetic", (102, 103, 104, 105, 107, 108),
    """SELECT l_orderkey, l_linenumber, CAST(p + d AS DOUBLE) AS a, CAST(p - d AS DOUBLE) AS s, CAST(p * d AS DOUBLE) AS m, CAST(p + 1.5 AS DOUBLE) AS al, CAST(-p AS DOUBLE) AS ng,
       (CAST(p * 100 AS BIGINT) * 100 // CAST(q * 100 AS BIGINT)) / 100.0 AS dv FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) p, CAST(l_discount AS DECIMAL(6,4)) d, CAST(l_quantity AS DECIMAL(6,2)) q FROM lineitem) WHERE p > d * 10000""",
)
def decimal_arithmetic(spark, d):
    rows = line(spark, d).select("l_orderkey", "l_linenumber", c("l_extendedprice").cast("decimal(12,2)").alias("p"), c("l_discount").cast("decimal(6,4)").alias("x"), c("l_quantity").cast("decimal(6,2)").alias("q"))
    p, x = c("p"), c("x")
    made = {"a": p + x, "s": p - x, "m": p * x, "al": p + F.lit("1.5").cast("decimal(2,1)"), "ng": -p, "dv": N.decimal_div(p, c("q"), 2)}
    return rows.filter(p > x * 10000).select("l_orderkey", "l_linenumber", *[v.cast("double").alias(k) for k, v in made.items()])


@register("decimal_reductions", (106, 107), "SELECT l_returnflag, CAST(MIN(p) AS DOUBLE) AS lo, CAST(MAX(p) AS DOUBLE) AS hi, CAST(SUM(p) AS DOUBLE) AS s, COUNT(p) AS n FROM (SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) p FROM lineitem) GROUP BY 1")
def decimal_reductions(spark, d):
    rows = line(spark, d).select("l_returnflag", c("l_extendedprice").cast("decimal(18,2)").alias("p"))
    return rows.groupBy("l_returnflag").agg(F.min("p").cast("double").alias("lo"), F.max("p").cast("double").alias("hi"), F.sum("p").cast("double").alias("s"), F.count("p").alias("n"))


@register("checksums", (110, 111))
def checksums(spark, d):
    """xxhash64, Murmur3 and Castagnoli CRC of a string."""
    return table(spark, d, "nation").select("n_nationkey", F.xxhash64("n_name").alias("h64"), F.hash("n_name").alias("h32"), N.crc32c(c("n_name").cast("binary")).alias("crc32c"))


@register(
    "string_predicates", (112, 113, 114, 115, 116),
    """SELECT p_partkey, (p_brand = 'Brand#11') AS eq, (p_brand <> 'Brand#11') AS ne, p_brand IN ('Brand#11', 'Brand#23') AS inl, (p_name < 'm') AS lt, starts_with(p_name, 'a') AS st,
       contains(p_name, 'e') AS co, (p_type LIKE '%STEEL') AS suf, (p_type LIKE 'S%') AS pre, (p_type LIKE '%A_%E%') AS gen, (p_type NOT LIKE '%E%') AS nl FROM part""",
)
def string_predicates(spark, d):
    b, n, t = c("p_brand"), c("p_name"), c("p_type")
    return table(spark, d, "part").select(
        "p_partkey", (b == "Brand#11").alias("eq"), (b != "Brand#11").alias("ne"), b.isin("Brand#11", "Brand#23").alias("inl"), (n < "m").alias("lt"), n.startswith("a").alias("st"),
        n.contains("e").alias("co"), t.like("%STEEL").alias("suf"), t.like("S%").alias("pre"), t.like("%A_%E%").alias("gen"), (~t.like("%E%")).alias("nl"),
    )


@register(
    "string_functions", (117, 118, 119, 120, 121, 122, 123),
    r"""SELECT c_custkey, substring(c_name, 3, 4) AS sub, substring(c_name, 1, 2) AS sub0, trim(w, E' \t\n') AS tr, ltrim(w, E' \t\n') AS lt, rtrim(w, E' \t\n') AS rt, upper(c_name) AS up, lower(c_name) AS lo,
       CAST(strlen(c_name || 'é') AS INT) AS bytes, CAST(length(c_name || 'é') AS INT) AS chars, CAST(instr(c_name, '0') AS INT) AS pos, c_name || '/' || c_mktsegment AS cat, replace(c_name, '00', 'x') AS rep
       FROM (SELECT *, E' \t' || c_name || E'\n ' AS w FROM customer)""",
)
def string_functions(spark, d):
    n, w = c("c_name"), F.concat(F.lit(" \t"), c("c_name"), F.lit("\n "))
    more = F.concat(n, F.lit("é"))
    return table(spark, d, "customer").select(
        "c_custkey", S.substring(n, F.lit(3), F.lit(4)).alias("sub"), S.substring(n, F.lit(-5), F.lit(2)).alias("sub0"), S.trim(w).alias("tr"), S.ltrim(w).alias("lt"), S.rtrim(w).alias("rt"),
        S.ascii_upper(n).alias("up"), S.ascii_lower(n).alias("lo"), F.octet_length(more).alias("bytes"), F.char_length(more).alias("chars"), F.instr(n, "0").alias("pos"),
        F.concat(n, F.lit("/"), c("c_mktsegment")).alias("cat"), F.replace(n, F.lit("00"), F.lit("x")).alias("rep"),
    )


@register(
    "binary_functions", (125,),
    "SELECT c_custkey, (c_name = 'Customer#000000007') AS eq, starts_with(c_name, 'Cust') AS pre, contains(c_name, '77') AS co, CAST(strlen(c_name) AS INT) AS len, (strlen(c_name) BETWEEN 10 AND 20) AS rng FROM customer",
)
def binary_functions(spark, d):
    b = c("c_name").cast("binary")
    return table(spark, d, "customer").select(
        "c_custkey", (b == F.lit(b"Customer#000000007")).alias("eq"), F.startswith(b, F.lit(b"Cust")).alias("pre"), F.contains(b, F.lit(b"77")).alias("co"), F.octet_length(b).alias("len"), F.octet_length(b).between(10, 20).alias("rng"),
    )


@register(
    "regex_functions", (126, 127),
    r"""SELECT p_partkey, regexp_extract(p_brand, '([A-Z][a-z]+)#([0-9])', 2) AS grp, regexp_replace(p_brand, '([A-Za-z]+)#([0-9]+)', '\2-\1', 'g') AS sub, regexp_full_match(p_brand, '(?i)brand#(1|2)[0-9]{1}') AS fm FROM part""",
)
def regex_functions(spark, d):
    b = c("p_brand")
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(b, "([A-Z][a-z]+)#([0-9])", 2).alias("grp"), S.substitute(b, "([A-Za-z]+)#([0-9]+)", r"\2-\1").alias("sub"), S.full_match(b, "(?i)brand#(1|2)[0-9]{1}").alias("fm"))


@register("dictionary_codes", (128, 124), "SELECT p_brand, CAST(ROW_NUMBER() OVER (ORDER BY p_brand) - 1 AS INT) AS code, COUNT(*) AS n FROM part GROUP BY p_brand")
def dictionary_codes(spark, d):
    terms = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))  # the codes rank the distinct terms alone
    return numbered(terms, [c("p_brand").asc()], "place").select("p_brand", (c("place") - 1).cast("int").alias("code"), "n")


@register("term_dictionary", (129,), "SELECT c_name, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001') OR c_name BETWEEN 'Customer#000000100' AND 'Customer#000000120' OR c_name = 'Customer#000000777'")
def term_dictionary(spark, d):
    n = c("c_name")
    return table(spark, d, "customer").filter(n.startswith("Customer#00000001") | n.between("Customer#000000100", "Customer#000000120") | (n == "Customer#000000777")).select("c_name", "c_custkey")


@register(
    "date_parts", (130, 131, 133),
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS dd, CAST(quarter(o_orderdate) AS BIGINT) AS q,
       CAST(isodow(o_orderdate) AS BIGINT) AS dow, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(weekofyear(o_orderdate) AS BIGINT) AS wk FROM orders""",
)
def date_parts(spark, d):
    t = c("o_orderdate").cast("date")
    made = {"y": F.year(t), "m": F.month(t), "dd": F.dayofmonth(t), "q": F.quarter(t), "dow": F.weekday(t) + 1, "doy": F.dayofyear(t), "wk": F.weekofyear(t)}
    return table(spark, d, "orders").select("o_orderkey", *[v.cast("bigint").alias(k) for k, v in made.items()])


@register(
    "time_parts", (132, 134),
    """SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s, date_trunc('day', ts) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS secs,
       CAST(floor(epoch(ts - INTERVAL 1 HOUR)) AS BIGINT) AS before FROM events""",
)
def time_parts(spark, d):
    ts = c("ts")
    return table(spark, d, "events").select(
        "event_id", F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.second(ts).alias("s"), F.date_trunc("day", ts).cast("timestamp_ntz").alias("day"),
        F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).alias("secs"), F.floor(F.unix_micros((ts - F.expr("INTERVAL 1 HOUR")).cast("timestamp")) / 1_000_000).alias("before"),
    )


@register(
    "interval_arithmetic", (135, 136, 137, 138, 139),
    """SELECT o_orderkey, CAST(CAST(d + to_months(m) AS DATE) + dy AS DATE) AS plus, CAST(date_diff('day', DATE '1995-01-31', d) AS INT) AS diff, CAST((m * 3) * 30 + dy * 3 AS INT) AS k3, (m * 30 + dy > 100) AS longer, CAST(last_day(d) AS DATE) AS eom
       FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 14 AS INT) AS m, CAST(o_orderkey % 40 AS INT) AS dy FROM orders) WHERE d >= DATE '1995-01-31'""",
)
def interval_arithmetic(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", c("o_orderdate").cast("date").alias("d"), D.interval(c("o_orderkey") % 14, c("o_orderkey") % 40).alias("i"))
    rows = rows.filter(c("d") >= F.lit("1995-01-31").cast("date"))
    return rows.select(
        "o_orderkey", D.add_interval(c("d"), c("i")).alias("plus"), D.date_difference(c("d"), F.lit("1995-01-31").cast("date"))["days"].alias("diff"),
        D.interval_key(D.scale_interval(c("i"), F.lit(3))).alias("k3"), (D.interval_key(c("i")) > 100).alias("longer"), F.last_day("d").alias("eom"),
    )


@register(
    "series_basics", (109, 239, 274),
    """SELECT event_id, ln(v) AS lg, COALESCE(v - LAG(v) OVER w, 0) AS diff, COALESCE(LAG(v, 3) OVER w, 0) AS lag3, MAX(v) OVER (w ROWS UNBOUNDED PRECEDING) - v AS dd
       FROM (SELECT *, value + 1 AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def series_basics(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = c("v")
    return table(spark, d, "events").withColumn("v", c("value") + 1).select(
        "event_id", F.log(v).alias("lg"), F.coalesce(v - F.lag(v).over(w), F.lit(0.0)).alias("diff"), F.coalesce(F.lag(v, 3).over(w), F.lit(0.0)).alias("lag3"),
        (F.max(v).over(w.rowsBetween(Window.unboundedPreceding, 0)) - v).alias("dd"),
    )
