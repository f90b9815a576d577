"""Market-data operators over events (survey 2.16): series by user_id, ordered by ts and event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions import fintech as M
from ..operators import recursive as X

c = F.col

BASE = """(SELECT event_id, user_id, ts, value + 10 AS p, value + 9.95 AS bid, value + 10.07 AS ask, CAST(1 + event_id % 7 AS DOUBLE) AS bs, CAST(1 + event_id % 5 AS DOUBLE) AS az,
  CAST(event_id % 9 AS DOUBLE) AS qty, CAST(event_id % 3 - 1 AS DOUBLE) AS side, (value + 10) * 1.02 AS h, (value + 10) * 0.97 AS l, (value + 10) * 1.005 AS o, (value + 10) * (1 + (event_id % 11) * 0.001) AS c FROM events)"""
KEYED = f"SELECT *, ln(p / LAG(p) OVER w) AS r0, COALESCE(ln(p / LAG(p) OVER w), 0) AS r, COALESCE(p - LAG(p) OVER w, 0) AS dp FROM {BASE} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), run AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), pt AS (PARTITION BY user_id)"


def base(spark, d) -> DataFrame:
    p, e = c("value") + 10, c("event_id")
    dbl = lambda x: x.cast("double")
    return table(spark, d, "events").select(
        "event_id", "user_id", "ts", p.alias("p"), (c("value") + 9.95).alias("bid"), (c("value") + 10.07).alias("ask"), dbl(e % 7 + 1).alias("bs"), dbl(e % 5 + 1).alias("az"), dbl(e % 9).alias("qty"),
        dbl(e % 3 - 1).alias("side"), (p * 1.02).alias("h"), (p * 0.97).alias("l"), (p * 1.005).alias("o"), (p * (F.lit(1.0) + (e % 11) * 0.001)).alias("c"),
    )


def keyed(spark, d) -> DataFrame:
    w = M.series(["user_id"], ["ts", "event_id"])
    return base(spark, d).withColumns({"r": M.log_returns(c("p"), w), "dp": M.difference(c("p"), w)})


def rounded(df: DataFrame, digits: int, **made) -> DataFrame:
    """The made columns; NaN, which SQL's rounding keeps apart, becomes null."""
    return df.select("event_id", *[F.round(F.when(F.isnan(v), None).otherwise(v), digits).alias(k) for k, v in made.items()])


def sql(columns: dict[str, str], digits: int, source: str = KEYED, where: str = "") -> str:
    made = ", ".join(f"ROUND({v}, {digits}) AS {k}" for k, v in columns.items())
    return f"SELECT event_id, {made} FROM ({source}) {W} {where}"


@register("market_quotes", (224, 225, 226, 227, 228, 230, 231), sql({"mid": "(bid + ask) * 0.5", "micro": "(bid * az + ask * bs) / (bs + az)", "imb": "(bs - az) / (bs + az)", "spread": "ask - bid", "eff": "2 * abs(c - (bid + ask) * 0.5)", "sv": "side * qty", "ofi": "bs * qty - az * qty"}, 9))
def quotes(spark, d):
    bid, ask, b, a = c("bid"), c("ask"), c("bs"), c("az")
    mid = M.midprice(bid, ask)
    return rounded(keyed(spark, d), 9, mid=mid, micro=M.microprice(bid, ask, b, a), imb=M.imbalance(b, a), spread=ask - bid, eff=M.effective_spread(c("c"), mid), sv=c("side") * c("qty"), ofi=b * c("qty") - a * c("qty"))


@register("market_costs", (232, 233, 234, 235, 236, 237, 238), sql({"impact": "1e4 * (c - (bid + ask) * 0.5) / ((bid + ask) * 0.5)", "short": "1e4 * (c - p) / p", "fwd": "p * exp((0.05 - 0.02) * 0.5) - p", "fund": "qty * p * 0.0003", "cip": "ln(c / p) / 0.5 - (0.05 - 0.02)", "apr": "side * 0.0001 * 1095 * 100", "perp": "p * (1 + 0.0001 * qty / 8)"}, 9))
def costs(spark, d):
    p, mid = c("p"), M.midprice(c("bid"), c("ask"))
    return rounded(
        keyed(spark, d), 9, impact=M.basis_points(c("c"), mid), short=M.basis_points(c("c"), p), fwd=M.forward_points(p, F.lit(0.05), F.lit(0.02), F.lit(0.5)), fund=c("qty") * p * 0.0003,
        cip=M.cip_basis(c("c"), p, F.lit(0.05), F.lit(0.02), F.lit(0.5)), apr=M.funding_apr(c("side") * 0.0001, 1095), perp=M.perpetual_fair(p, F.lit(0.0001), c("qty")),
    )


@register("market_bars", (240, 241, 242, 243), sql({
    "cs": "COALESCE(GREATEST(2 * (exp(a) - 1) / (exp(a) + 1), 0), 0)", "gk": "0.5 * ln(h / l) ** 2 - (2 * ln(2) - 1) * ln(c / o) ** 2", "pk": "ln(h / l) ** 2 / (4 * ln(2))", "rs": "ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)"}, 8,
    f"""SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS a FROM (SELECT *, ln(h / l) ** 2 + ln(h0 / l0) ** 2 AS beta, ln(GREATEST(h, h0) / LEAST(l, l0)) ** 2 AS gamma FROM (
    SELECT *, LAG(h) OVER w AS h0, LAG(l) OVER w AS l0 FROM {BASE} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE TRUE)"""))  # fmt: skip
def bars(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    h, low, o, k = c("h"), c("l"), c("o"), c("c")
    cs = F.when(F.lag(h).over(w).isNull(), 0.0).otherwise(M.corwin_schultz(h, low, w))
    return rounded(keyed(spark, d), 8, cs=cs, gk=M.garman_klass(o, h, low, k), pk=M.parkinson(h, low), rs=M.rogers_satchell(o, h, low, k))


@register("market_guards", (246, 247, 248, 249, 250), f"""SELECT event_id, CAST(qty > 5 AS INT) AS st, CAST(abs(c / p - 1) >= 0.006 AS INT) AS band, CAST(abs(c / p - 1) >= 0.006 OR c * qty >= 900 AS INT) AS fat, CAST(abs(c / p - 1) > 0.006 AS INT) AS brk,
    ROUND(CASE WHEN qty > 0 THEN abs(r) / qty ELSE 0 END, 9) AS am FROM ({KEYED})""")  # fmt: skip
def guards(spark, d):
    k, p, q = c("c"), c("p"), c("qty")
    return keyed(spark, d).select(
        "event_id", M.stale(q, F.lit(0), 5).alias("st"), M.price_band(k, p, 0.006).alias("band"), M.fat_finger(k, q, p, 0.006, 900).alias("fat"), M.circuit_breaker(k, p, 0.006).alias("brk"), F.round(M.amihud(c("r"), q), 9).alias("am")
    )


@register("market_returns", (229, 239, 274, 275), sql({"r1": "r", "oi": "dp", "dd": "MAX(p) OVER run - p", "ddf": "(MAX(p) OVER run - p) / MAX(p) OVER run"}, 9))
def returns(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    return rounded(keyed(spark, d), 9, r1=c("r"), oi=c("dp"), dd=F.max("p").over(M.running(w)) - c("p"), ddf=M.drawdown(c("p"), w))


FULL = "CASE WHEN COUNT(*) OVER w5 >= 5 THEN {} END"


@register("market_averages", (251, 252, 253, 255, 256, 257), sql({
    "s": FULL.format("AVG(p) OVER w5"), "up": FULL.format("AVG(p) OVER w5 + 2 * STDDEV_POP(p) OVER w5"), "dn": FULL.format("AVG(p) OVER w5 - 2 * STDDEV_POP(p) OVER w5"), "hi": FULL.format("MAX(h) OVER w5"), "lo": FULL.format("MIN(l) OVER w5"),
    "vw": FULL.format("SUM(p * qty) OVER w5 / NULLIF(SUM(qty) OVER w5, 0)"), "tw": FULL.format("AVG(p) OVER w5")}, 6))
def averages(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    mid, up, down = M.bollinger(c("p"), w, 5, 2)
    hi, lo = M.donchian(c("h"), c("l"), w, 5)
    return rounded(keyed(spark, d), 6, s=mid, up=up, dn=down, hi=hi, lo=lo, vw=M.vwap(c("p"), c("qty"), w, 5), tw=M.sma(c("p"), w, 5))


@register("market_ranges", (254, 258), sql({"atr": FULL.format("AVG(tr) OVER w5"), "k": FULL.format("CASE WHEN MAX(h) OVER w5 - MIN(l) OVER w5 <= 1e-12 THEN 50 ELSE 100 * (c - MIN(l) OVER w5) / (MAX(h) OVER w5 - MIN(l) OVER w5) END")}, 6,
    f"SELECT *, COALESCE(GREATEST(h - l, abs(h - LAG(c) OVER w), abs(l - LAG(c) OVER w)), h - l) AS tr FROM {BASE} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"))
def ranges(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    rows = keyed(spark, d).withColumn("tr", M.true_range(c("h"), c("l"), c("c"), w))
    return rounded(rows, 6, atr=M.sma(c("tr"), w, 5), k=M.stochastic_k(c("h"), c("l"), c("c"), w, 5))


@register("market_moments", (259, 260, 261, 264, 265, 266), sql({
    "m": "AVG(p) OVER run * pi()", "v": "VAR_POP(p) OVER run * pi()", "sd": "STDDEV_POP(p) OVER w5", "z": "CASE WHEN STDDEV_POP(p) OVER w5 > 1e-9 THEN (p - AVG(p) OVER w5) / STDDEV_POP(p) OVER w5 ELSE 0 END",
    "cr": "CASE WHEN COUNT(*) OVER w5 >= 3 AND STDDEV_POP(p) OVER w5 * STDDEV_POP(qty) OVER w5 > 1e-9 THEN CORR(p, qty) OVER w5 ELSE 0 END",
    "sk": "CASE WHEN COUNT(*) OVER w5 < 3 OR STDDEV_POP(p) OVER w5 <= 1e-9 THEN 0 ELSE (AVG(p ** 3) OVER w5 - 3 * AVG(p) OVER w5 * AVG(p ** 2) OVER w5 + 2 * (AVG(p) OVER w5) ** 3) / (STDDEV_POP(p) OVER w5) ** 3 END"}, 4))
def moments(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    p, r = c("p"), M.rolling(w, 5)
    few = F.count(F.lit(1)).over(r) < 3
    corr = F.when(few, 0.0).otherwise(M.rolling_corr(p, c("qty"), w, 5))
    return rounded(keyed(spark, d), 4, m=F.avg(p).over(M.running(w)) * F.pi(), v=F.var_pop(p).over(M.running(w)) * F.pi(), sd=M.rolling_std(p, w, 5), z=M.zscore(p, w, 5), cr=corr, sk=M.rolling_skew(p, w, 5))


@register("market_kurtosis", (266, 267), sql({
    "ku": "CASE WHEN len(vs) < 4 OR list_var_pop(vs) <= 1e-10 THEN 0 ELSE list_avg(list_transform(vs, lambda v: (v - list_avg(vs)) ** 4)) / list_var_pop(vs) ** 2 - 3 END",
    "ac": "CASE WHEN n <= 5 OR sx * sy <= 1e-12 THEN 0 ELSE cv / (sx * sy) END"}, 4,
    f"""SELECT *, list(p) OVER w5 AS vs, STDDEV_POP(p) OVER w5 AS sx, STDDEV_POP(x1) OVER w5 AS sy, COVAR_POP(p, x1) OVER w5 AS cv FROM (SELECT *, LAG(p) OVER o AS x1, ROW_NUMBER() OVER o AS n FROM {BASE} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
    WINDOW w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)"""))  # fmt: skip
def kurtosis(spark, d):
    """Rolling excess kurtosis and autocorrelation at lag 1."""
    w = M.series(["user_id"], ["ts", "event_id"])
    lagged = F.lag("p", 1).over(w)
    rows = keyed(spark, d).withColumns({"x1": lagged, "n": F.row_number().over(w)})
    auto = F.when(c("n") <= 5, 0.0).otherwise(M.rolling_corr(c("p"), c("x1"), w, 5))
    return rounded(rows, 4, ku=M.rolling_kurtosis(c("p"), w, 5), ac=auto)


@register("market_batch", (244, 245, 262, 263), sql({
    "rv": "SUM(r * r) OVER pt", "bv": "CASE WHEN COUNT(*) OVER pt < 2 THEN 0 ELSE pi() / 2 * SUM(abs(r) * abs(rl)) OVER pt / (COUNT(*) OVER pt - 1) END",
    "sh": "CASE WHEN COALESCE(STDDEV_SAMP(r) OVER pt, 0) > 1e-12 THEN (AVG(r) OVER pt - 0.02 / 252) / STDDEV_SAMP(r) OVER pt * sqrt(252) ELSE 0 END",
    "so": "CASE WHEN SQRT(AVG(LEAST(r - 0.02 / 252, 0) ** 2) OVER pt) > 1e-12 THEN (AVG(r) OVER pt - 0.02 / 252) / SQRT(AVG(LEAST(r - 0.02 / 252, 0) ** 2) OVER pt) * sqrt(252) ELSE 0 END"}, 6,
    f"SELECT *, LAG(r) OVER w AS rl FROM ({KEYED}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"))
def batch(spark, d):
    w, p = M.series(["user_id"], ["ts", "event_id"]), Window.partitionBy("user_id")
    rows = keyed(spark, d).withColumn("rl", F.lag("r").over(w))
    return rounded(rows, 6, rv=F.sum(c("r") * c("r")).over(p), bv=M.bipower(c("r"), c("rl"), p), sh=M.sharpe(c("r"), p, 0.02, 252), so=M.sortino(c("r"), p, 0.02, 252))


@register("market_medrv", (281,), sql({"x": "CASE WHEN n < 3 THEN 0 ELSE pi() / (6 - 4 * sqrt(3) + pi()) * n / (n - 2) * SUM(q * q) OVER pt END"}, 6,
    f"SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN abs(a) + abs(r) + abs(b) - GREATEST(abs(a), abs(r), abs(b)) - LEAST(abs(a), abs(r), abs(b)) END AS q FROM (SELECT *, LAG(r) OVER w AS a, LEAD(r) OVER w AS b, COUNT(*) OVER (PARTITION BY user_id) AS n FROM ({KEYED}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"))
def medrv(spark, d):
    w, p = M.series(["user_id"], ["ts", "event_id"]), Window.partitionBy("user_id")
    rows = keyed(spark, d).withColumns({"a": F.lag("r").over(w), "b": F.lead("r").over(w), "n": F.count("*").over(p)})
    return rounded(rows, 6, x=M.med_rv(c("a"), c("r"), c("b"), c("n"), p))


Z = M.normal_quantile(0.05)


@register("market_cornish_fisher", (282,), f"""SELECT user_id, ROUND(-(m + ({Z} + s * {(Z * Z - 1) / 6} + k * {(Z**3 - 3 * Z) / 24} - s * s * {(2 * Z**3 - 5 * Z) / 36}) * sd), 6) AS x FROM (
    SELECT user_id, AVG(r) AS m, STDDEV_POP(r) AS sd, (AVG(r ** 3) - 3 * AVG(r) * AVG(r ** 2) + 2 * AVG(r) ** 3) / STDDEV_POP(r) ** 3 AS s,
    (AVG(r ** 4) - 4 * AVG(r) * AVG(r ** 3) + 6 * AVG(r) ** 2 * AVG(r ** 2) - 3 * AVG(r) ** 4) / STDDEV_POP(r) ** 4 - 3 AS k FROM ({KEYED}) GROUP BY 1 HAVING COUNT(*) > 5)""")  # fmt: skip
def cornish(spark, d):
    p = Window.partitionBy("user_id")
    rows = keyed(spark, d).select("user_id", M.cornish_fisher(c("r"), p, 0.95).alias("x"), F.count("*").over(p).alias("n"))
    return rows.filter("n > 5").groupBy("user_id").agg(F.round(F.first("x"), 6).alias("x"))


@register("market_tail", (277, 278), sql({"v": "-list_sort(list(r) OVER w5)[least(CAST(floor(0.30000000000000004 * COUNT(*) OVER w5) AS BIGINT), COUNT(*) OVER w5 - 1) + 1]", "cv": "CASE WHEN floor(0.30000000000000004 * COUNT(*) OVER w5) = 0 THEN 0 ELSE -list_avg(list_sort(list(r) OVER w5)[1:CAST(floor(0.30000000000000004 * COUNT(*) OVER w5) AS BIGINT)]) END"}, 8))
def tail(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    return rounded(keyed(spark, d), 8, v=M.value_at_risk(c("r"), w, 5, 0.7), cv=M.tail_mean(c("r"), w, 5, 0.7))


@register("market_impact_slopes", (283,), sql({"ky": "CASE WHEN ROW_NUMBER() OVER w = 1 OR VAR_POP(sv) OVER w5 <= 1e-9 THEN 0 ELSE COVAR_POP(dp, sv) OVER w5 / VAR_POP(sv) OVER w5 END * pi()"}, 5, f"SELECT *, side * qty AS sv FROM ({KEYED})"))
def slopes(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    return rounded(keyed(spark, d).withColumn("sv", c("side") * c("qty")), 5, ky=M.kyle_lambda(c("dp"), c("sv"), w, 5) * F.pi())


@register("market_roll_spread", (284,), sql({"rl": "CASE WHEN ROW_NUMBER() OVER w <= 4 OR COVAR_POP(dp, d1) OVER w5 >= 0 THEN 0 ELSE 2 * sqrt(-COVAR_POP(dp, d1) OVER w5) END"}, 5, f"SELECT *, LAG(dp) OVER w AS d1 FROM ({KEYED}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"))
def roll(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    rows = keyed(spark, d).withColumns({"d1": F.lag("dp").over(w), "n": F.row_number().over(w)})
    cov = F.covar_pop("dp", "d1").over(M.rolling(w, 5))
    return rounded(rows, 5, rl=F.when((c("n") <= 4) | (cov >= 0), 0.0).otherwise(F.sqrt(-cov) * 2))


@register("market_schedule", (285,), sql({"share": "(sinh(k * (1 - i / 10)) - sinh(k * (1 - (i + 1) / 10))) / sinh(k)"}, 10, f"SELECT *, sqrt(0.5 / (2 * 0.1 * 0.3 * 0.3)) AS k, CAST((ROW_NUMBER() OVER w - 1) % 10 AS DOUBLE) AS i FROM ({KEYED}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"))
def schedule(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    rows = keyed(spark, d).withColumn("i", F.row_number().over(w) - 1)
    return rounded(rows, 10, share=M.almgren_chriss(c("i"), 10, 0.5, 0.1, 0.3))


@register("market_outliers", (286,), f"""SELECT event_id, CAST(mad > 0 AND abs(p - m) > 2 * 1.4826 * mad AS INT) AS flag FROM (SELECT event_id, p, m, list_median(list_transform(vs, lambda v: abs(v - m))) AS mad FROM (
    SELECT event_id, p, list(p) OVER w5 AS vs, list_median(list(p) OVER w5) AS m FROM {BASE} WINDOW w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)))""")
def outliers(spark, d):
    w = M.series(["user_id"], ["ts", "event_id"])
    return base(spark, d).select("event_id", M.mad_outlier(c("p"), w, 5, 2.0).alias("flag"))


@register("market_throttle", (287,), "SELECT event_id, CAST(COUNT(*) OVER (PARTITION BY user_id ORDER BY CAST(epoch_us(ts) AS BIGINT) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) <= 2 AS INT) AS ok FROM events")
def throttle(spark, d):
    t = F.unix_micros(c("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-86_400_000_000, 0)
    return table(spark, d, "events").withColumn("t", t).select("event_id", (F.count("*").over(w) <= 2).cast("int").alias("ok"))


def ewm_sql(x: str, alpha: float) -> str:
    return f"list_reduce(list({x}) OVER run, lambda a, b: {alpha} * b + {1 - alpha} * a)"


@register("market_exponential", (268, 269, 270, 272), sql({"ema": ewm_sql("p", 2 / 13), "ewma": ewm_sql("p", 0.3), "line": f"{ewm_sql('p', 2 / 13)} - {ewm_sql('p', 2 / 27)}", "vol": f"sqrt({ewm_sql('r * r', 1 - 0.94)})"}, 6))
def exponential(spark, d):
    def fn(f):
        line, signal, gap = X.macd(f["p"].to_numpy(), 12, 26, 9)
        return {"ema": X.ema(f["p"].to_numpy(), 12), "ewma": X.ewm(f["p"].to_numpy(), 0.3), "line": line, "vol": X.risk_metrics(f["r"].to_numpy(), 0.94)}

    made = X.apply(keyed(spark, d).select("event_id", "user_id", "ts", "p", "r"), ["user_id"], ["ts", "event_id"], dict.fromkeys(("ema", "ewma", "line", "vol"), "double"), fn)
    return rounded(made, 6, **{k: c(k) for k in ("ema", "ewma", "line", "vol")})


@register("market_rsi", (273,), sql({"rsi": "CASE WHEN n = 1 THEN 50 ELSE 100 - 100 / (1 + CASE WHEN b > 0 THEN a / b ELSE 100 END) END"}, 5,
    f"""SELECT *, list_reduce((list(GREATEST(dp, 0)) OVER run)[2:], lambda x, y: {1 / 14} * y + {1 - 1 / 14} * x) AS a, list_reduce((list(GREATEST(-dp, 0)) OVER run)[2:], lambda x, y: {1 / 14} * y + {1 - 1 / 14} * x) AS b
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({KEYED})) WHERE TRUE WINDOW run AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""".replace("list_reduce((", "list_reduce(CASE WHEN n = 1 THEN [0.0] ELSE (").replace("[2:], lambda", "[2:] END, lambda")))
def rsi(spark, d):
    made = X.apply(keyed(spark, d).select("event_id", "user_id", "ts", "p"), ["user_id"], ["ts", "event_id"], {"rsi": "double"}, lambda f: {"rsi": X.rsi(f["p"].to_numpy(), 14)})
    return rounded(made, 5, rsi=c("rsi"))


@register("market_filters", (271, 276, 279, 280))
def filters(spark, d):
    """Exponential covariance, CUSUM, a Kalman filter and a Kalman hedge ratio; tested against plain loops."""
    def fn(f):
        p, q = f["p"].to_numpy(), f["qty"].to_numpy()
        up, down = X.cusum(p, 100.0, 50.0)
        beta, spread = X.hedge_ratio(p, f["c"].to_numpy(), 1e-4, 1e-2)
        return {"cov": X.ew_covariance(p, q, 0.9), "up": up, "down": down, "kf": X.kalman(p, 0.01, 1.0), "beta": beta, "spread": spread}

    made = dict.fromkeys(("cov", "up", "down", "kf", "beta", "spread"), "double")
    out = X.apply(keyed(spark, d).select("event_id", "user_id", "ts", "p", "qty", "c"), ["user_id"], ["ts", "event_id"], made, fn)
    return rounded(out, 6, **{k: c(k) for k in made})

