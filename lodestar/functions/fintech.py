"""Market-data indicators as columns. R is a rolling window spec (rows), W a running one, P a whole partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

NAN = float("nan")
TINY = 1e-15


def series(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def rolling(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def zero_unless(ok: Column, x: Column) -> Column:
    return F.when(ok, x).otherwise(F.lit(0.0))


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b with IEEE results for a zero divisor."""
    inf = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(NAN))
    return F.when(b == 0, inf).otherwise(F.try_divide(a, b))


# rows


def midprice(bid, ask):
    return (bid + ask) * 0.5


def microprice(bid, ask, bid_size, ask_size):
    return ieee_ratio(bid * ask_size + ask * bid_size, bid_size + ask_size)


def imbalance(bid_size, ask_size):
    return ieee_ratio(bid_size - ask_size, bid_size + ask_size)


def effective_spread(price, mid):
    return F.abs(price - mid) * 2


def basis_points(price, reference):
    """10^4 (price - reference) / reference; 0 for a zero reference. Arrival impact and implementation shortfall."""
    return zero_unless(F.abs(reference) > TINY, F.try_divide((price - reference) * 1e4, reference))


def forward_points(spot, domestic, foreign, years):
    return spot * F.exp((domestic - foreign) * years) - spot


def cip_basis(forward, spot, domestic, foreign, years):
    return zero_unless((spot > 1e-12) & (years > 1e-12), F.try_divide(F.log(forward / spot), years)) - (domestic - foreign)


def funding_apr(rate, periods):
    return rate * periods * 100


def perpetual_fair(spot, rate, hours):
    return spot * (F.lit(1.0) + rate * hours / 8)


def garman_klass(o, h, low, c):
    return F.pow(F.log(h / low), 2) * 0.5 - F.pow(F.log(c / o), 2) * (2 * math.log(2) - 1)


def parkinson(h, low):
    return F.pow(F.log(h / low), 2) / (4 * math.log(2))


def rogers_satchell(o, h, low, c):
    return F.log(h / c) * F.log(h / o) + F.log(low / c) * F.log(low / o)


def stale(ts, last, age):
    return (ts - last > age).cast("int")


def price_band(price, reference, band):
    off = F.abs(F.try_divide(price, reference) - 1) >= band
    return F.when(F.abs(reference) <= TINY, 1).otherwise(off.cast("int"))


def fat_finger(price, size, reference, band, cap):
    return F.when((price_band(price, reference, band) == 1) | (price * size >= cap), 1).otherwise(0)


def circuit_breaker(price, reference, threshold):
    return F.when(F.abs(reference) <= TINY, 0).otherwise((F.abs(F.try_divide(price, reference) - 1) > threshold).cast("int"))


def amihud(ret, volume):
    return zero_unless(volume > 0, F.try_divide(F.abs(ret), volume))


# neighbours


def difference(x, w):
    return F.coalesce(x - F.lag(x).over(w), F.lit(0.0))


def log_returns(price, w):
    return F.coalesce(F.log(price / F.lag(price).over(w)), F.lit(0.0))


def corwin_schultz(h, low, w):
    """Two-bar high-low spread estimator, not under 0; 0 on the first bar."""
    h0, l0 = F.lag(h).over(w), F.lag(low).over(w)
    beta = F.pow(F.log(h / low), 2) + F.pow(F.log(h0 / l0), 2)
    gamma = F.pow(F.log(F.greatest(h, h0) / F.least(low, l0)), 2)
    k = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(beta * 2) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    return F.coalesce(F.greatest((F.exp(alpha) - 1) * 2 / (F.exp(alpha) + 1), F.lit(0.0)), F.lit(0.0))


# rolling, NaN until the window is full


def _full(x, w, n):
    return F.when(F.count(F.lit(1)).over(rolling(w, n)) < n, F.lit(NAN)).otherwise(x)


def sma(x, w, n):
    return _full(F.avg(x).over(rolling(w, n)), w, n)


def bollinger(x, w, n, k):
    m, s = F.avg(x).over(rolling(w, n)), F.stddev_pop(x).over(rolling(w, n))
    return tuple(_full(v, w, n) for v in (m, m + s * k, m - s * k))


def donchian(h, low, w, n):
    return _full(F.max(h).over(rolling(w, n)), w, n), _full(F.min(low).over(rolling(w, n)), w, n)


def true_range(h, low, c, w):
    before = F.lag(c).over(w)
    return F.when(before.isNull(), h - low).otherwise(F.greatest(h - low, F.abs(h - before), F.abs(low - before)))


def vwap(price, volume, w, n):
    pv, v = F.sum(price * volume).over(rolling(w, n)), F.sum(volume).over(rolling(w, n))
    return _full(F.when(v == 0, F.lit(NAN)).otherwise(F.try_divide(pv, v)), w, n)


def stochastic_k(h, low, c, w, n):
    top, bottom = F.max(h).over(rolling(w, n)), F.min(low).over(rolling(w, n))
    return _full(F.when(top - bottom <= 1e-12, F.lit(50.0)).otherwise(F.try_divide((c - bottom) * 100, top - bottom)), w, n)


# rolling, partial from the first row


def rolling_std(x, w, n):
    return F.stddev_pop(x).over(rolling(w, n))


def zscore(x, w, n):
    s = rolling_std(x, w, n)
    return zero_unless(s > 0, F.try_divide(x - F.avg(x).over(rolling(w, n)), s))


def rolling_corr(a, b, w, n):
    r = rolling(w, n)
    both = F.when(a.isNotNull() & b.isNotNull(), True)
    scale = F.stddev_pop(F.when(both, a)).over(r) * F.stddev_pop(F.when(both, b)).over(r)
    return F.coalesce(zero_unless(scale > 1e-12, F.try_divide(F.covar_pop(a, b).over(r), scale)), F.lit(0.0))


def rolling_skew(x, w, n):
    r = rolling(w, n)
    ok = (F.count(x).over(r) >= 3) & (F.stddev_pop(x).over(r) > 1e-10)
    return F.coalesce(zero_unless(ok, F.skewness(x).over(r)), F.lit(0.0))


def rolling_kurtosis(x, w, n):
    r = rolling(w, n)
    ok = (F.count(x).over(r) >= 4) & (F.var_pop(x).over(r) > 1e-10)
    return F.coalesce(zero_unless(ok, F.kurtosis(x).over(r)), F.lit(0.0))


def kyle_lambda(dp, volume, w, n):
    """Rolling slope of price changes on signed volume; 0 on the first row and without variance."""
    r = rolling(w, n)
    v = F.var_pop(volume).over(r)
    return F.when(F.row_number().over(w) == 1, 0.0).otherwise(zero_unless(v > TINY, F.try_divide(F.covar_pop(dp, volume).over(r), v)))


def value_at_risk(x, w, n, confidence):
    values = F.array_sort(F.collect_list(x).over(rolling(w, n)))
    at = F.floor(F.lit(1 - confidence) * F.size(values)).cast("int")
    return -F.get(values, F.least(at, F.size(values) - 1))


def tail_mean(x, w, n, confidence):
    """Minus the mean of the worst values; 0 if there is none."""
    values = F.array_sort(F.collect_list(x).over(rolling(w, n)))
    k = F.floor(F.lit(1 - confidence) * F.size(values)).cast("int")
    total = F.aggregate(F.slice(values, 1, k), F.lit(0.0), lambda a, v: a + v)
    return F.when(k == 0, F.lit(0.0)).otherwise(-F.try_divide(total, k))


def mad_outlier(x, w, n, k):
    """1 where |x - median| is over k scaled median absolute deviations of the window."""
    def median(v):
        s, m = F.array_sort(v), F.size(v)
        return (F.get(s, F.floor((m - 1) / 2).cast("int")) + F.get(s, F.floor(m / 2).cast("int"))) / 2

    values = F.collect_list(x).over(rolling(w, n))
    centre = median(values)
    mad = median(F.transform(values, lambda v: F.abs(v - centre))) * 1.4826
    return F.when((mad > 0) & (F.abs(x - centre) > mad * k), 1).otherwise(0)


# running


def drawdown(x, w):
    peak = F.max(x).over(running(w))
    return zero_unless(peak > TINY, F.try_divide(peak - x, peak))


# whole partitions


def bipower(ret, before, p):
    n = F.count(ret).over(p)
    return zero_unless(n >= 2, F.sum(F.abs(ret) * F.abs(before)).over(p) * (math.pi / 2) / F.greatest(n - 1, F.lit(1)))


def med_rv(before, ret, after, n, p):
    a, b, c = F.abs(before), F.abs(ret), F.abs(after)
    middle = a + b + c - F.greatest(a, b, c) - F.least(a, b, c)
    inside = F.when(before.isNotNull() & after.isNotNull(), middle * middle)
    return zero_unless(n >= 3, F.sum(inside).over(p) * (math.pi / (6 - 4 * math.sqrt(3) + math.pi)) * F.try_divide(n, n - 2))


def sharpe(ret, p, free, periods):
    s = F.stddev_samp(ret).over(p)
    return zero_unless(F.coalesce(s, F.lit(0.0)) > 1e-12, F.try_divide(F.avg(ret).over(p) - free / periods, s) * math.sqrt(periods))


def sortino(ret, p, free, periods):
    down = F.least(ret - free / periods, F.lit(0.0))
    d = F.sqrt(F.avg(down * down).over(p))
    return zero_unless(d > 1e-12, F.try_divide(F.avg(ret).over(p) - free / periods, d) * math.sqrt(periods))


def normal_quantile(p: float) -> float:
    """Rational approximation of the normal quantile (fixed values: its published coefficients)."""
    c, d = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
    q = min(p, 1 - p)
    t = math.sqrt(-2 * math.log(q))
    z = t - (c[0] + c[1] * t + c[2] * t * t) / (1 + d[0] * t + d[1] * t * t + d[2] * t**3)
    return -z if p < 0.5 else z


def cornish_fisher(ret, p, confidence):
    z = normal_quantile(1 - confidence)
    s, k = F.coalesce(F.skewness(ret).over(p), F.lit(0.0)), F.coalesce(F.kurtosis(ret).over(p), F.lit(0.0))
    zcf = z + s * ((z * z - 1) / 6) + k * ((z**3 - 3 * z) / 24) - s * s * ((2 * z**3 - 5 * z) / 36)
    return -(F.avg(ret).over(p) + zcf * F.stddev_pop(ret).over(p))


def almgren_chriss(row: Column, slices: int, gamma: float, eta: float, sigma: float) -> Column:
    """The share of the order in slice (row mod slices); even shares if the schedule is degenerate."""
    kappa = math.sqrt(gamma / (2 * eta * sigma * sigma)) if eta > 0 and sigma > 0 and gamma > 0 else 0.0
    whole = math.sinh(kappa)
    shares = [(math.sinh(kappa * (1 - k / slices)) - math.sinh(kappa * (1 - (k + 1) / slices))) / whole if whole > 1e-12 else 1 / slices for k in range(slices)]
    return F.get(F.array(*map(F.lit, shares)), (row % slices).cast("int"))
