"""Range functions over one series' samples in a window, held as an array<struct<t, v>> by time (t in ms)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def samples(t: Column, v: Column) -> Column:
    """Aggregate: a group's samples by time. Groups are one series' window, which bounds them."""
    return F.sort_array(F.collect_list(F.struct(t.alias("t"), v.alias("v"))))


def _let(x: Column, body) -> Column:
    """body of x, computed once. What a lambda takes from outside is computed again at each element, so a mean there takes quadratic time."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _at(s, i):
    return F.element_at(s, i)


def _steps(s):
    """(before, after) of neighbours."""
    return F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.struct(a["v"].alias("a"), b["v"].alias("b")))


def _enough(s, x, n=2):
    return F.when(F.size(s) < n, F.lit(NAN)).otherwise(x)


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values):
    return F.try_divide(_sum(values), F.size(values))


def _values(s):
    return F.array_compact(F.transform(s, lambda p: p["v"]))


def extrapolated(s: Column, start, end, counter: bool, rate: bool) -> Column:
    """delta, increase or rate over (start, end]: reset correction and extrapolation to the window's ends."""
    first, last = _at(s, 1), _at(s, -1)
    change = last["v"] - first["v"]
    if counter:
        change = change + _sum(F.transform(_steps(s), lambda x: F.when(x["b"] < x["a"], x["a"]).otherwise(0.0)))
    n = F.size(s) - 1
    to_start, to_end = (first["t"] - start) / 1000, (end - last["t"]) / 1000
    span = (last["t"] - first["t"]) / 1000
    mean = F.try_divide(span, n)
    limit = mean * 1.1
    to_start = F.when(to_start >= limit, mean / 2).otherwise(to_start)
    if counter:
        zero = span * F.try_divide(first["v"], change)
        to_start = F.when((change > 0) & (first["v"] >= 0) & (zero < to_start), zero).otherwise(to_start)
    to_end = F.when(to_end >= limit, mean / 2).otherwise(to_end)
    made = change * F.try_divide(span + to_start + to_end, span)
    if rate:
        made = made / ((end - start) / 1000)
    return _enough(s, made)


def irate(s: Column, counter: bool = True) -> Column:
    a, b = F.try_element_at(s, F.lit(-2)), _at(s, -1)
    change = F.when(F.lit(counter) & (b["v"] < a["v"]), b["v"]).otherwise(b["v"] - a["v"])
    return _enough(s, F.try_divide(change, (b["t"] - a["t"]) / 1000) if counter else change)


def resets(s: Column) -> Column:
    return F.size(F.filter(_steps(s), lambda x: x["b"] < x["a"]))


def changes(s: Column) -> Column:
    return F.size(F.filter(_steps(s), lambda x: (x["a"] != x["b"]) & ~(F.isnan(x["a"]) & F.isnan(x["b"]))))


def regression(s: Column, at: Column) -> tuple[Column, Column]:
    """Slope a second and value at time `at` of the least-squares line; a constant series has slope 0."""
    x = F.transform(s, lambda p: (p["t"] - at) / 1000)
    pairs = F.zip_with(x, s, lambda a, p: F.struct(a.alias("x"), p["v"].alias("y")))

    def about(m):
        cov = _sum(F.transform(pairs, lambda p: (p["x"] - m["x"]) * (p["y"] - m["y"])))
        var = _sum(F.transform(pairs, lambda p: (p["x"] - m["x"]) * (p["x"] - m["x"])))
        return F.struct(F.coalesce(F.try_divide(cov, var), F.lit(0.0)).alias("slope"), m["x"].alias("x"), m["y"].alias("y"))

    made = _let(F.struct(_mean(x).alias("x"), _mean(F.transform(s, lambda p: p["v"])).alias("y")), about)
    return _enough(s, made["slope"]), _enough(s, made["y"] - made["slope"] * made["x"])


def line(t: Column, v: Column, at: Column) -> tuple[Column, Column]:
    """Aggregates: `regression` of a group's rows, which needs no array of them; they are partial before the exchange. As in SQL, rows
    without a value count for the mean time only, and those at one time have the slope NaN."""
    x = (t - at) / 1000
    slope = F.coalesce(F.regr_slope(v, x), F.when(F.regr_count(v, x) == 0, F.lit(0.0)).otherwise(F.lit(NAN)))
    lone = F.count("*") < 2
    return F.when(lone, F.lit(NAN)).otherwise(slope), F.when(lone, F.lit(NAN)).otherwise(F.avg(v) - slope * F.avg(x))


def variance(s: Column) -> Column:
    """Of the population."""
    v = _values(s)
    return _let(_mean(v), lambda m: _mean(F.transform(v, lambda x: (x - m) * (x - m))))


def quantile(s: Column, q: float) -> Column:
    if q < 0 or q > 1:
        return F.lit(float("-inf") if q < 0 else float("inf"))
    return _quantile(_values(s), q)


def _quantile(values: Column, q: float) -> Column:
    def of(v):
        rank = F.lit(q) * (F.size(v) - 1)
        low = F.floor(rank).cast("int")
        a, b = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
        return a + (b - a) * (rank - low)

    return _let(F.sort_array(values), of)


def mad(s: Column) -> Column:
    return _let(quantile(s, 0.5), lambda m: _quantile(F.transform(_values(s), lambda x: F.abs(x - m)), 0.5))


def histogram_quantile(buckets: Column, q: float) -> Column:
    """buckets: array<struct<le, n>> of cumulative counts by bound, bounds distinct, the last +Inf."""
    def climb(acc, b):  # counts that fall are held
        top = F.greatest(F.coalesce(F.try_element_at(acc, F.lit(-1))["n"], b["n"]), b["n"])
        return F.array_append(acc, F.struct(b["le"].alias("le"), top.alias("n")))

    steady = F.aggregate(F.array_sort(buckets), F.array().cast("array<struct<le:double,n:double>>"), climb)
    total = _at(steady, -1)["n"]
    rank = total * q
    below = F.filter(steady, lambda b: b["n"] < rank)
    i = F.size(below)
    here, before = F.get(steady, i), F.try_element_at(below, F.lit(-1))
    low, seen = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["n"], F.lit(0.0))
    inside = low + (here["le"] - low) * F.try_divide(rank - seen, here["n"] - seen)
    last_finite = F.try_element_at(steady, F.lit(-2))["le"]
    value = F.when(here["le"] == float("inf"), last_finite).when((i == 0) & (here["le"] <= 0), here["le"]).otherwise(inside)
    ok = (F.size(steady) >= 2) & (_at(steady, -1)["le"] == float("inf")) & (total > 0)
    return F.when(ok, value).otherwise(F.lit(NAN))
