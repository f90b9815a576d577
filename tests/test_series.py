"""Recurrences and range functions against plain loops and published cases."""

import math
import time

import numpy as np
import pandas as pd
import pytest

from lodestar.functions import fintech as M
from lodestar.functions import promql as Q
from lodestar.functions import vectors as V
from lodestar.operators import joins, recursive, templates
from pyspark.sql import functions as F


def one(spark, samples, *columns):
    df = spark.createDataFrame([(t * 1000, float(v)) for t, v in samples], "t bigint, v double")
    return df.groupBy().agg(Q.samples(F.col("t"), F.col("v")).alias("s")).select(*[c.alias(f"x{i}") for i, c in enumerate(columns)]).first()


def every_five_minutes(values):
    return [(300 * i, v) for i, v in enumerate(values)]


def test_increase_and_delta(spark):
    s = F.col("s")
    full = every_five_minutes(range(0, 101, 10))
    inside = [x for x in full if x[0] > 0]
    got = one(spark, inside, Q.extrapolated(s, F.lit(0), F.lit(3_000_000), True, False))[0]
    assert abs(got - 100) < 1e-9
    got = one(spark, every_five_minutes(range(0, 201, 50)), Q.extrapolated(s, F.lit(-1), F.lit(1_200_000), False, False))[0]
    assert abs(got - 200) < 1e-3
    got = one(spark, every_five_minutes(range(200, -1, -50)), Q.extrapolated(s, F.lit(-1), F.lit(1_200_000), False, False))[0]
    assert abs(got + 200) < 1e-3


def test_irate_resets_changes(spark):
    s = F.col("s")
    r = one(spark, every_five_minutes(range(10, 101, 10)), Q.irate(s), Q.resets(s), Q.changes(s))
    assert abs(r[0] - 1 / 30) < 1e-12 and r[1] == 0 and r[2] == 9
    r = one(spark, every_five_minutes([1, 5, 2, 2, 7]), Q.irate(s), Q.resets(s), Q.changes(s), Q.mad(s), Q.quantile(s, -1), Q.quantile(s, 2))
    assert r[1] == 1 and r[2] == 3 and r[3] == 1.0 and r[4] == -math.inf and r[5] == math.inf
    r = one(spark, [(0, 3)], Q.irate(s), Q.regression(s, F.lit(0))[0], Q.extrapolated(s, F.lit(-1), F.lit(10), True, True))
    assert all(math.isnan(x) for x in r)


def test_regression_of_a_constant(spark):
    slope, value = Q.regression(F.col("s"), F.lit(600_000))
    assert tuple(one(spark, every_five_minutes([4, 4, 4]), slope, value)) == (0.0, 4.0)


def within(seconds, f, *args):
    start = time.perf_counter()
    got = f(*args)
    assert time.perf_counter() - start < seconds
    return got


def test_long_windows_in_linear_time(spark):
    """Six thousand samples: a mean or median computed again at each of them takes a minute and over."""
    s, v = F.col("s"), np.random.default_rng(3).normal(50, 9, 6000)
    got = within(15, one, spark, enumerate(v), Q.variance(s), Q.quantile(s, 0.9), Q.mad(s))
    assert np.allclose(list(got), [v.var(), np.quantile(v, 0.9), np.median(np.abs(v - np.median(v)))], rtol=1e-12)


def test_quantiles_and_variance_pass_over_missing_values(spark):
    s = F.col("s")
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0), (4, 9.0)], "t bigint, v double")
    got = df.groupBy().agg(Q.samples(F.col("t"), F.col("v")).alias("s")).select(Q.variance(s), Q.quantile(s, 0.5), Q.mad(s)).first()
    assert np.allclose(list(got), [26 / 3, 4.0, 2.0])


def test_lines_of_long_windows_in_linear_time(spark):
    s, v = F.col("s"), np.random.default_rng(4).normal(50, 9, 6000)
    slope, value = np.polyfit(np.arange(6000.0) - 6000, v, 1)
    got = within(15, one, spark, enumerate(v), *Q.regression(s, F.lit(6_000_000)))
    assert np.allclose(list(got), [slope, value], rtol=1e-9)


def test_lines_of_groups(spark):
    """The aggregates give the array's lines: of a few rows, of a constant, at one time, of a single row, with a missing value."""
    kinds = {"a": [(0, 1.0), (10, 5.0), (20, 4.0)], "b": [(0, 4.0), (10, 4.0)], "c": [(5, 1.0), (5, 2.0)], "d": [(5, 1.0)], "e": [(0, 1.0), (10, 3.0), (20, None)]}
    df = spark.createDataFrame([(k, t * 1000, v) for k, rows in kinds.items() for t, v in rows], "k string, t bigint, v double")
    got = {r[0]: (r[1], r[2]) for r in df.groupBy("k").agg(*Q.line(F.col("t"), F.col("v"), F.lit(20_000))).collect()}
    assert np.allclose(got["a"], (0.15, 29 / 6)) and got["b"] == (0.0, 4.0)
    assert np.isnan([*got["c"], *got["d"]]).all() and got["e"][0] == pytest.approx(0.2)
    arrays = df.filter("k < 'c'").groupBy("k").agg(Q.samples(F.col("t"), F.col("v")).alias("s")).select("k", *Q.regression(F.col("s"), F.lit(20_000))).collect()
    assert all(np.allclose(got[k], x) for k, *x in arrays)


def test_histogram_quantile(spark):
    def q(pairs, x):
        b = F.array(*[F.struct(F.lit(float(le)).alias("le"), F.lit(float(n)).alias("n")) for le, n in pairs])
        return spark.range(1).select(Q.histogram_quantile(b, x)).first()[0]

    assert q([(1, 10), (2, 20), (math.inf, 20)], 0.75) == 1.5
    assert q([(1, 10), (2, 8), (4, 20), (math.inf, 20)], 0.75) == 3.0  # counts that fall are held
    assert q([(1, 0), (2, 10), (math.inf, 20)], 0.9) == 2.0
    assert math.isnan(q([(1, 10), (2, 20)], 0.5)) and math.isnan(q([(1, 0), (math.inf, 0)], 0.5))


def test_exponential_forms():
    x = np.array([3.0, 5.0, 4.0, 8.0])
    want = [3.0]
    for v in x[1:]:
        want.append(0.5 * v + 0.5 * want[-1])
    assert np.allclose(recursive.ema(x, 3), want)
    line, signal, gap = recursive.macd(x, 2, 3, 2)
    assert np.allclose(gap, line - signal) and line[0] == 0
    assert recursive.risk_metrics(np.array([0.1]), 0.94)[0] == pytest.approx(0.1)


def test_rsi_without_losses():
    assert recursive.rsi(np.array([1.0, 2.0, 3.0]), 14).tolist() == [50.0, pytest.approx(100 - 100 / 101), pytest.approx(100 - 100 / 101)]


def test_cusum_restarts():
    over, under = recursive.cusum(np.array([1.0, 1.0, 1.0, -3.0]), 0.0, 1.5)
    assert over.tolist() == [1.0, 2.0, 1.0, 0.0] and under.tolist() == [0.0, 0.0, 0.0, -3.0]


def test_filters():
    x = np.array([1.0, 2.0, 3.0])
    p, m, want = 1.0, 1.0, [1.0]
    for v in x[1:]:
        p += 0.1
        k = p / (p + 1.0)
        m, p = m + k * (v - m), (1 - k) * p
        want.append(m)
    assert np.allclose(recursive.kalman(x, 0.1, 1.0), want)
    beta, spread = recursive.hedge_ratio(np.array([2.0, 4.0]), np.array([1.0, 0.0]), 0.0, 1.0)
    assert beta.tolist() == [1.5, 1.5] and spread.tolist() == [0.5, 4.0]
    cov = recursive.ew_covariance(np.array([1.0, 3.0]), np.array([2.0, 6.0]), 0.9)
    assert cov.tolist() == [0.0, pytest.approx(0.1 * 2 * 4)]


def test_series_may_be_split_anywhere(spark):
    """A series' running drawdown is the same however its rows lie in partitions."""
    rows = pd.DataFrame({"k": 1, "i": range(5), "x": [100.0, 120.0, 110.0, 130.0, 90.0]})
    df = spark.createDataFrame(rows)
    w = M.series(["k"], ["i"])
    for n in (1, 3):
        got = df.repartition(n).select("i", (F.max("x").over(M.running(w)) - F.col("x")).alias("d")).orderBy("i").collect()
        assert [r["d"] for r in got] == [0, 0, 10, 0, 40]


def test_templates():
    render = templates.compile_template
    assert render("{% for m in ms %}{{ loop.index }}:{{ m.a | trim }}{% if not loop.last %},{% endif %}{% endfor %}")({"ms": [{"a": " x "}, {"a": "y"}]}) == "1:x,2:y"
    assert render("{{ missing | default('z') }}{{ missing is defined }}{{ n + 1 }}{{ 'a' ~ n }}")({"n": 2}) == "zFalse3a2"
    assert render("{% if a and not b %}1{% elif b %}2{% else %}3{% endif %}")({"a": True, "b": True}) == "2"
    assert render("{% set x = [1, 2] %}{{ x | length }}{{ x[1] }}{{ d | tojson }}{{ 'q' | nosuch }}")({"d": {"k": 1}}) == '22{"k": 1}q'
    assert render("{# note #}{% for k, v in d | items %}{{ k }}={{ v }};{% endfor %}")({"d": {"a": 1, "b": 2}}) == "a=1;b=2;"
    for bad in ("{% if a %}", "{{ a ", "{% nosuch %}", "{{ 1 + }}"):
        if "}}" in bad or "%}" in bad:
            with pytest.raises(templates.TemplateError):
                render(bad)


def test_sampling(spark):
    logits = F.array(*[F.lit(float(x)) for x in (0, 3, 3, 1)])
    pick = lambda u, **k: spark.range(1).select(V.sample(logits, F.lit(u), **({"top_k": 4, "temperature": 1.0, "min_p": 0.0, "top_p": 1.0} | k))).first()[0]
    assert pick(0.0) == 1 and pick(0.6) == 2 and pick(0.999) == 0
    assert pick(0.999, top_k=1) == 1 and pick(0.999, top_p=0.5) == 2 and pick(0.999, min_p=0.5) == 2


def test_asof_takes_equal_times(spark):
    a = spark.createDataFrame([(1, 5), (1, 2), (2, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 3, "x"), (1, 5, "y")], "k int, t int, v string")
    got = {(r["k"], r["t"]): r["last"] for r in joins.asof_join(a, b, ["k"], "t", "v", "last").collect()}
    assert got == {(1, 5): "y", (1, 2): None, (2, 9): None}
