"""Recurrences along a series, which no window can express: one pandas pass a key.

Each function takes numpy arrays of one series in order and returns arrays of
the same length. `apply` runs any of them by key, in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ewm(x, alpha: float, first=None):
    """y[0] = x[0] (or first), y[i] = alpha x[i] + (1 - alpha) y[i - 1]."""
    out = np.empty(len(x))
    y = None
    for i, v in enumerate(x):
        y = (v if first is None else first) if y is None else alpha * v + (1 - alpha) * y
        out[i] = y
    return out


def ema(x, period: int):
    return ewm(x, 2 / (period + 1))


def macd(x, fast: int, slow: int, signal: int):
    line = ema(x, fast) - ema(x, slow)
    s = ema(line, signal)
    return line, s, line - s


def risk_metrics(r, decay: float):
    return np.sqrt(ewm(np.asarray(r) ** 2, 1 - decay))


def ew_covariance(x, y, decay: float):
    mx, my, cov, out = 0.0, 0.0, 0.0, np.zeros(len(x))
    for i, (a, b) in enumerate(zip(x, y)):
        if i == 0:
            mx, my = a, b
            continue
        dx, dy = a - mx, b - my
        cov = decay * cov + (1 - decay) * dx * dy
        mx, my = decay * mx + (1 - decay) * a, decay * my + (1 - decay) * b
        out[i] = cov
    return out


def rsi(x, period: int):
    """Wilder's index; 50 on the first row, ratio 100 without losses."""
    out, gain, loss, a = np.full(len(x), 50.0), 0.0, 0.0, 1 / period
    for i in range(1, len(x)):
        d = x[i] - x[i - 1]
        up, down = max(d, 0.0), max(-d, 0.0)
        gain, loss = (up, down) if i == 1 else (a * up + (1 - a) * gain, a * down + (1 - a) * loss)
        ratio = gain / loss if loss > 0 else 100.0
        out[i] = 100 - 100 / (1 + ratio)
    return out


def cusum(x, target: float, limit: float):
    """Sums of excess over and under a target; both restart after one passes the limit, which is emitted first."""
    over, under = np.zeros(len(x)), np.zeros(len(x))
    high = low = 0.0
    for i, v in enumerate(x):
        high, low = max(0.0, high + (v - target)), min(0.0, low + (v - target))
        over[i], under[i] = high, low
        if max(high, -low) > limit:
            high = low = 0.0
    return over, under


def kalman(x, process: float, noise: float):
    """A scalar filter seeded with the first observation."""
    out, m, p = np.empty(len(x)), None, 1.0
    for i, v in enumerate(x):
        if m is None:
            m = v
        else:
            p += process
            gain = p / (p + noise)
            m, p = m + gain * (v - m), (1 - gain) * p
        out[i] = m
    return out


def hedge_ratio(a, b, process: float, noise: float, beta: float = 1.0, p: float = 1.0):
    """A scalar filter over the ratio of two prices, and the spread by it; a zero b observes the ratio so far."""
    betas = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        seen = x / y if abs(y) > 1e-15 else beta
        gain = (p + process) / (p + process + noise)
        beta, p = beta + gain * (seen - beta), (1 - gain) * (p + process)
        betas[i] = beta
    return betas, np.asarray(a) - betas * np.asarray(b)


def apply(df: DataFrame, by: list[str], order: list[str], made: dict[str, str], fn) -> DataFrame:
    """Adds columns {name: type} that fn(pandas frame, in order) returns as a dict of arrays.

    A series is one task's: give a key. Nulls in the order come first.
    """
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in made.items())).fields)
    names = [f.name for f in schema]

    def run(frame):
        frame = frame.sort_values(order, kind="stable", na_position="first").reset_index(drop=True)
        return frame.assign(**fn(frame))[names]

    return df.groupBy(*by).applyInPandas(run, schema)
