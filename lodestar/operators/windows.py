"""Aggregates over frames of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame(df: DataFrame, value: str, by: list[str], order: list[str], before: int | None, after: int | None) -> DataFrame:
    """Adds s, a, lo, hi, n, vs, vp, ss, sp over rows -before..after; None is unbounded; variance of one row is 0."""
    first = Window.unboundedPreceding if before is None else -before
    last = Window.unboundedFollowing if after is None else after
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(first, last)
    v, zero = F.col(value).cast("double"), F.lit(0.0)
    return df.withColumns({
        "s": F.sum(v).over(w), "a": F.avg(v).over(w), "lo": F.min(v).over(w), "hi": F.max(v).over(w), "n": F.count(v).over(w).cast("double"),
        "vs": F.coalesce(F.var_samp(v).over(w), zero), "vp": F.var_pop(v).over(w), "ss": F.coalesce(F.stddev_samp(v).over(w), zero), "sp": F.stddev_pop(v).over(w),
    })
