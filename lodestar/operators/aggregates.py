"""Aggregates beyond the built-in ones."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys whose sums a task holds before it hands them on.
HELD_KEYS = 100_000


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation; 0 for under two rows or no variance."""
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def compensated_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, sum): partial sums are kept as exact expansions of doubles, in batches, and then rounded once a key."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, part double"

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if v is not None:
                    held.setdefault(k, []).append(v)
            for k, values in held.items():
                held[k] = _expansion(values)
            if len(held) >= HELD_KEYS:
                yield made(held, batch.schema.field(0).type)
                held = {}
            kind = batch.schema.field(0).type
        if held:
            yield made(held, kind)

    def made(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        rows = [(k, v) for k, values in held.items() for v in values]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.float64())], names=[key, "part"])

    def final(table: pa.Table) -> pa.Table:
        return pa.table({key: table[key][:1], "sum": pa.array([math.fsum(table["part"].to_pylist())], pa.float64())})

    parts = df.select(key, F.col(value).cast("double").alias("part")).mapInArrow(partial, schema)
    return parts.groupBy(key).applyInArrow(final, schema.replace("part", "sum"))


def _expansion(values: list[float]) -> list[float]:
    """A few non-overlapping doubles with the exact sum of the values."""
    parts: list[float] = []
    for x in values:
        kept = []
        for y in parts:
            if abs(x) < abs(y):
                x, y = y, x
            high = x + y
            low = y - (high - x)
            if low:
                kept.append(low)
            x = high
        parts = [*kept, x]
    return parts


def histogram(df: DataFrame, bucket: Column) -> DataFrame:
    """(b, n, inclusive, exclusive): counts by bucket and their running sums; the window sees buckets, not rows."""
    w = Window.orderBy("b")
    run = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).withColumns({"inclusive": run, "exclusive": run - F.col("n")})
