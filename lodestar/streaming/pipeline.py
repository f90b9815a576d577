"""A chain of stages over micro-batches, windows with watermarks, and state by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Stages over a stream, then a sink. Stages are lazy plans; a stage that filters drops rows."""

    def __init__(self, source: DataFrame):
        self.frame = source

    def stage(self, fn: Stage) -> Pipeline:
        self.frame = fn(self.frame)
        return self

    def run(self, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, table: str | None = None, mode: str = "append"):
        """Runs all that is there, then stops; into a memory table or a function of batches."""
        writer = self.frame.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
        query = writer.foreachBatch(sink).start() if sink is not None else writer.format("memory").queryName(table).start()
        query.awaitTermination()
        return query


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the number of files a trigger bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(df: DataFrame, time: str, late: str, size: str, slide: str | None, by: list[str], *aggregates) -> DataFrame:
    """Tumbling or sliding windows; rows later than the watermark are dropped in append mode."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, late).groupBy(w, *by).agg(*aggregates)


def sessions(df: DataFrame, time: str, late: str, gap: str, by: list[str], *aggregates) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(*aggregates)


def ema_by_key(df: DataFrame, key: str, order: list[str], value: str, alpha: float, key_type: str = "bigint", carry: list[str] | None = None) -> DataFrame:
    """The exponential average of each key's values, whose state lives on between micro-batches.

    Rows of a key within a micro-batch go by `order`; later micro-batches follow earlier ones.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    carry = carry or []
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"{key} {key_type}, {kinds + ', ' if kinds else ''}ema double"

    def step(group, frames, state):
        y = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for v in rows[value]:
            y = float(v) if y is None else alpha * float(v) + (1 - alpha) * y
            out.append(y)
        if y is not None:
            state.update((y,))
        made = rows[[key, *carry]].copy()
        made["ema"] = out
        yield made

    return df.groupBy(key).applyInPandasWithState(step, schema, "y double", "append", GroupStateTimeout.NoTimeout)
