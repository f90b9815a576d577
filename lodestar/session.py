"""Session helpers: lineage cut through the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the folder that spark.checkpoint.dir names; sets one only where none is set and all runs on one machine."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share for intermediate tables."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = os.path.join(tempfile.gettempdir(), "lodestar-checkpoints")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()
