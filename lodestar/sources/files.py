"""CSV, JSON lines and Parquet, and batches as self-describing binary values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = ("gzip", "lz4", "zstd", "snappy")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False, tenths: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Rows by a declared schema; columns in `tenths` are whole tenths of the number in the file.

    strict: a field that does not parse fails the load, otherwise it is null.
    No quotes or escapes are known.
    """
    declared = T._parse_datatype_string(schema)
    raw = T.StructType([T.StructField(f.name, T.DecimalType(18, 1) if f.name in tenths else f.dataType) for f in declared])
    options = {"sep": sep, "header": str(header).lower(), "mode": "FAILFAST" if strict else "PERMISSIVE", "quote": "", "nullValue": ""}
    rows = spark.read.schema(raw).options(**options).csv(path)
    return rows.select(*[(F.col(f.name) * 10).cast("int").alias(f.name) if f.name in tenths else F.col(f.name) for f in declared])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").options(sep=sep, quote="", nullValue="", emptyValue="").csv(path)


def read_ndjson(spark: SparkSession, path: str, schema: str, ignore_errors: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; bad lines fail the load, or are counted apart with ignore_errors (skipped_lines)."""
    if not ignore_errors:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _permissive(spark, path, schema).filter("_corrupt_record IS NULL").drop("_corrupt_record")


def skipped_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row, n: the lines that read_ndjson leaves out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", T._parse_datatype_string(schema + ", _corrupt_record string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(parsed.alias("x")).agg(F.count_if(F.col("x._corrupt_record").isNotNull()).alias("n"))


def _permissive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", T._parse_datatype_string(schema + ", _corrupt_record string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(parsed.alias("x")).select("x.*")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", max_rows: int = 0, bloom: tuple[str, ...] = (), partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", compression)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def column_range(df: DataFrame, column: str) -> DataFrame:
    """(lo, hi, nulls) of a column; with aggregate push-down Spark takes the ends from Parquet footers."""
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_if(F.col(column).isNull()).alias("nulls"))


def to_wire(df: DataFrame, codec: str | None = None) -> DataFrame:
    """(batch): Arrow streams that carry their own schema, one a batch of rows."""
    def run(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    return df.mapInArrow(run, "batch binary")


def from_wire(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                yield from pa.ipc.open_stream(value.as_buffer()).read_all().to_batches()

    return df.select("batch").mapInArrow(run, schema)


def compressed(column, codec: str):
    """A binary column, compressed; its length must be kept to undo it (see decompressed)."""
    def run(values):
        return values.map(lambda x: None if x is None else pa.Codec(codec).compress(x, asbytes=True))

    return F.pandas_udf(run, "binary")(column)


def decompressed(column, codec: str, length):
    def run(values, sizes):
        made = [None if x is None else pa.Codec(codec).decompress(x, decompressed_size=int(n), asbytes=True) for x, n in zip(values, sizes)]
        return values.__class__(made)

    return F.pandas_udf(run, "binary")(column, length)
