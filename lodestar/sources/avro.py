"""Avro object containers and single datums: records of primitives, enums, fixed, arrays, maps and unions with null."""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"Obj\x01"
#: Spark types of Avro's primitives.
PRIMITIVES = {"null": "void", "boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "bytes": "binary", "string": "string"}


def read_long(b: io.BytesIO) -> int:
    shift = value = 0
    while True:
        raw = b.read(1)
        if not raw:
            raise EOFError("truncated number")
        value |= (raw[0] & 127) << shift
        if raw[0] < 128:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def write_long(n: int) -> bytes:
    z, out = (n << 1) ^ (n >> 63), bytearray()
    while z > 127:
        out.append(z & 127 | 128)
        z >>= 7
    return bytes(out) + bytes([z])


def _take(b: io.BytesIO, n: int) -> bytes:
    raw = b.read(n)
    if len(raw) != n or n < 0:
        raise EOFError("truncated value")
    return raw


def _kind(schema) -> str:
    return schema["type"] if isinstance(schema, dict) and isinstance(schema["type"], str) else "union" if isinstance(schema, list) else schema if isinstance(schema, str) else _kind(schema["type"])


def decode(schema, b: io.BytesIO):
    """One value by its schema."""
    kind = _kind(schema)
    if kind == "union":
        return decode(schema[read_long(b)], b)
    if kind == "null":
        return None
    if kind == "boolean":
        return _take(b, 1) != b"\0"
    if kind in ("int", "long"):
        return read_long(b)
    if kind == "float":
        return struct.unpack("<f", _take(b, 4))[0]
    if kind == "double":
        return struct.unpack("<d", _take(b, 8))[0]
    if kind == "bytes":
        return _take(b, read_long(b))
    if kind == "string":
        return _take(b, read_long(b)).decode()
    if kind == "fixed":
        return _take(b, schema["size"])
    if kind == "enum":
        return schema["symbols"][read_long(b)]
    if kind == "record":
        return {f["name"]: decode(f["type"], b) for f in schema["fields"]}
    if kind in ("array", "map"):
        items = []
        while n := read_long(b):
            if n < 0:
                read_long(b)  # the block's size
            for _ in range(abs(n)):
                items.append(decode(schema["items"], b) if kind == "array" else (_take(b, read_long(b)).decode(), decode(schema["values"], b)))
        return items if kind == "array" else dict(items)
    raise ValueError(f"unknown Avro type: {kind}")


def encode(schema, value) -> bytes:
    kind = _kind(schema)
    if kind == "union":
        at = next(i for i, s in enumerate(schema) if (_kind(s) == "null") == (value is None))
        return write_long(at) + encode(schema[at], value)
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\1" if value else b"\0"
    if kind in ("int", "long"):
        return write_long(value)
    if kind == "float":
        return struct.pack("<f", value)
    if kind == "double":
        return struct.pack("<d", value)
    if kind in ("bytes", "string"):
        raw = value.encode() if kind == "string" else bytes(value)
        return write_long(len(raw)) + raw
    if kind == "fixed":
        return bytes(value)
    if kind == "enum":
        return write_long(schema["symbols"].index(value))
    if kind == "record":
        return b"".join(encode(f["type"], value.get(f["name"])) for f in schema["fields"])
    if kind == "array":
        return (write_long(len(value)) + b"".join(encode(schema["items"], x) for x in value) if value else b"") + b"\0"
    if kind == "map":
        return (write_long(len(value)) + b"".join(write_long(len(k.encode())) + k.encode() + encode(schema["values"], x) for k, x in value.items()) if value else b"") + b"\0"
    raise ValueError(f"unknown Avro type: {kind}")


def _inflate(codec: str, raw: bytes) -> bytes:
    if codec == "null":
        return raw
    if codec == "deflate":
        return zlib.decompress(raw, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"unknown codec: {codec}")


def _snappy_length(raw: bytes) -> int:
    n = shift = 0
    for x in raw:
        n |= (x & 127) << shift
        if x < 128:
            return n
        shift += 7
    raise EOFError("truncated block")


def read_header(b: io.BytesIO) -> tuple[dict, str, bytes, dict]:
    """Schema, codec, sync marker and metadata."""
    if b.read(4) != MAGIC:
        raise ValueError("not an Avro container")
    meta = decode({"type": "map", "values": "bytes"}, b)
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), _take(b, 16), meta


def read_container(raw: bytes) -> tuple[dict, Iterator]:
    b = io.BytesIO(raw)
    schema, codec, sync, _ = read_header(b)

    def rows():
        while b.tell() < len(raw):
            n, size = read_long(b), read_long(b)
            block = _take(b, size)
            if _take(b, 16) != sync:
                raise ValueError("bad sync marker")
            if codec == "snappy":
                block = pa.Codec("snappy").decompress(block[:-4], decompressed_size=_snappy_length(block), asbytes=True)
            else:
                block = _inflate(codec, block)
            inner = io.BytesIO(block)
            for _ in range(n):
                yield decode(schema, inner)

    return schema, rows()


def write_container(schema: dict, rows: list, codec: str = "null", meta: dict[str, bytes] | None = None, sync: bytes | None = None, block_rows: int = 4_000) -> bytes:
    sync = sync or os.urandom(16)
    head = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode(), **(meta or {})}
    out = [MAGIC, encode({"type": "map", "values": "bytes"}, head), sync]
    for at in range(0, len(rows), block_rows):
        some = rows[at : at + block_rows]
        block = b"".join(encode(schema, r) for r in some)
        if codec == "deflate":
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            block = c.compress(block) + c.flush()
        elif codec == "zstandard":
            import zstandard

            block = zstandard.ZstdCompressor().compress(block)
        elif codec == "snappy":
            block = pa.Codec("snappy").compress(block, asbytes=True) + zlib.crc32(block).to_bytes(4, "big")
        out += [write_long(len(some)), write_long(len(block)), block, sync]
    return b"".join(out)


def spark_type(schema) -> str:
    kind = _kind(schema)
    if kind == "union":
        return spark_type(next((s for s in schema if _kind(s) != "null"), "null"))
    if kind == "record":
        return "struct<" + ",".join(f"`{f['name']}`:{spark_type(f['type'])}" for f in schema["fields"]) + ">"
    if kind == "array":
        return f"array<{spark_type(schema['items'])}>"
    if kind == "map":
        return f"map<string,{spark_type(schema['values'])}>"
    return {"enum": "string", "fixed": "binary"}.get(kind) or PRIMITIVES[kind]


def read(spark: SparkSession, path: str) -> DataFrame:
    """All containers under a path, by the schema of the first. A file is one task's."""
    from ..session_types import arrow_schema

    files = spark.read.format("binaryFile").load(path)
    schema, _ = read_container(bytes(files.select("content").first()[0]))
    ddl = ", ".join(f"`{f['name']}` {spark_type(f['type'])}" for f in schema["fields"])
    names = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                held = []
                for row in read_container(content.as_buffer().to_pybytes())[1]:
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=names)

    return files.select("content").mapInArrow(run, ddl)


def containers(df: DataFrame, schema: dict, codec: str = "null") -> DataFrame:
    """(content): one container for each batch of rows."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([write_container(schema, batch.to_pylist(), codec)], pa.binary())], names=["content"])

    return df.mapInArrow(run, "content binary")


def decode_rows(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """Rows of bare datums (as from a schema registry) in a binary column."""
    from ..session_types import arrow_schema

    ddl = ", ".join(f"`{f['name']}` {spark_type(f['type'])}" for f in schema["fields"])
    names = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([decode(schema, io.BytesIO(v)) for v in batch.column(0).to_pylist()], schema=names)

    return df.select(column).mapInArrow(run, ddl)
