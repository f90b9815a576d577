"""Protocol-buffer messages by a runtime descriptor set."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session_types import arrow_schema

#: Type numbers of descriptor.proto, with wire type and Spark type.
TYPES = {
    1: ("double", 1, "double"), 2: ("float", 5, "float"), 3: ("int64", 0, "bigint"), 4: ("uint64", 0, "decimal(20,0)"), 5: ("int32", 0, "int"), 6: ("fixed64", 1, "decimal(20,0)"), 7: ("fixed32", 5, "bigint"),
    8: ("bool", 0, "boolean"), 9: ("string", 2, "string"), 11: ("message", 2, "binary"), 12: ("bytes", 2, "binary"), 13: ("uint32", 0, "bigint"), 14: ("enum", 0, "int"), 15: ("sfixed32", 5, "int"),
    16: ("sfixed64", 1, "bigint"), 17: ("sint32", 0, "int"), 18: ("sint64", 0, "bigint"),
}
LABEL_REPEATED = 3


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("truncated varint")
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & (2**64 - 1), at
        shift += 7


def fields(raw: bytes):
    """(number, wire type, value) of each field; values of wire types 1, 2 and 5 are bytes."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(raw, at)
        elif wire in (1, 2, 5):
            size, at = (8, at) if wire == 1 else (4, at) if wire == 5 else varint(raw, at)
            if at + size > len(raw):
                raise ValueError("truncated field")
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError("groups are not read")
        yield number, wire, value


def parse_descriptor_set(raw: bytes) -> dict[str, list[tuple[int, str, int, bool]]]:
    """Messages by full name: (number, name, type, repeated) of their fields."""
    out: dict[str, list] = {}

    def message(body: bytes, scope: str) -> None:
        parts = list(fields(body))
        name = f"{scope}.{next(v for n, _, v in parts if n == 1).decode()}".lstrip(".")
        out[name] = []
        for n, _, v in parts:
            if n == 2:
                f = {k: x for k, _, x in fields(v)}
                out[name].append((f[3], f[1].decode(), f[5], f.get(4) == LABEL_REPEATED))
            elif n == 3:
                message(v, name)

    for n, _, file in fields(raw):
        if n == 1:
            parts = list(fields(file))
            package = next((v.decode() for k, _, v in parts if k == 2), "")
            for k, _, v in parts:
                if k == 4:
                    message(v, package)
    return out


def _scalar(kind: str, value):
    if kind in ("int64", "int32", "enum"):
        value = value - 2**64 if value >= 2**63 else value
        return value if kind == "int64" else (value + 2**31) % 2**32 - 2**31
    if kind == "uint32":
        return value & (2**32 - 1)
    if kind in ("sint32", "sint64"):
        return (value >> 1) ^ -(value & 1)
    if kind == "bool":
        return bool(value)
    if kind == "string":
        return value.decode()
    if kind in ("bytes", "message"):
        return value
    if kind == "uint64":
        return value
    return struct.unpack({"double": "<d", "float": "<f", "fixed64": "<Q", "fixed32": "<I", "sfixed32": "<i", "sfixed64": "<q"}[kind], value)[0]


def decode(raw: bytes, descriptor: list) -> dict:
    """A message's fields; absent ones are null, repeated ones lists (packed or not), nested messages bytes."""
    by_number = {n: (name, TYPES[t], repeated) for n, name, t, repeated in descriptor}
    out = {name: [] if repeated else None for _, name, _, repeated in descriptor}
    for number, wire, value in fields(raw):
        if number not in by_number:
            continue
        name, (kind, expected, _), repeated = by_number[number]
        if wire == 2 and expected != 2:  # packed
            at = 0
            while at < len(value):
                if expected == 0:
                    x, at = varint(value, at)
                else:
                    size = 8 if expected == 1 else 4
                    x, at = value[at : at + size], at + size
                out[name].append(_scalar(kind, x))
        elif wire != expected:
            raise ValueError(f"field {name} has wire type {wire}")
        elif repeated:
            out[name].append(_scalar(kind, value))
        else:
            out[name] = _scalar(kind, value)
    return out


def confluent(raw: bytes) -> tuple[int, list[int], bytes]:
    """Schema id, message-index path and payload of a registry-framed message."""
    if len(raw) < 6 or raw[0] != 0:
        raise ValueError("not a framed message")
    schema = int.from_bytes(raw[1:5], "big")
    zigzag = lambda x: (x >> 1) ^ -(x & 1)
    n, at = varint(raw, 5)
    path = []
    for _ in range(zigzag(n)):
        x, at = varint(raw, at)
        path.append(zigzag(x))
    return schema, path or [0], raw[at:]


def decode_rows(df: DataFrame, column: str, descriptor: list, framed: bool = False) -> DataFrame:
    ddl = ", ".join(f"`{name}` " + (f"array<{TYPES[t][2]}>" if repeated else TYPES[t][2]) for _, name, t, repeated in descriptor)
    names = arrow_schema(ddl)

    def run(batches):
        from decimal import Decimal

        wide = {name for _, name, t, _ in descriptor if TYPES[t][2].startswith("decimal")}
        for batch in batches:
            rows = [decode(confluent(v)[2] if framed else v, descriptor) for v in batch.column(0).to_pylist()]
            for r in rows:
                for name in wide:
                    r[name] = [Decimal(x) for x in r[name]] if isinstance(r[name], list) else None if r[name] is None else Decimal(r[name])
            yield pa.RecordBatch.from_pylist(rows, schema=names)

    return df.select(column).mapInArrow(run, ddl)


def put_varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def put(number: int, wire: int, value) -> bytes:
    """A field, for tests and for building descriptors; wire type 2 takes bytes."""
    key = put_varint(number << 3 | wire)
    return key + (put_varint(value) if wire == 0 else put_varint(len(value)) + value if wire == 2 else value)
