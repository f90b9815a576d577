"""Questions and answers between chunks of documents and parts of a table.

Rows are packed into compressed chunks of bounded size, which one exchange
deals out; the same exchange serves every later use. A chunk reduces what it
asks to its distinct keys (hashes in ascending order, stored as compressed
differences) and sends a blob of them to each part of the hash range. A part
merges the chunks' blobs and answers each in the order it was asked, so keys
never travel back. A frequent key is asked at most once a chunk, which is the
aggregation before the shuffle; a task holds one chunk or one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, release, small_batches, text_buffer

MESSAGE = "part int, chunk bigint, kind string, a binary, b binary, c binary"
MESSAGE_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def parts_for(df: DataFrame, text: str, bytes_each: int = 8 << 20) -> int:
    """Parts of the hash range, in proportion to the bytes of text, which are counted."""
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(16, -(-size // bytes_each))


def packed(df: DataFrame, text: str, order: str, max_bytes: int) -> DataFrame:
    """(chunk, rows): the rows of df in compressed Arrow streams, in each by `order` (nulls last).

    A chunk has up to max_bytes of text, or one longer row. Its number comes
    from the partition and the place in it.
    """

    small_batches(df.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, count
            table = pa.Table.from_batches(held)
            table = table.take(pa.compute.sort_indices(table, sort_keys=[(order, "ascending")])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as writer:
                writer.write_table(table)
            number, count, held, size = (part << 32) | count, count + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])

        import pyarrow.compute  # noqa: F401  for pa.compute

        for whole in batches:
            column = whole.schema.get_field_index(text)
            bytes_of = np.diff(text_buffer(whole.column(column))[1])
            at = 0
            while at < whole.num_rows:
                room = np.cumsum(bytes_of[at:])
                n = int(np.searchsorted(room, max_bytes - size, side="right"))
                if n == 0 and held:
                    yield flush()
                    continue
                n = max(n, 1)
                held.append(whole.slice(at, n))
                size += int(room[n - 1])
                at += n
                if size >= max_bytes:
                    yield flush()
        if held:
            yield flush()

    return df.mapInArrow(run, "chunk bigint, rows binary").repartition("chunk")


def unpacked(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's share of ascending hashes begins and ends."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(keys, edges, side="left"), [len(keys)]])


def home_part(chunk: int, parts: int) -> int:
    """The part that keeps what a chunk must hear again; chunk numbers are even in their low bits, so they are mixed."""
    return int(mix64(np.array([chunk], U64))[0] % U64(parts))


def messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in MESSAGE_ARROW]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MESSAGE_ARROW)], schema=MESSAGE_ARROW)


def ask(chunks: DataFrame, fn) -> DataFrame:
    """fn(chunk, batch) -> messages, for every chunk."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from messages(fn(chunk, unpacked(rows.as_py()))).to_batches()
                release()

    return chunks.mapInArrow(run, MESSAGE)


def answer(asked: DataFrame, fn) -> DataFrame:
    """fn(part, rows) -> messages, for every part; rows are tuples (chunk, kind, a, b, c), by chunk."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[n].to_pylist() for n in ("chunk", "kind", "a", "b", "c"))))
        rows.sort(key=lambda r: (r[0], r[1]))
        made = messages(fn(table["part"][0].as_py(), rows))
        del rows
        release()
        return made

    return asked.groupBy("part").applyInArrow(run, MESSAGE)


def told(chunks: DataFrame, answers: DataFrame, fn, schema) -> DataFrame:
    """fn(chunk, batch, rows) -> pa.Table, for every chunk with its answers (part, kind, a, b, c, *more), by part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("answers to a chunk that isn't there")
        names = [n for n in right.schema.names if n != "chunk"]
        rows = sorted(zip(*(right[n].to_pylist() for n in names)), key=lambda r: (r[0], r[1]))
        made = fn(left["chunk"][0].as_py(), unpacked(left["rows"][0].as_py()), rows)
        del rows
        release()
        return made

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
