"""Shared pieces of the training-data operators.

Words are runs of bytes other than space and 0x09-0x0D; since UTF-8 never
uses those bytes inside a multi-byte character, all word work happens on raw
Arrow buffers, a batch of documents at a time.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def exact(raw: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ones of byte strings that lie end to end, in order of first use, and which of them each is; by their bytes."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    made = whole.dictionary_encode()
    return made.dictionary, made.indices.to_numpy().astype(np.int32)


def xxh(strings: pa.Array) -> np.ndarray:
    """The 64-bit XXH3 of each byte string."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings.to_pylist()), U64, len(strings))


def run_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n consecutive ids, the same for equal runs alone: pairs are ranked, then pairs of pairs."""
    if n > len(ids):
        return np.zeros(0, np.int64)
    at, done, out, size, rest = ids.astype(np.int64), 1, None, 0, n

    def rank(left, right):
        return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]

    while rest:
        if rest & 1:
            if out is None:
                out, size = at, done
            else:
                k = len(ids) - size - done + 1
                out, size = rank(out[:k], at[size : size + k]), size + done
        rest >>= 1
        if rest:
            k = len(at) - done
            at, done = rank(at[:k], at[done : done + k]), done * 2
    return out


class Words:
    """The words of a batch of texts: byte spans, and which text each is of."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.offsets = offsets
        self.buf = _LOWER[buf] if lower else buf
        n = len(buf)
        if n == 0:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        else:
            word = ~_IS_SPACE[buf]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            cuts = offsets[(offsets > 0) & (offsets < n)]
            first[cuts] = word[cuts]
            last[cuts - 1] = word[cuts - 1]
            self.start = np.flatnonzero(first)
            self.end = np.flatnonzero(last) + 1
        # word range of each text
        self.bounds = np.searchsorted(self.start, offsets, side="left")
        self.count = np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """Index of the text that each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def encoded(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, in order of first use, and which of them each word is; words are compared by their bytes."""
        return exact(self.buf[~_IS_SPACE[self.buf]], self.end - self.start)

    def hashes(self) -> np.ndarray:
        """The 64-bit XXH3 of each word's bytes."""
        distinct, which = self.encoded()
        return xxh(distinct)[which]

    def joined(self, keep: np.ndarray | None = None) -> list[bytes]:
        """Each text's (kept) words, joined by one space."""
        buf, out = self.buf.tobytes(), []
        start, end, bounds = self.start.tolist(), self.end.tolist(), self.bounds.tolist()
        for a, b in zip(bounds, bounds[1:]):
            if keep is None:
                out.append(b" ".join([buf[start[i] : end[i]] for i in range(a, b)]))
            else:
                out.append(b" ".join([buf[start[i] : end[i]] for i in (a + np.flatnonzero(keep[a:b])).tolist()]))
        return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, by doubling."""
    m = 0xD6E8FEB86659FD93
    if n > len(h):
        return np.zeros(0, dtype=U64)
    out, size, at, done = None, 0, h, 1
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, size = at, done
            else:
                k = len(h) - size - done + 1
                out = out[:k] + U64(pow(m, size, 1 << 64)) * at[size : size + k]
                size += done
        rest >>= 1
        if rest:
            k = len(at) - done
            at = at[:k] + U64(pow(m, done, 1 << 64)) * at[done : done + k]
            done *= 2
    return mix64(out)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about max_bytes of text; a longer text stands alone."""
    i = batch.schema.get_field_index(column)
    size = np.cumsum(np.diff(text_buffer(batch.column(i))[1])) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives a worker's freed memory back, so that what one stage used does not add to the next one's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Smaller Arrow batches, as rows of text are long, unless the session has its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return to_arrow_schema(schema)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, however its names are cased."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leaves the shared folder that the session names; sets one only where none is and all runs on one machine."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = os.path.join(tempfile.gettempdir(), "lodestar-checkpoints")  # one machine
        spark.sparkContext.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as zstd-compressed byte planes of their differences."""
    import zstandard

    d = np.diff(values, prepend=U64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=U64)


def pack_bytes(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack_bytes(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def pack_ints(values: np.ndarray) -> bytes:
    """Integers or floats of one width as zstd-compressed byte planes."""
    import zstandard

    w = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, w).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()
