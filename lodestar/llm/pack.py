"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Bulk-synchronous best fit. Pieces are range-sorted by length and dealt to lanes
by their rank in a range, so each lane has a like share of every length. Rounds
go through bands of lengths, the longest first. In a round the gaps that could
hold a piece of the band are range-sorted by what is free and dealt to lanes
the same way; every lane sweeps its pieces, the longest first, and gives each
the successor of its length among the lane's gaps (the least gap that holds
it), updating the gap, or opens a sequence. Two pieces never claim one gap:
between lanes the rank decides whose a gap is, and within a lane equal pieces
take equal gaps by rank. The gaps that are left meet again in the next round.

A lane has about LANE_ROWS pieces, whatever the size of the input; nothing but
their number comes to the driver. With one lane the result is that of plain
best fit, longest first; each further lane may leave a sequence a round that
plain best fit would have filled.
"""

from __future__ import annotations

import bisect
import zlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder
from .common import arrow_schema, checkpoint, slices, small_batches

CAPACITY = 2048
#: Pieces of a lane, about.
LANE_ROWS = 4_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, number bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, free bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """The pieces of n tokens as (start, length); only longer documents are cut, the first piece takes the rest."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    return ([(0, rest)] if rest else []) + [(s, capacity) for s in range(rest, n, capacity)]


def pieces(df: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each piece, numbered without repeats."""
    names = arrow_schema(PIECES)

    small_batches(df.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        number, bpe = TaskContext.get().partitionId() << 40, coder(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                rows = []
                ids = bpe.encode_batch(["" if t is None else t for t in batch.column(1).to_pylist()])
                for doc, raw in zip(batch.column(0).to_pylist(), ids):
                    raw = raw.tobytes() + b"\0\0\0\0"  # little-endian
                    for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                        rows.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), number))
                        number += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)
        bpe.forget()

    return df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, PIECES)


def best_fit(runs: dict[int, int], capacity: int, free: np.ndarray | None = None):
    """Moves of best fit over runs of equal lengths, the longest first, the number of sequences, and the gaps left.

    free: what is free in sequences there are, ascending; new ones are numbered
    after them. A move (length, from, to, each, sequence, offset) puts the
    pieces of a run with ranks from..to-1 into sequences from `sequence` on,
    `each` to a sequence, the first at `offset` in it. Gaps left: what is free,
    to intervals of sequences.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: intervals of sequences
    order: list[int] = []  # gap sizes in use, ascending
    moves, sequences = [], 0

    def put(gap: int, first: int, last: int) -> None:
        if gap > 0 and last > first:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, last))

    if free is not None and len(free):
        edge = np.flatnonzero(np.diff(free, prepend=free[0] - 1, append=free[-1] + 1)).tolist()
        for a, b in zip(edge, edge[1:]):
            put(int(free[a]), a, b)
        sequences = len(free)
    for length in sorted(runs, reverse=True):
        at, count = 0, runs[length]
        while at < count:
            k = bisect.bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                first, last = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            else:
                gap, first = capacity, sequences
                last = sequences = first + -(-(count - at) // (capacity // length))
            each = gap // length
            n = min(count - at, (last - first) * each)
            full, rest = divmod(n, each)
            moves.append((length, at, at + n, each, first, capacity - gap))
            at += n
            put(gap - each * length, first, first + full)
            if rest:
                put(gap - rest * length, first + full, first + full + 1)
            put(gap, first + full + bool(rest), last)
    return moves, sequences, gaps


def bands(capacity: int) -> list[tuple[int, int]]:
    """Lengths over the first and up to the second of each pair, the longest first."""
    edges = [capacity, capacity // 2]
    while edges[-1] > 64:
        edges.append(edges[-1] // 4)
    return list(zip([*edges[1:], 0], edges))


def dealt(df: DataFrame, size: str, tie: str, lanes: int) -> DataFrame:
    """df range-sorted by size, with the lane that a row's rank in its range gives it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, F.col(size).desc(), tie).sortWithinPartitions(F.col(size).desc(), tie)
    rank = F.monotonically_increasing_id()
    spread = F.xxhash64(F.shiftright(rank, 33))  # ranges begin at different lanes
    return rows.withColumn("lane", F.pmod(spread + rank.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(lanes).cast("bigint")))


def _sweep(pieces_: pa.Table, gaps: pa.Table, number: int, capacity: int, names: pa.Schema) -> pa.Table:
    """A lane's round: its pieces placed (with free null), and the gaps left (with doc_id, piece and so on null)."""
    if gaps.num_rows:
        gaps = gaps.sort_by([("free", "ascending"), ("sequence_id", "ascending")])
    free, old = gaps["free"].to_numpy(), gaps["sequence_id"].to_numpy()
    pieces_ = pieces_.sort_by([("length", "ascending"), ("number", "ascending")])
    length = pieces_["length"].to_numpy()
    sizes, first, count = np.unique(length, return_index=True, return_counts=True)
    moves, n, left = best_fit(dict(zip(sizes.tolist(), count.tolist())), capacity, free)
    lane = int((pieces_ if pieces_.num_rows else gaps)["lane"][0].as_py())
    ids = np.concatenate([old.astype(np.int64), (number << 56 | lane << 32) + np.arange(n - len(old), dtype=np.int64)])
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    start = dict(zip(sizes.tolist(), first.tolist()))
    for size, a, b, each, s, o in moves:
        k = np.arange(b - a)
        sequence[start[size] + a : start[size] + b] = ids[s + k // each]
        offset[start[size] + a : start[size] + b] = o + k % each * size
    placed = [*(pieces_[c] for c in names.names[:5]), pa.array(sequence), pa.array(offset), pa.nulls(len(length), pa.int64())]
    rest = [(ids[a:b], np.full(b - a, gap, np.int64)) for gap, intervals in left.items() for a, b in intervals]
    who, gap = (np.concatenate([r[i] for r in rest]) if rest else np.zeros(0, np.int64) for i in (0, 1))
    kept = [*(pa.nulls(len(who), f.type) for f in list(names)[:5]), pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(gap)]
    return pa.concat_tables([pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, names)], schema=names) for columns in (placed, kept)])


def pack(df: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", lane_rows: int = LANE_ROWS) -> DataFrame:
    """Packs documents (token ids, then id 0) into sequences of at most `capacity` tokens.

    Null text: like an empty one, one token. Null ids and repeated rows are
    packed like any others. Columns besides id and text are not read. An empty
    table gives no rows.
    """
    made = checkpoint(pieces(df, path, pattern, capacity, text, doc_id))  # sequences of one sampling of ranges
    lanes = max(1, -(-made.count() // lane_rows))
    made = checkpoint(dealt(made, "length", "number", lanes))
    held, placed = None, []  # gaps, and what has its place
    for number, (low, high) in enumerate(bands(capacity)):
        mine = made.filter((F.col("length") > low) & (F.col("length") <= high))
        if held is None:
            gaps = made.limit(0).select("number", F.col("length").alias("free"), "lane").withColumnRenamed("number", "sequence_id")
        else:
            gaps = dealt(held.filter(F.col("free") > low), "free", "sequence_id", lanes)
        swept = mine.groupBy("lane").cogroup(gaps.groupBy("lane")).applyInArrow(partial(_sweep, number=number, capacity=capacity, names=arrow_schema(PLACED)), PLACED)
        swept = checkpoint(swept)
        placed.append(swept.filter("free IS NULL").drop("free"))
        left = swept.filter("free IS NOT NULL").select("sequence_id", "free")
        held = left if held is None else left.unionAll(held.filter(F.col("free") <= low))
    return reduce(DataFrame.unionAll, placed)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
