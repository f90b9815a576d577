"""Near-duplicate documents by SimHash and anchor-point covering.

Fingerprints are 64 bits wide and link at a Hamming distance of THRESHOLD or
less. The bits are three blocks of 21, 21 and 22; of two fingerprints at
distance 5 or less one block differs in at most one bit. In each block the
anchors are the words of a covering code: the [15, 11] Hamming code (covering
radius one) on fifteen bits, and every value of the other six or seven. A
fingerprint is at home at the anchor within the covering radius, and is
replicated to every anchor within covering radius plus the block's threshold of
one, 14 or 15 a block. Wherever a block differs in at most one bit, one of the
two meets the other at its home anchor; there whole fingerprints are compared.

Equal fingerprints are one node, so copies cost nothing after the first
aggregation, and from each anchor only a spanning forest of the links comes
back, never all pairs. Components then follow by stars (components.py).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, arrow_schema, checkpoint, free_name, release, slices, small_batches
from .components import components, forest

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: First bit and width of each block; fifteen bits are coded, the others verbatim.
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODED = 15
#: Pairs compared at once, and rows held before whole anchors are compared.
TILE, ROWS = 2_000_000, 200_000
#: Fingerprints at home at an anchor beyond which it is split.
HOT = 20_000
KEYED = "anchor int, fp bigint, node bigint, home boolean"
PRINTS = "doc_id bigint, text_hash bigint, fp bigint"

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if over half of the shingles' XXH64 have it; no words: zero."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z, and runs of space and 0x09-0x0D
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), U64, n).view(np.uint8).reshape(n, 8)
    if n < 128:
        ones = np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(h[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`"))


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, fp) of each row, fp as a signed 64-bit number; null text: like an empty one."""
    names = arrow_schema(PRINTS)

    small_batches(df.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)], U64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], schema=names)

    rows = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), text_hash(text).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, PRINTS)


_PARITY = np.zeros(1 << CODED, np.int32)
for _i in range(CODED):
    _PARITY ^= np.where((np.arange(1 << CODED) >> _i) & 1, _i + 1, 0).astype(np.int32)
#: For each syndrome but zero, the seven pairs of bits whose flip leads to a code word.
_PAIRS = [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 16) if i < (i ^ s)] for s in range(1, 16)]
_FLIP2 = np.array([[0] * 7, *_PAIRS], np.int64)


def anchors(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, anchor numbers, whether home) for fingerprints in every block."""
    out, everything = [], np.arange(len(fp))
    for b, (low, width) in enumerate(BLOCKS):
        x = ((fp >> U64(low)) & U64((1 << width) - 1)).astype(np.int64)
        coded, plain = x & ((1 << CODED) - 1), x >> CODED
        s = _PARITY[coded]
        home = np.where(s > 0, coded ^ (1 << np.maximum(s - 1, 0)), coded)
        number = lambda c, p, b=b: (b << 22) | (p << CODED) | c
        out.append((everything, number(home, plain), True))
        for v in range(width - CODED):
            out.append((everything, number(home, plain ^ (1 << v)), False))
        off = np.flatnonzero(s > 0)
        for k in range(7):
            out.append((off, number(coded[off] ^ _FLIP2[s[off], k], plain[off]), False))
    return out


def keyed(nodes: DataFrame, home_only: bool = False) -> DataFrame:
    """Replicates (fp, node) to its anchors, or to its home anchors only."""
    names = arrow_schema(KEYED)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                fp, node = (whole.column(i).slice(at, 20_000).to_numpy(zero_copy_only=False) for i in (0, 1))
                for rows, anchor, home in anchors(fp.view(U64)):
                    if home_only and not home:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[rows]), pa.array(node[rows]), pa.array(np.full(len(rows), home))], schema=names)

    return nodes.select("fp", "node").mapInArrow(run, KEYED)


def linked(anchor: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray, threshold: int):
    """Forests of the links between each anchor's rows and those at home there; anchors ascend."""
    homes = np.flatnonzero(home)
    low, high = (np.searchsorted(anchor[homes], anchor, side=side) for side in ("left", "right"))
    n = high - low
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TILE, side="right")))
        some = n[at:to]
        a = np.repeat(np.arange(at, to), some)
        if len(a):
            b = homes[np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[at:to], some)]
            ok = (np.bitwise_count(fp[a] ^ fp[b]) <= threshold) & (node[a] != node[b])
            if ok.any():
                yield forest(node[a[ok]], node[b[ok]])
        at = to


def tiled(nodes: DataFrame) -> DataFrame:
    """Rows at their anchors, with tile: an anchor with over HOT fingerprints at home is dealt out by them, and met in each tile by all of its rows.

    Each pair that the whole anchor would compare is compared in one tile.
    Where no anchor is that large, none is split and no row moves for it.
    """
    size = keyed(nodes, home_only=True).groupBy(F.col("anchor").alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    size = checkpoint(size)
    if size.isEmpty():
        return keyed(nodes).withColumn("tile", F.lit(0))
    tiles = F.coalesce(F.ceil(F.col("n") / HOT), F.lit(1)).cast("int")
    rows = keyed(nodes).join(size, F.col("anchor") == F.col("hot"), "left").select("anchor", "fp", "node", "home", tiles.alias("tiles"))
    rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")) == F.col("tile")
    return rows.select("anchor", "fp", "node", (F.col("home") & own).alias("home"), "tile")


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (u, v) that connect nodes as all links within the threshold do."""
    if not 0 <= threshold < 2 * len(BLOCKS):
        raise ValueError("the three blocks cover thresholds of up to 5")
    names = arrow_schema("u bigint, v bigint")

    def run(batches):
        held, count = [], 0

        def compare(rows: list[pa.RecordBatch], last: bool):
            table = pa.Table.from_batches(rows)
            anchor = table["tile"].to_numpy().astype(np.int64) << 32 | table["anchor"].to_numpy()  # ascending, as sorted below
            stop = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1], side="left"))
            part = table.slice(0, stop)
            found = linked(anchor[:stop], part["fp"].to_numpy().view(U64), part["node"].to_numpy(), part["home"].to_numpy(), threshold)
            out = [pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=names) for u, v in found]
            return out, table.slice(stop).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= ROWS:
                out, held = compare(held, False)
                kept = sum(b.num_rows for b in held)
                count = 0 if kept < ROWS else -kept  # a large anchor grows on before the next try
                yield from out
        if held:
            yield from compare(held, True)[0]
        release()

    return tiled(nodes).repartition("tile", "anchor").sortWithinPartitions("tile", "anchor").mapInArrow(run, "u bigint, v bigint")


def linked_prints(made: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root, least) of each distinct fingerprint: root is its component's smallest fingerprint, least the first of its own rows by id, none last, then text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    known = checkpoint(made.groupBy("fp").agg(first.alias("least")))
    found = components(links(known.select("fp", F.col("fp").alias("node")), threshold))
    return known.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) for each row.

    component_id is the smallest doc_id that links reach. Null and wordless
    texts have fingerprint zero and link like others. Rows without an id take
    part; a component of such rows only has a null component_id. Texts alone
    link: rows that share an id, or have none, are not linked for that, so
    unlinked components may have the same component_id if ids repeat. Other
    columns are not read; an empty table gives no rows.
    """
    made = checkpoint(fingerprints(df, text, doc_id))
    prints = checkpoint(linked_prints(made, threshold))
    label = prints.groupBy(F.col("root").alias("r")).agg(F.min("least")["doc_id"].alias("component_id"))
    by_fp = prints.join(label, F.col("root") == F.col("r")).select(F.col("fp").alias("k"), "component_id")
    return made.join(by_fp, F.col("fp") == F.col("k")).select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, that of the smallest id (of several with this id: by the text's hash), none last.

    The columns of df, unchanged. Components are of fingerprints, so unlinked texts stay whatever their ids.
    """
    made = checkpoint(fingerprints(df, text, doc_id))
    least = linked_prints(made, threshold).groupBy("root").agg(F.min("least").alias("least"))
    key, hashed, rank, keep_id, keep_hash = (free_name(df, n) for n in ("row_key", "row_hash", "row_rank", "keep_id", "keep_hash"))
    keep = least.select(F.col("least.doc_id").alias(keep_id), F.col("least.text_hash").alias(keep_hash))
    rows = df.withColumn(key, F.col(f"`{doc_id}`").cast("bigint")).withColumn(hashed, text_hash(text))
    rows = rows.join(keep, F.col(key).eqNullSafe(F.col(keep_id)) & (F.col(hashed) == F.col(keep_hash)), "left_semi")
    first = Window.partitionBy(key, hashed, f"`{text}`").orderBy(hashed)  # copies with the same id
    return rows.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).drop(key, hashed, rank)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
