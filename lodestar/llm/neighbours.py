"""Approximate nearest neighbours by collision counting.

One projection orders the whole table: rows are range-sorted by it and cut into
blocks, each an interval of the line; equal values are cut by id, so a vector
that very many rows share fills blocks like any other. A block projects its
vectors on PROJECTIONS random lines and keeps one sorted array a line. A query
looks at the same window around its own projection on every line; a vector
collides once for each line whose window holds it. Windows grow by a factor
(virtual rehashing: the arrays stay as they are, only their ends move outwards),
new entries alone are counted, and vectors with enough collisions are verified
by exact distance.

A query starts in the block that holds it, and stops there when it has enough
verified neighbours well inside the window. The distance of its last neighbour
then bounds its window on the ordering line, since no projection on a line of
unit length lengthens a distance: it is routed only to blocks whose interval
meets that window, where its windows end at the same distance. The best of all
blocks meet in one ranking a query.

Every row is indexed. Fitted are the ordering line, the direction of most
spread of at most SAMPLE rows, and the unit of width, a block's spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, checkpoint

NEIGHBOURS = 10
PROJECTIONS = 48
#: Share of the lines on which a vector must collide to be verified.
COLLIDE = 0.6
#: A query is done when its k-th best is nearer than this share of the half window.
INSIDE = 0.9
#: First half window in units of the projections' spread, and its growth.
FIRST, GROWTH = 0.25, 1.4
BLOCK_ROWS, QUERY_ROWS = 8_192, 4_096
#: Rows that the ordering line is fitted on, at most.
SAMPLE = 2_000
ASKED = "vec_id bigint, v array<double>, dim int, spread double, radius double, block int"
FOUND = "query_id bigint, vec_id bigint, score double"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Block:
    """The sorted arrays of one block of vectors of the same dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        at = vectors @ self.lines
        self.order = np.argsort(at, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(at, self.order.T, axis=0).T)
        spread = float(at.std(axis=0).mean())
        self.unit = spread if spread > 0 else 1.0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, radius: np.ndarray, k: int):
        """(query, id, distance) of each query's k nearest found within its radius."""
        n, need = len(self.ids), int(np.ceil(COLLIDE * PROJECTIONS))
        centre = queries @ self.lines
        todo, half = np.arange(len(queries)), FIRST * self.unit
        low = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre.T)]).T
        high = low.copy()
        hits = np.zeros((len(queries), n), np.uint8)
        scores = [np.zeros(0)] * len(queries)
        rows = [np.zeros(0, np.int64)] * len(queries)
        while len(todo):
            to_low = np.array([np.searchsorted(s, c - half, side="left") for s, c in zip(self.sorted, centre[todo].T)]).T
            to_high = np.array([np.searchsorted(s, c + half, side="right") for s, c in zip(self.sorted, centre[todo].T)]).T
            left = []
            for i, q in enumerate(todo.tolist()):
                entries = [o[a:b] for o, a, b in zip(self.order, to_low[i].tolist(), low[q].tolist())]
                entries += [o[a:b] for o, a, b in zip(self.order, high[q].tolist(), to_high[i].tolist())]
                low[q], high[q] = np.minimum(to_low[i], low[q]), np.maximum(to_high[i], high[q])
                before = hits[q] >= need
                hits[q] += np.bincount(np.concatenate(entries), minlength=n).astype(np.uint8)
                new = np.flatnonzero((hits[q] >= need) & ~before & (self.ids != query_ids[q]))
                if len(new):
                    d = np.sqrt(((self.vectors[new] - queries[q]) ** 2).sum(axis=1))
                    near = d <= radius[q]
                    s, r = np.concatenate([scores[q], d[near]]), np.concatenate([rows[q], new[near]])
                    best = np.lexsort((self.ids[r], s))[:k]
                    scores[q], rows[q] = s[best], r[best]
                whole = bool((low[q] == 0).all() and (high[q] == n).all())
                last = min(scores[q][-1] if len(rows[q]) >= k else np.inf, radius[q])
                if not whole and last > INSIDE * half:
                    left.append(q)
            todo, half = np.array(left, np.int64), half * GROWTH
        size = [len(r) for r in rows]
        return np.repeat(query_ids, size), self.ids[np.concatenate(rows).astype(np.int64)] if size else np.zeros(0, np.int64), np.concatenate(scores) if size else np.zeros(0)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, v array<double>."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = table["v"].combine_chunks()
    return table["vec_id"].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def ordering_line(rows: DataFrame, sample: int = SAMPLE) -> list[float]:
    """The direction of most spread of at most `sample` rows, of their commonest dimension; unit length."""
    some = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()]
    if not some:
        return [1.0]
    sizes, count = np.unique([len(v) for v in some], return_counts=True)
    dim = int(sizes[count.argmax()])
    held = np.array([v for v in some if len(v) == dim])
    scale = np.abs(held).max()
    _, _, lines = np.linalg.svd((held - held.mean(axis=0)) / scale, full_matrices=False)
    return (lines[0] / np.linalg.norm(lines[0])).tolist()


def _searched(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """FOUND of queries (ASKED) in their blocks. A block that more than QUERY_ROWS queries visit meets them in parts."""
    parts = asked.groupBy("block", "dim").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts")).withColumnsRenamed({"block": "b", "dim": "d"})
    here = (F.col("block") == F.col("b")) & (F.col("dim") == F.col("d"))
    asked = asked.join(parts, here).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asked = asked.select(*[F.col(c).alias(c) for c in ("block", "dim", "part", "vec_id", "v", "radius")])  # columns of its own, as both come from one table
    vectors = vectors.join(parts, here).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "dim", "part", "vec_id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND_ARROW.empty_table()
        ids, v = _matrix(left)
        order = np.argsort(ids, kind="stable")
        query_ids, queries = _matrix(right)
        radius = right["radius"].to_numpy()
        block, found = Block(ids[order], v[order]), []
        step = max(1, 20_000_000 // len(ids))  # bounded counters
        for at in range(0, len(query_ids), step):
            found.append(block.search(query_ids[at : at + step], queries[at : at + step], radius[at : at + step], k))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=FOUND_ARROW)

    keys = ("block", "dim", "part")
    return vectors.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, FOUND)


def _routed(asked: DataFrame, bounds: list[tuple[int, int, float, float]]) -> DataFrame:
    """Each query in the other blocks whose interval its radius reaches; bounds: (dim, block, least, greatest), a row a block."""
    by_dim: dict[int, np.ndarray] = {}
    for dim in {b[0] for b in bounds}:
        by_dim[dim] = np.array(sorted((low, high, block) for d, block, low, high in bounds if d == dim))
    names = arrow_schema(ASKED)

    def run(batches):
        for batch in batches:
            block, dim, spread, radius = (batch.column(names.get_field_index(c)).to_numpy() for c in ("block", "dim", "spread", "radius"))
            which, to = [], []
            for d in np.unique(dim):
                low, high, number = by_dim[int(d)].T
                mine = np.flatnonzero(dim == d)
                slack = 1e-9 * (np.abs(spread[mine]) + np.where(np.isfinite(radius[mine]), radius[mine], 0) + 1)  # of rounding
                first = np.searchsorted(high, spread[mine] - radius[mine] - slack, side="left")  # both ends ascend, as blocks are intervals of one order
                last = np.searchsorted(low, spread[mine] + radius[mine] + slack, side="right")
                for i, a, b in zip(mine.tolist(), first.tolist(), last.tolist()):
                    blocks = number[a:b].astype(np.int32)
                    blocks = blocks[blocks != block[i]]
                    which.append(np.full(len(blocks), i))
                    to.append(blocks)
            if which:
                out = batch.take(pa.array(np.concatenate(which).astype(np.int64)))
                yield out.set_column(names.get_field_index("block"), "block", pa.array(np.concatenate(to).astype(np.int32)))

    return asked.mapInArrow(run, ASKED)


def nearest(df: DataFrame, every: int, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`.

    By Euclidean distance in double precision, ties to the smaller id; a query's
    own id is no candidate, of fewer candidates all come. Null ids and vectors
    that are null, empty, zero or hold null or non-finite components take no
    part; vectors of other dimensions are no candidates. Rows that repeat an id
    are candidates each, and one query: the least vector. Other columns are not
    read; an empty table gives no rows.
    """
    rows = usable(df, vec_id, embedding)
    line = ordering_line(rows)
    dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, line)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumns({"dim": F.size("v"), "spread": F.when(F.size("v") == len(line), dot).otherwise(F.get("v", F.lit(0)))})
    blocks = max(1, -(-rows.count() // block_rows))
    rows = checkpoint(rows.repartitionByRange(blocks, "dim", "spread", "vec_id").withColumn("block", F.spark_partition_id()))  # the blocks of one sampling
    bounds = [tuple(r) for r in rows.groupBy("dim", "block").agg(F.min("spread"), F.max("spread")).collect()]  # a row a block
    own = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "spread", "block")).alias("q"))
    own = own.select("vec_id", "q.v", "q.dim", "q.spread", F.lit(float("inf")).alias("radius"), "q.block")
    found = checkpoint(_searched(rows, own, k))
    last = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("reach"))
    routed = own.join(last, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "dim", "spread", F.coalesce("reach", F.lit(float("inf"))).alias("radius"), "block")
    found = found.unionAll(_searched(rows, checkpoint(_routed(routed, bounds)), k))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100)
