"""Exact nearest vectors, k-means, pruning bounds and rotations, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")
#: Rows and queries that meet at once.
BLOCK_ROWS, QUERY_ROWS = 8_192, 1_024


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _scores(v: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return ((v - x) ** 2).sum(axis=1)
    s = -(v @ x)
    if metric == "cosine":
        norm = np.linalg.norm(v, axis=1) * np.linalg.norm(x)
        s = np.divide(s, norm, out=np.zeros_like(s), where=norm > 0)
    return s


def nearest(df: DataFrame, queries: np.ndarray, k: int, metric: str = "l2", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, rank, key, score): the k nearest rows to each row of a given, bounded matrix; ties to the smaller key.

    Each batch keeps k rows a query, so what meets in the ranking is small.
    """
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    q = np.asarray(queries, np.float64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for i, x in enumerate(q):
                s = _scores(v, x, metric)
                best = np.lexsort((ids, s))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i)), pa.array(ids[best]), pa.array(s[best])], names=["query", key, "score"])

    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector)
    found = rows.mapInArrow(run, f"query bigint, {key} bigint, score double")
    w = Window.partitionBy("query").orderBy("score", key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_to_rows(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, rank, key, score): as nearest, for the rows of a table of any size, named by their key.

    Queries are dealt out in parts, and each part meets each block of rows, so
    none is collected; a block keeps k rows a query. A key is one query, the
    least of its vectors. Null keys and vectors take no part; vectors of other
    dimensions are no candidates.
    """
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")

    def usable(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))

    rows, asked = usable(df), usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    blocks, parts = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-asked.count() // QUERY_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("id", "v", F.size("v").alias("dim"), dealt(blocks).alias("block"), each(parts).alias("part"))
    asked = asked.select("id", "v", F.size("v").alias("dim"), dealt(parts).alias("part"), each(blocks).alias("block"))
    names = pa.schema([("query", pa.int64()), (key, pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        ids, v, found = left["id"].to_numpy(), _matrix(left["v"].combine_chunks()), []
        for query, x in zip(right["id"].to_numpy(), _matrix(right["v"].combine_chunks())):
            s = _scores(v, x, metric)
            best = np.lexsort((ids, s))[:k]
            found.append((np.full(len(best), query), ids[best], s[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(a)) for a in zip(*found)], schema=names)

    by = ("block", "part", "dim")
    found = rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, f"query bigint, {key} bigint, score double")
    w = Window.partitionBy("query").orderBy("score", key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def kmeans_step(df: DataFrame, centres: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray, float]:
    """Assignments (key, cluster, d2) to bounded centres, the centres' update, and the inertia.

    Sums by cluster are made in each batch; the driver sees one row a cluster.
    """
    c = np.asarray(centres, np.float64)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                d = (v**2).sum(1)[:, None] - 2 * v @ c.T + (c**2).sum(1)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(np.maximum(d[np.arange(len(at)), at], 0)), batch.column(1)], names=[key, "cluster", "d2", "v"])

    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>").alias("v"))
    made = rows.mapInArrow(assign, f"{key} bigint, cluster int, d2 double, v array<double>")
    dim = c.shape[1]
    sums = made.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d2").alias("d2"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dim)]).alias("s")).collect()
    new, inertia = c.copy(), 0.0
    for row in sums:
        new[row["cluster"]] = np.array(row["s"]) / row["n"]
        inertia += row["d2"]
    return made.drop("v"), new, inertia


def kmeans(df: DataFrame, k: int, rounds: int = 10, seed: int = 7, key: str = "vec_id", vector: str = "embedding", sample: int = 2_000, gain: float = 0.001, restarts: int = 1) -> tuple[DataFrame, np.ndarray, float]:
    """k-means++ on at most `sample` rows (by hash of the key), then Lloyd rounds over all until the gain is small.

    Of several restarts, seeded one after the other, the one of least inertia is kept.
    """
    if restarts > 1:
        return min((kmeans(df, k, rounds, seed + i, key, vector, sample, gain) for i in range(restarts)), key=lambda made: made[2])
    picked = df.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
    x, rng = np.array([r[0] for r in picked], np.float64), np.random.default_rng(seed)
    if not len(x):
        raise ValueError("no vectors")
    centres = [x[rng.integers(len(x))]]
    for _ in range(min(k, len(x)) - 1):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c, before, made = np.array(centres), np.inf, None
    for _ in range(rounds):
        made, new, inertia = kmeans_step(df, c, key, vector)
        if before - inertia <= gain * before:
            break
        c, before = new, inertia
    return made, c, inertia


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, by QR with signs fixed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def signed_dct(dim: int, seed: int) -> np.ndarray:
    """The orthonormal cosine transform (DCT-II) of a vector whose components get random signs."""
    i, j = np.arange(dim)[:, None], np.arange(dim)
    m = np.sqrt(2 / dim) * np.cos(np.pi * (2 * j + 1) * i / (2 * dim))
    m[0] /= np.sqrt(2)
    return m * np.random.default_rng(seed).choice([-1.0, 1.0], dim)


def rotate(df: DataFrame, matrix: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    m = np.asarray(matrix, np.float64)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1)) @ m.T
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), made], names=[key, "rotated"])

    return df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector).mapInArrow(run, f"{key} bigint, rotated array<double>")


def box_bounds(df: DataFrame, query: np.ndarray, group: str, vector: str = "embedding") -> DataFrame:
    """(group, bound): a lower bound of the squared distance from a query to any vector of each group, by bounding boxes."""
    dim = len(query)
    ends = df.groupBy(group).agg(*[f(F.get(vector, F.lit(i)).cast("double")).alias(f"{n}{i}") for i in range(dim) for n, f in (("lo", F.min), ("hi", F.max))])
    off = [F.greatest(F.col(f"lo{i}") - float(x), F.lit(float(x)) - F.col(f"hi{i}"), F.lit(0.0)) for i, x in enumerate(query)]
    bound = F.lit(0.0)
    for o in off:
        bound = bound + o * o
    return ends.select(group, bound.alias("bound"))
