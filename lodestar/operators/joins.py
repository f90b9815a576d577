"""Equi-joins with residual predicates, first-match joins, prefilters and salting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equi_join(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Joins on keys {left name: right name}; null keys never match; a residual predicate decides matches, not rows."""
    on = None
    for a, b in keys.items():
        on = (left[a] == right[b]) if on is None else on & (left[a] == right[b])
    return left.join(right, on if residual is None else on & residual, how)


def last_match_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str) -> DataFrame:
    """At most one match a left row: the right row that is last by `order`; a partial aggregate, so frequent keys shrink before the exchange."""
    last = right.groupBy(right_key).agg(F.max_by(F.struct(*right.columns), F.col(order)).alias("r")).select("r.*")
    return equi_join(left, last, {left_key: right_key})


def filtered_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """An inner join on a right side without repeats, as a semi-join that Spark's runtime filters can use before the exchange."""
    return left.join(right, left[left_key] == right[right_key], "left_semi")


#: Bits of a block of an approximate set: what the built-in bitmaps hold.
BLOCK_BITS = 32_768


def approximate_set(df: DataFrame, key: str, keys: int, bits_per_key: int = 12, probes: int = 4) -> DataFrame:
    """(block, bits): a blocked Bloom filter of a column, for about so many distinct keys; null keys take no part.

    A key's block and its places there come from two hashes. Blocks are bitmaps
    made by partial aggregates, of BLOCK_BITS each whatever the number of rows.
    """
    blocks = max(1, -(-keys * bits_per_key // BLOCK_BITS))
    rows = df.filter(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), F.explode(_places(F.col(key), probes)).alias("place"))
    return rows.groupBy("block").agg(F.call_function("bitmap_construct_agg", F.col("place").cast("bigint")).alias("bits"))


def might_contain(df: DataFrame, key: str, made: DataFrame, keys: int, bits_per_key: int = 12, probes: int = 4) -> DataFrame:
    """The rows whose key may be in an approximate set made with the same numbers: all that are, and few others."""
    blocks = max(1, -(-keys * bits_per_key // BLOCK_BITS))
    held = made.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    rows = df.withColumns({"_at": _block(F.col(key), blocks), "_places": _places(F.col(key), probes)})
    byte = lambda p: F.conv(F.hex(F.substring("_bits", F.shiftright(p, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.forall("_places", lambda p: byte(p).bitwiseAND(F.call_function("shiftleft", F.lit(1), p % 8)) != 0)
    return rows.join(held, F.col("_at") == F.col("_block")).filter(hit).drop("_at", "_places", "_block", "_bits")


def _block(key: Column, blocks: int) -> Column:
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def _places(key: Column, probes: int) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in range(probes)]))


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salts: int) -> DataFrame:
    """An inner join whose left side has hot keys: its rows are dealt over `salts`, each right row goes to all."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*[left[c] for c in left.columns], F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    copies = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, (dealt[left_key] == copies[right_key]) & (F.col("_salt") == F.col("_copy"))).drop("_salt", "_copy")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, to: str) -> DataFrame:
    """Adds to each left row the value of the last right row at or before its time, by union and one window."""
    a = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, time, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(to, F.last("_value", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_value")
