"""Numbers: wrapping and saturating arithmetic, truncating decimals, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMITS = {"tinyint": (-(2**7), 2**7 - 1), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1)}


def div_or_zero(a: Column, b: Column) -> Column:
    """Integer division that truncates, and gives 0 for a zero divisor; NULL stays NULL."""
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.try_divide(a, b).cast("bigint"))


def saturating_cast(x: Column, to: str) -> Column:
    """Casts to a narrow integer, clamped to its range; fractions are cut off and NaN is 0."""
    low, high = LIMITS[to]
    clean = F.when(F.isnan(x.cast("double")), F.lit(0.0)).otherwise(x.cast("double"))
    return F.least(F.greatest(clean, F.lit(float(low))), F.lit(float(high))).cast("bigint").cast(to)


def wrapping_add(a: Column, b: Column) -> Column:
    """64-bit addition modulo 2^64."""
    total = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    turned = F.pmod(total + F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(20,0)")) - F.lit(str(2**63)).cast("decimal(20,0)")
    return turned.cast("bigint")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def decimal_div(a: Column, b: Column, scale: int) -> Column:
    """Decimal division that truncates toward zero at `scale`; NULL for a zero divisor."""
    q = F.try_divide(a.cast("decimal(38,10)"), b.cast("decimal(38,10)"))
    step = F.lit(10**scale)
    return (F.when(q >= 0, F.floor(q * step)).otherwise(F.ceil(q * step)) / step).cast(f"decimal(18,{scale})")


def crc32c(payload: Column) -> Column:
    """Castagnoli CRC of a binary column, by table lookup over Arrow batches."""
    import numpy as np
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    table = table.tolist()

    def run(column):
        def one(raw):
            if raw is None:
                return None
            c = 0xFFFFFFFF
            for b in raw:
                c = table[(c ^ b) & 255] ^ (c >> 8)
            return c ^ 0xFFFFFFFF

        return column.map(one).astype("Int64")

    return F.pandas_udf(run, "bigint")(payload)
