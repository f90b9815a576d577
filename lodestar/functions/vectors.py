"""Vectors as arrays: distances, quantization, small tensor operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    norm = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when(norm > 0, F.try_divide(inner_product(a, b), norm)).otherwise(F.lit(0.0))


def quantize(v: Column, low: Column, high: Column, levels: int = 255) -> Column:
    """Affine codes 0..levels, halves up, clamped."""
    step = (high - low) / levels
    return F.transform(v.cast("array<double>"), lambda x: F.when(step <= 0, 0).otherwise(F.least(F.greatest(F.floor(F.try_divide(x - low, step) + 0.5), F.lit(0)), F.lit(levels)).cast("int")))


def dequantize(codes: Column, low: Column, high: Column, levels: int = 255) -> Column:
    return F.transform(codes, lambda q: low + q * (high - low) / levels)


def half(v: Column) -> Column:
    """Each value rounded to half precision, by Arrow batches."""
    import numpy as np

    def run(column):
        return column.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return F.pandas_udf(run, "array<float>")(v)


def sign_bits(v: Column) -> Column:
    """All signs as the bits of bigints, 64 a word, the first lowest; the last word is filled up with zeros."""
    zero = F.lit(0).cast("bigint")
    words = F.ceil(F.size(v) / 64).cast("int")
    positive = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i % 64)).otherwise(zero))
    packed = F.transform(F.sequence(F.lit(1), words), lambda w: F.aggregate(F.slice(positive, (w - 1) * 64 + 1, F.lit(64)), zero, lambda a, b: a.bitwiseOR(b)))
    return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).when(v.isNotNull(), packed)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of as many words; null if their numbers differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def softmax(x: Column) -> Column:
    e = F.transform(x.cast("array<double>"), lambda v: F.exp(v - F.array_max(x)))
    total = _sum(e)
    return F.transform(e, lambda v: v / total)


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(inner_product(x, x) / F.size(x) + eps)
    return F.transform(x.cast("array<double>"), lambda v: v / scale)


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(gate.cast("array<double>"), up.cast("array<double>"), lambda g, u: g / (F.exp(-g) + 1) * u)


def rope(x: Column, position: Column, base: float = 10_000.0) -> Column:
    """Rotates pairs of neighbours by angles position / base^(2 i / n)."""
    n = F.size(x)

    def turn(i):
        angle = position / F.pow(F.lit(base), (i - i % 2) / n)
        here, other = F.get(x, i).cast("double"), F.get(x, i + 1 - i % 2 * 2).cast("double")
        return here * F.cos(angle) + F.when(i % 2 == 0, -other).otherwise(other) * F.sin(angle)

    return F.transform(F.sequence(F.lit(0), n - 1), turn)


def mat_vec(rows: list[list[float]], x: Column) -> Column:
    return F.array(*[inner_product(F.array(*map(F.lit, r)), x) for r in rows])


def penalize(logits: Column, counts: Column, repeat: float, presence: float, frequency: float) -> Column:
    """Repeat, presence and frequency penalties for tokens already seen."""
    def one(x, n):
        y = F.when(x > 0, x / repeat).otherwise(x * repeat)
        return F.when(n > 0, y - presence - n * frequency).otherwise(x)

    return F.zip_with(logits.cast("array<double>"), counts, one)


def sample(logits: Column, draw: Column, top_k: int, temperature: float, min_p: float, top_p: float) -> Column:
    """Token chosen by top-k, softmax at a temperature, min-p, top-p and the inverse distribution at `draw`; ties to the lower token."""
    kind = "array<struct<x:double,i:int>>"
    ranked = F.transform(logits.cast("array<double>"), lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    kept = F.slice(F.array_sort(ranked), 1, top_k)
    best = F.get(kept, F.lit(0))["x"]
    weights = F.transform(kept, lambda t: F.struct(F.exp((best - t["x"]) / temperature).alias("x"), t["i"].alias("i")))
    weights = F.filter(weights, lambda t: t["x"] >= min_p)  # of the best's weight, which is one
    total = F.aggregate(weights, F.lit(0.0), lambda a, t: a + t["x"])

    def within(acc, t):
        return F.when(acc["run"] < top_p * total, F.struct((acc["run"] + t["x"]).alias("run"), F.array_append(acc["out"], t).alias("out"))).otherwise(acc)

    nucleus = F.aggregate(weights, F.struct(F.lit(0.0).alias("run"), F.array().cast(kind).alias("out")), within)

    def pick(acc, t):
        return F.when(acc["run"] < draw * nucleus["run"], F.struct((acc["run"] + t["x"]).alias("run"), t["i"].alias("i"))).otherwise(acc)

    return F.aggregate(nucleus["out"], F.struct(F.lit(0.0).alias("run"), F.get(nucleus["out"], F.lit(0))["i"].alias("i")), pick)["i"]
