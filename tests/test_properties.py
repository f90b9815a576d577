"""Operators on small random frames with nulls, NaN, signed zeros and repeats, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.functions import numeric as N
from lodestar.functions import strings as S
from lodestar.functions import temporal as D
from lodestar.functions import vectors as V
from lodestar.operators import aggregates, graph, joins, setops, topk, vector_search, windows
from pyspark.sql import functions as F

KEYS = [None, 0.0, -0.0, 1.5, float("nan"), float("inf"), -1.0]


def rows(seed: int, n: int = 25):
    rng = random.Random(seed)
    return [(rng.choice(KEYS), rng.choice([None, 1, 2, 3])) for _ in range(n)]


def same(a, b) -> bool:
    """Equality of join keys: all NaN are one, zeros too, null is none."""
    return a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b)))


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else 0.0 if x == 0 else x


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_joins(spark, seed, how):
    a, b = rows(seed), rows(seed + 100)
    left, right = spark.createDataFrame(a, "k double, v int"), spark.createDataFrame(b, "j double, w int")
    got = Counter(tuple(map(plain, r)) for r in joins.equi_join(left, right, {"k": "j"}, how, F.coalesce(F.col("v"), F.lit(0)) != F.coalesce(F.col("w"), F.lit(9))).collect())
    hit = lambda x, y: same(x[0], y[0]) and (x[1] or 0) != (9 if y[1] is None else y[1])
    want = Counter()
    for x in a:
        mates = [y for y in b if hit(x, y)]
        if how == "left_semi":
            want.update([x] if mates else [])
        elif how == "left_anti":
            want.update([] if mates else [x])
        else:
            want.update(x + y for y in mates)
            if not mates and how in ("left", "full"):
                want.update([x + (None, None)])
    if how in ("right", "full"):
        want.update((None, None) + y for y in b if not any(hit(x, y) for x in a))
    assert got == Counter(tuple(map(plain, k)) for k in want.elements())


@pytest.mark.parametrize("name", setops.OPERATIONS)
def test_set_operations(spark, name):
    rng = random.Random(5)
    a, b = [rng.choice([None, 1, 2, 3, 4]) for _ in range(12)], [rng.choice([None, 2, 3, 5]) for _ in range(9)]
    ca, cb = Counter(a), Counter(b)
    want = {
        "union_all": ca + cb, "union_distinct": Counter(set(a) | set(b)), "intersect_distinct": Counter(set(a) & set(b)), "intersect_all": ca & cb,
        "except_distinct": Counter(set(a) - set(b)), "except_all": ca - cb,
    }[name]
    made = setops.OPERATIONS[name](*(spark.createDataFrame([(x,) for x in v], "x int") for v in (a, b)))
    assert Counter(r[0] for r in made.collect()) == want


def test_salted_join_is_the_join(spark):
    a = [(0, i) for i in range(60)] + [(1, 1), (None, 2)]
    left, right = spark.createDataFrame(a, "k int, v int"), spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "d")], "j int, w string")
    want = Counter(map(tuple, left.join(right, F.col("k") == F.col("j")).collect()))
    assert Counter(map(tuple, joins.salted_join(left, right, "k", "j", 4).select("k", "v", "j", "w").collect())) == want and sum(want.values()) == 121


def test_numbered_and_offsets(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 20) for _ in range(300)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    got = [r["i"] for r in topk.numbered(df, [F.col("v").desc(), F.col("i").asc()], "pos").orderBy("pos").collect()]
    assert got == [i for _, i in sorted((-v, i) for i, v in enumerate(values))]
    c, at = Counter(values), 0
    for r in graph.offsets(df, "v").orderBy("v").collect():
        assert (r["degree"], r["first"]) == (c[r["v"]], at)
        at += r["degree"]


def test_frames(spark):
    values = [5.0, 2.0, 8.0, 1.0, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").withColumn("k", F.lit(1))
    got = windows.frame(df, "x", ["k"], ["i"], 2, 0).orderBy("i").collect()
    assert (got[4]["lo"], got[4]["hi"], got[0]["vs"], got[1]["a"]) == (1.0, 9.0, 0.0, 3.5)
    whole = windows.frame(df, "x", ["k"], ["i"], None, None).first()
    assert (whole["s"], whole["n"]) == (25.0, 5.0)


def test_compensated_sum(spark):
    df = spark.createDataFrame([("a", x) for x in (1e16, 1.0, -1e16, 1.0, None)] + [("b", 0.1)] * 10, "k string, x double").repartition(3)
    assert {r["k"]: r["sum"] for r in aggregates.compensated_sum(df, "k", "x").collect()} == {"a": 2.0, "b": 1.0}


def test_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(N.div_or_zero(F.lit(-7), F.lit(2))) == -3 and one(N.div_or_zero(F.lit(1), F.lit(0))) == 0 and one(N.div_or_zero(F.lit(None), F.lit(0))) == 0
    assert one(N.saturating_cast(F.lit(float("nan")), "int")) == 0 and one(N.saturating_cast(F.lit(1e30), "tinyint")) == 127 and one(N.saturating_cast(F.lit(-1.9), "int")) == -1
    assert one(N.wrapping_add(F.lit(2**63 - 1), F.lit(1))) == -(2**63)
    assert float(one(N.decimal_div(F.lit(-10).cast("decimal(9,2)"), F.lit(3).cast("decimal(9,2)"), 2))) == -3.33
    assert one(N.crc32c(F.lit(b"123456789"))) == 0xE3069283


def test_text_and_dates(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.trim(F.lit("\x0b\t é \n"))) == "é" and one(S.ascii_upper(F.lit("aé"))) == "Aé"
    assert one(S.substring(F.lit("hello"), F.lit(-3), F.lit(2))) == "he" and one(S.substring(F.lit("hello"), F.lit(2), F.lit(-1))) == ""
    assert one(S.full_match(F.lit("ab\n"), "ab")) is False and one(S.substitute(F.lit("a1"), "([a-z])([0-9])", r"\2\1")) == "1a"
    day = lambda s: F.lit(s).cast("date")
    assert str(one(D.add_interval(day("2024-01-31"), D.interval(F.lit(1), F.lit(1))))) == "2024-03-01"
    assert str(one(D.add_interval(day("1960-02-29"), D.interval(F.lit(-12), F.lit(0))))) == "1959-02-28"


@pytest.mark.parametrize("width", [1, 63, 64, 65, 100, 128, 768])
def test_hamming_counts_every_component(spark, width):
    rng = random.Random(width)
    pairs = [([rng.choice([-1.0, 0.0, 1.0]) for _ in range(width)], [rng.choice([-1.0, 0.0, 1.0]) for _ in range(width)]) for _ in range(8)]
    pairs.append(([1.0] * width, [1.0] * (width - 1) + [-1.0]))  # they differ in the last component only
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<float>, b array<float>")
    got = {r["i"]: r["n"] for r in df.select("i", V.hamming(V.sign_bits(F.col("a")), V.sign_bits(F.col("b"))).alias("n")).collect()}
    assert got == {i: sum((x > 0) != (y > 0) for x, y in zip(a, b)) for i, (a, b) in enumerate(pairs)}
    packed = df.select(V.sign_bits(F.col("a")).alias("w")).first()["w"]
    assert len(packed) == -(-width // 64)


def test_knn_of_every_fiftieth_row(spark, monkeypatch):
    from lodestar import catalog
    from lodestar.plans import semi

    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 3)
    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in catalog.table(spark, d, "embeddings").select("vec_id", "embedding").collect()]
    want = set()
    for i, x in rows:
        if i % 50 == 0:
            best = sorted((float(((v - x) ** 2).sum()), j) for j, v in rows)[:5]
            want.update((i, rank, j) for rank, (_, j) in enumerate(best, 1))
    got = [(r["query"], r["rank"], r["vec_id"]) for r in semi.vector_knn_every(spark, d).collect()]
    assert len(want) > 15 and len(got) == len(want) and set(got) == want


def test_udf_takes_all_orders(spark):
    from lodestar import catalog
    from lodestar.plans import semi

    d = "/root/testdata/sf0.001"
    want = {r["o_orderkey"] for r in catalog.table(spark, d, "orders").select("o_orderkey").collect()}
    assert {r["o_orderkey"] for r in semi.udf_surface_all(spark, d).collect()} == want and any(k % 2 for k in want)


@pytest.mark.parametrize("keys", [1, 20_000])
def test_approximate_set(spark, keys):
    """Every member passes, null keys never, and at most one other in fifty."""
    members = spark.range(keys).select((F.col("id") * 3).alias("k")).unionAll(spark.range(1).select(F.lit(None).cast("bigint")))
    made = joins.approximate_set(members, "k", keys)
    asked = members.unionAll(spark.range(20_000).select(F.col("id") * 3 + 1))
    kept = [r[0] for r in joins.might_contain(asked, "k", made, keys).collect()]
    assert None not in kept
    assert {k for k in kept if k % 3 == 0} == {3 * i for i in range(keys)}
    assert sum(k % 3 == 1 for k in kept) <= 400


def test_approximate_set_of_nothing(spark):
    empty = spark.range(0).select(F.col("id").alias("k"))
    assert joins.might_contain(spark.range(5).withColumnRenamed("id", "k"), "k", joins.approximate_set(empty, "k", 0), 0).count() == 0


@pytest.mark.parametrize("dim", [1, 5, 64])
def test_signed_dct_is_a_rotation(dim):
    m = vector_search.signed_dct(dim, 3)
    assert np.allclose(m @ m.T, np.eye(dim))


def test_restarts_keep_the_least_inertia(spark):
    x = np.random.default_rng(1).normal(size=(60, 2)) + np.repeat([[0, 0], [9, 0], [0, 9], [9, 9]], 15, axis=0)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    each = [vector_search.kmeans(df, 4, seed=7 + i)[2] for i in range(3)]
    assert vector_search.kmeans(df, 4, restarts=3)[2] == pytest.approx(min(each))
