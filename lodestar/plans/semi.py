"""JSON, metrics, vectors, graph and model-side helpers (survey 2.14, 2.15, 2.17, 2.18, 2.20)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions import promql as Q
from ..functions import vectors as V
from ..operators import graph, templates, vector_search

c = F.col


@register("json_paths", (208, 209, 210, 212), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, (json_type(props, '$.k') IS NOT NULL) AS has FROM events")
def json_paths(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.get_json_object("props", "$.k").isNotNull().alias("has"))


@register("json_build", (211, 213), """SELECT o_orderkey, '{"c":' || o_custkey || ',"s":"' || o_orderstatus || '","a":[' || o_orderkey || ',1]}' AS j FROM orders""")
def json_build(spark, d):
    made = F.struct(c("o_custkey").alias("c"), c("o_orderstatus").alias("s"), F.array(c("o_orderkey"), F.lit(1).cast("bigint")).alias("a"))
    return table(spark, d, "orders").select("o_orderkey", F.to_json(made).alias("j"))


@register("variant_column", (214, 215), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'bigint' WHEN 1 THEN 'string' ELSE 'double' END AS disc, CASE WHEN event_id % 3 = 0 THEN event_id END AS i, CASE WHEN event_id % 3 = 1 THEN event_type END AS s, CASE WHEN event_id % 3 = 2 THEN value END AS f FROM events")
def variant_column(spark, d):
    e = c("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(e % 3 == 0, F.struct(F.lit("bigint").alias("disc"), e.alias("i"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("f"))).when(
        e % 3 == 1, F.struct(F.lit("string").alias("disc"), F.lit(None).cast("bigint").alias("i"), c("event_type").alias("s"), F.lit(None).cast("double").alias("f"))).otherwise(
        F.struct(F.lit("double").alias("disc"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("string").alias("s"), c("value").alias("f"))).alias("v"))
    return rows.select("event_id", "v.disc", "v.i", "v.s", "v.f")


@register("variant_values", (214,), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' ELSE 'DOUBLE' END AS kind, CASE WHEN event_id % 3 = 0 THEN event_id END AS i, CASE WHEN event_id % 3 = 1 THEN event_type END AS s, CASE WHEN event_id % 3 = 2 THEN value END AS f FROM events")
def variant_values(spark, d):
    """One variant column of three types: made, told apart by its own schema, and taken out by type."""
    e = c("event_id")
    v = F.when(e % 3 == 0, e.cast("variant")).when(e % 3 == 1, c("event_type").cast("variant")).otherwise(c("value").cast("variant"))
    rows = table(spark, d, "events").select("event_id", v.alias("v")).withColumn("kind", F.schema_of_variant("v"))
    taken = {n: F.when(c("kind") == t.upper(), F.try_variant_get("v", "$", t)) for n, t in (("i", "bigint"), ("s", "string"), ("f", "double"))}
    return rows.select("event_id", "kind", *[x.alias(n) for n, x in taken.items()])


@register("array_map_functions", (215,), """SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS kinds, list_max(list_transform(w, lambda x: len(x))) AS longest, len(list_filter(w, lambda x: len(x) > 6)) AS long
    FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def array_map_functions(spark, d):
    """Words as an array, and as a map of counts whose keys are the distinct ones."""
    rows = table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    lengths = F.map_from_entries(F.transform(F.array_distinct("w"), lambda x: F.struct(x, F.char_length(x))))
    made = {"n": F.size("w"), "kinds": F.size(F.map_keys(lengths)), "longest": F.array_max(F.map_values(lengths)), "long": F.size(F.filter("w", lambda x: F.char_length(x) > 6))}
    return rows.select("doc_id", *[F.when(c("w").isNotNull(), x).cast("bigint").alias(n) for n, x in made.items()])


PROM = "(SELECT event_type, CAST(epoch_us(ts) // 1000 AS BIGINT) AS t, event_id, value AS v, CAST(epoch_us(ts) // 1000 AS BIGINT) // 86400000 AS day FROM events)"


def by_day(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1000).alias("t"), c("value").alias("v"))
    return rows.withColumn("day", F.floor((c("t")) / 86_400_000))


def ranges(spark, d) -> DataFrame:
    """Samples of each event type by day, in (start, end] windows of a day."""
    return by_day(spark, d).groupBy("event_type", "day").agg(Q.samples(c("t"), c("v")).alias("s")).withColumns({"start": c("day") * 86_400_000 - 1, "stop": c("day") * 86_400_000 + 86_399_999})


@register("prom_over_time", (218, 220, 221, 222), f"""SELECT event_type, day, ROUND(STDDEV_POP(v) * pi(), 4) AS sd, ROUND(VAR_POP(v) * pi(), 4) AS var, ROUND(quantile_cont(v, 0.9) * pi(), 4) AS q, ROUND(mad(v) * pi(), 4) AS mad, CAST(SUM(CAST(v < b AS INT)) AS INT) AS resets, CAST(SUM(CAST(v <> b AS INT)) AS INT) AS changes
    FROM (SELECT *, LAG(v) OVER (PARTITION BY event_type, day ORDER BY t, v) AS b FROM {PROM}) GROUP BY ALL HAVING COUNT(*) > 1""")  # fmt: skip
def prom_over_time(spark, d):
    s = c("s")
    var = Q.variance(s)
    made = {"sd": F.sqrt(var), "var": var, "q": Q.quantile(s, 0.9), "mad": Q.mad(s)}
    return ranges(spark, d).filter(F.size("s") > 1).select("event_type", "day", *[F.round(v * F.pi(), 4).alias(k) for k, v in made.items()], Q.resets(s).alias("resets"), Q.changes(s).alias("changes"))


@register("prom_regression", (219,), f"""SELECT event_type, day, ROUND(COALESCE(regr_slope(v, (t - (day * 86400000 + 86399999)) / 1000.0), 0), 9) AS deriv, ROUND(AVG(v) - COALESCE(regr_slope(v, (t - (day * 86400000 + 86399999)) / 1000.0), 0) * AVG((t - (day * 86400000 + 86399999)) / 1000.0) + 3600 * COALESCE(regr_slope(v, (t - (day * 86400000 + 86399999)) / 1000.0), 0), 4) AS hour_on
    FROM {PROM} GROUP BY ALL HAVING COUNT(*) > 1""")  # fmt: skip
def prom_regression(spark, d):
    slope, value = Q.line(c("t"), c("v"), c("day") * 86_400_000 + 86_399_999)
    lines = by_day(spark, d).groupBy("event_type", "day").agg(F.count("*").alias("n"), slope.alias("slope"), value.alias("value"))
    return lines.filter("n > 1").select("event_type", "day", F.round("slope", 9).alias("deriv"), F.round(c("value") + c("slope") * 3600, 4).alias("hour_on"))


@register("prom_rate", (216, 217), f"""WITH e AS (SELECT *, LAG(v) OVER o AS b, LAG(t) OVER o AS bt FROM {PROM} WINDOW o AS (PARTITION BY event_type, day ORDER BY t, v)),
    g AS (SELECT event_type, day, COUNT(*) AS n, MIN(t) AS ft, MAX(t) AS lt, arg_min(v, (t, v)) AS fv, arg_max(v, (t, v)) AS lv, arg_max(b, (t, v)) AS pv, arg_max(bt, (t, v)) AS pt, SUM(CASE WHEN v < b THEN b ELSE 0 END) AS up FROM e GROUP BY 1, 2 HAVING COUNT(*) > 1),
    h AS (SELECT *, (lt - ft) / 1000 AS span, (lt - ft) / 1000 / (n - 1) AS mean, (ft - (day * 86400000 - 1)) / 1000 AS a0, (day * 86400000 + 86399999 - lt) / 1000 AS z0, lv - fv AS d, lv - fv + up AS c FROM g),
    i AS (SELECT *, CASE WHEN a0 >= mean * 1.1 THEN mean / 2 ELSE a0 END AS a, CASE WHEN z0 >= mean * 1.1 THEN mean / 2 ELSE z0 END AS z FROM h),
    j AS (SELECT *, CASE WHEN c > 0 AND fv >= 0 AND span * fv / c < a THEN span * fv / c ELSE a END AS ac FROM i)
    SELECT event_type, day, ROUND(c * (span + ac + z) / span / 86400, 6) AS rate, ROUND(c * (span + ac + z) / span, 3) AS increase, ROUND(d * (span + a + z) / span, 5) AS delta,
    ROUND(CASE WHEN lv < pv THEN lv ELSE lv - pv END / NULLIF((lt - pt) / 1000, 0), 7) AS irate, ROUND(lv - pv, 6) AS idelta FROM j""")
def prom_rate(spark, d):
    """rate, increase and delta with extrapolation, irate and idelta; tested against published cases."""
    s, a, b = c("s"), c("start"), c("stop")
    made = {"rate": Q.extrapolated(s, a, b, True, True), "increase": Q.extrapolated(s, a, b, True, False), "delta": Q.extrapolated(s, a, b, False, False), "irate": Q.irate(s), "idelta": Q.irate(s, False)}
    digits = {"rate": 6, "increase": 3, "delta": 5, "irate": 7, "idelta": 6}
    return ranges(spark, d).filter(F.size("s") > 1).select("event_type", "day", *[F.round(v, digits[k]).alias(k) for k, v in made.items()])


@register("prom_histogram_quantile", (223,), """WITH b AS (SELECT event_type, le, (SELECT COUNT(*) FROM events e2 WHERE e2.event_type = e.event_type AND e2.value <= le) AS n FROM (SELECT DISTINCT event_type FROM events) e, (SELECT UNNEST([10.0, 50.0, 100.0, 200.0, 'inf'::DOUBLE]) AS le)),
    r AS (SELECT *, MAX(n) OVER (PARTITION BY event_type) * 0.75 AS rank, COALESCE(LAG(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS n0, COALESCE(LAG(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS l0 FROM b)
    SELECT event_type, ROUND(arg_min(CASE WHEN le = 'inf' THEN 200 ELSE l0 + (le - l0) * (rank - n0) / (n - n0) END, le), 6) AS q FROM r WHERE n >= rank GROUP BY 1""")  # fmt: skip
def prom_histogram(spark, d):
    bounds = [10.0, 50.0, 100.0, 200.0, float("inf")]
    counts = table(spark, d, "events").groupBy("event_type").agg(F.array(*[F.struct(F.lit(b).alias("le"), F.count_if(c("value") <= b).cast("double").alias("n")) for b in bounds]).alias("b"))
    return counts.select("event_type", F.round(Q.histogram_quantile(c("b"), 0.75), 6).alias("q"))


@register("vector_distances", (288, 289, 309), """SELECT a.vec_id, ROUND(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 6) AS l2, ROUND(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS ip, ROUND(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cs
    FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")  # fmt: skip
def vector_distances(spark, d):
    rows = table(spark, d, "embeddings")
    q = rows.filter("vec_id = 0").agg(F.first("embedding").alias("q")).scalar()
    rows = rows.withColumn("q", q)
    return rows.select("vec_id", *[F.round(f(c("embedding"), c("q")), 6).alias(k) for k, f in (("l2", V.l2_squared), ("ip", V.inner_product), ("cs", V.cosine))])


@register("vector_knn", (198, 297), """SELECT CAST(q.vec_id AS BIGINT) AS query, CAST(ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY s, v.vec_id) AS INT) AS rank, v.vec_id AS vec_id, ROUND(s, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id < 3) q, embeddings v,
    LATERAL (SELECT list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS s) QUALIFY rank <= 5""")  # fmt: skip
def vector_knn(spark, d):
    rows = table(spark, d, "embeddings")
    q = [r[0] for r in rows.filter("vec_id < 3").orderBy("vec_id").select("embedding").collect()]  # three given vectors
    return vector_search.nearest(rows, np.array(q), 5).select("query", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("vector_knn_every", (198, 297))
def vector_knn_every(spark, d):
    """Every row whose id is divisible by 50 against all rows; vector_knn keeps to the three ids of its SQL."""
    rows = table(spark, d, "embeddings")
    return vector_search.nearest_to_rows(rows, rows.filter("vec_id % 50 = 0"), 5).select("query", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("vector_quantized", (291, 292), """WITH g AS (SELECT MIN(list_min(embedding))::DOUBLE AS lo, MAX(list_max(embedding))::DOUBLE AS hi FROM embeddings)
    SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE - lo) / ((hi - lo) / 255) + 0.5), 0), 255))) AS BIGINT) AS codes FROM embeddings, g""")  # fmt: skip
def vector_quantized(spark, d):
    rows = table(spark, d, "embeddings")
    ends = rows.agg(F.struct(F.min(F.array_min("embedding")).cast("double").alias("lo"), F.max(F.array_max("embedding")).cast("double").alias("hi")).alias("e")).scalar()
    rows = rows.withColumn("e", ends)
    return rows.select("vec_id", F.aggregate(V.quantize(c("embedding"), c("e.lo"), c("e.hi")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("codes"))


@register("vector_bits_and_halves", (290, 292), """SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST((z[1] > 0) <> (z[2] > 0) AS INT))) AS INT) AS hamming, true AS close
    FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def vector_bits(spark, d):
    """Sign bits and their Hamming distance to vector 0's, and the half-precision round trip's error."""
    rows = table(spark, d, "embeddings").withColumns({"b": V.sign_bits(c("embedding")), "h": V.half(c("embedding"))})
    zero = rows.filter("vec_id = 0").agg(F.first("b").alias("z")).scalar()
    return rows.withColumn("z", zero).select("vec_id", V.hamming(c("b"), c("z")).alias("hamming"), (V.l2_squared(c("embedding"), c("h")) < 1e-4).alias("close"))


@register("vector_kmeans", (293, 294))
def vector_kmeans(spark, d):
    made, _, _ = vector_search.kmeans(table(spark, d, "embeddings"), 8)
    return made.select("vec_id", "cluster", F.round("d2", 6).alias("d2"))


@register("vector_pruning", (295, 296), "SELECT DISTINCT label, true AS sound, true AS same FROM embeddings")
def vector_pruning(spark, d):
    """Box bounds by label against the true least distance; distances survive a rotation."""
    rows = table(spark, d, "embeddings")
    q = np.array(rows.filter("vec_id = 0").first()["embedding"])
    turned = vector_search.rotate(rows, vector_search.rotation(len(q), 5)).withColumn("n", F.sqrt(V.inner_product(c("rotated"), c("rotated"))))
    least = rows.withColumn("d", V.l2_squared(c("embedding"), F.array(*[F.lit(float(x)) for x in q]))).join(turned.select("vec_id", "n"), "vec_id")
    least = least.withColumn("same", F.abs(c("n") - F.sqrt(V.inner_product(c("embedding"), c("embedding")))) < 1e-6).groupBy("label").agg(F.min("d").alias("least"), F.bool_and("same").alias("same"))
    return vector_search.box_bounds(rows, q, "label").join(least, "label").select("label", (c("bound") <= c("least") + 1e-9).alias("sound"), "same")


@register("vector_box_bounds", (295,), """WITH q AS (SELECT UNNEST(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id = 0),
    e AS (SELECT label, i, MIN(v) AS lo, MAX(v) AS hi FROM (SELECT label, UNNEST(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2)
    SELECT label, ROUND(SUM(greatest(lo - x, x - hi, 0) ** 2), 6) AS bound FROM e JOIN q USING (i) GROUP BY 1""")  # fmt: skip
def vector_box_bounds(spark, d):
    rows = table(spark, d, "embeddings")
    q = np.array(rows.filter("vec_id = 0").first()["embedding"])
    return vector_search.box_bounds(rows, q, "label").select("label", F.round("bound", 6).alias("bound"))


@register("vector_rotated", (296,), """SELECT vec_id, ROUND(sqrt(2 / len(e)) * list_sum(list_transform(range(1, len(e) + 1), lambda j: e[j] * cos(pi() * (2 * j - 1) * 5 / (2 * len(e))))), 6) AS fifth
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")  # fmt: skip
def vector_rotated(spark, d):
    """The transform's fifth component, the signs taken back first."""
    rows = table(spark, d, "embeddings")
    dim = len(rows.filter("vec_id = 0").first()["embedding"])
    m = vector_search.signed_dct(dim, 5)
    signs = np.sign(m[0])  # the first row has one size throughout
    turned = vector_search.rotate(rows, m * signs)
    return turned.select("vec_id", F.round(F.get("rotated", F.lit(5)), 6).alias("fifth"))


@register("graph_csr", (298,), "SELECT o_custkey, degree, CAST(SUM(degree) OVER (ORDER BY o_custkey) - degree AS BIGINT) AS first FROM (SELECT o_custkey, COUNT(*) AS degree FROM orders GROUP BY 1)")
def graph_csr(spark, d):
    return graph.offsets(table(spark, d, "orders").select("o_custkey"), "o_custkey").select("o_custkey", "degree", "first")


@register("graph_expand", (299,), "SELECT s.k, o_orderkey FROM (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 7) s JOIN orders ON o_custkey = s.k WHERE o_orderpriority = '1-URGENT'")
def graph_expand(spark, d):
    sources = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("k")).unionAll(spark.range(1).select(F.lit(7).cast("bigint")))
    return graph.expand(sources, table(spark, d, "orders"), "k", "o_custkey", "o_orderkey", c("o_orderpriority") == "1-URGENT").select("k", "o_orderkey")


@register("graph_hops", (299,), "SELECT DISTINCT 'r' || n_regionkey AS node, 2 AS hop FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def graph_hops(spark, d):
    """From customers over nations to regions."""
    name = lambda kind, k: F.concat(F.lit(kind), c(k).cast("string"))
    customers, nations = table(spark, d, "customer"), table(spark, d, "nation")
    edges = customers.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")).unionAll(nations.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    sources = customers.filter("c_mktsegment = 'BUILDING'").select(name("c", "c_custkey").alias("k"))
    return graph.hops(sources, edges, "k", "src", "dst", 2).filter("hop = 2").select("node", "hop")


@register("chat_template", (305,), "SELECT conv_id, string_agg(role || ': ' || COALESCE(text, '') || CASE WHEN last THEN '' ELSE chr(10) END, '' ORDER BY turn) AS prompt FROM (SELECT *, turn = MAX(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY 1")
def chat_template(spark, d):
    source = "{% for m in messages %}{{ m.role }}: {{ m.text | default('') }}{% if not loop.last %}\n{% endif %}{% endfor %}"
    return templates.render_groups(table(spark, d, "conversations"), ["conv_id"], ["turn"], ["role", "text"], "messages", source, "prompt")


@register("token_sampling", (306, 307))
def token_sampling(spark, d):
    """Sampling from penalized logits: the vector's components, draws from the id."""
    logits = c("embedding")
    counts = F.transform(logits, lambda x, i: (i == 2).cast("int"))
    draw = (c("vec_id") % 100 + 0.5) / 100
    return table(spark, d, "embeddings").select("vec_id", V.sample(V.penalize(logits, counts, 1.2, 0.1, 0.05), draw, 5, 0.8, 0.05, 0.9).alias("token"))


@register("tensor_helpers", (308,), """SELECT vec_id, ROUND(list_max(list_transform(e, lambda v: exp(v - list_max(e)))) / list_sum(list_transform(e, lambda v: exp(v - list_max(e)))), 6) AS sm,
    ROUND(e[1] / sqrt(list_inner_product(e, e) / len(e) + 1e-6), 6) AS rms, ROUND(e[1] / (exp(-e[1]) + 1) * e[2], 6) AS sg, ROUND(e[1] + 2 * e[2], 6) AS mv FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")  # fmt: skip
def tensor_helpers(spark, d):
    e = c("embedding").cast("array<double>")
    two = F.transform(e, lambda x, i: F.get(e, i + 1))
    made = {"sm": F.array_max(V.softmax(e)), "rms": F.get(V.rms_norm(e), F.lit(0)), "sg": F.get(V.swiglu(e, two), F.lit(0)), "mv": F.get(V.mat_vec([[1.0, 2.0]], F.slice(e, 1, 2)), F.lit(0))}
    return table(spark, d, "embeddings").select("vec_id", *[F.round(v, 6).alias(k) for k, v in made.items()])


@register("tensor_rope", (308,), "SELECT vec_id, true AS kept FROM embeddings")
def tensor_rope(spark, d):
    """Rotary positions keep norms."""
    e = c("embedding").cast("array<double>")
    turned = V.rope(e, c("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", (F.abs(V.inner_product(turned, turned) - V.inner_product(e, e)) < 1e-9).alias("kept"))


@register("tensor_rope_values", (308,), """SELECT vec_id, ROUND(list_sum(list_transform(range(len(e)), lambda i: (i + 1) * (e[i + 1] * cos(vec_id / pow(10000.0, (i - i % 2) / len(e))) + CASE WHEN i % 2 = 0 THEN -e[i + 2] ELSE e[i] END * sin(vec_id / pow(10000.0, (i - i % 2) / len(e)))))), 4) AS turned
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")  # fmt: skip
def tensor_rope_values(spark, d):
    """Each rotated component, weighed by its place."""
    e = c("embedding").cast("array<double>")
    turned = F.transform(V.rope(e, c("vec_id")), lambda x, i: x * (i + 1))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(turned, F.lit(0.0), lambda a, x: a + x), 4).alias("turned"))


@register("zone_maps", (311,), "SELECT zone, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_totalprice IS NULL) AS nulls FROM (SELECT *, o_orderkey // 1000 AS zone FROM orders) GROUP BY 1 HAVING MAX(o_totalprice) >= 100000 AND MIN(o_totalprice) <= 200000")
def zone_maps(spark, d):
    zones = table(spark, d, "orders").groupBy(F.floor(c("o_orderkey") / 1000).alias("zone")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("*").alias("n"), F.count_if(c("o_totalprice").isNull()).alias("nulls"))
    return zones.filter("hi >= 100000 AND lo <= 200000")


@register("udf_surface", (304,), "SELECT o_orderkey, o_totalprice * 1.1 AS scaled FROM orders WHERE o_orderkey % 2 = 0")
def udf_surface(spark, d):
    """A vectorized function over Arrow batches, as callers pass their own."""
    return udf_surface_all(spark, d).filter("o_orderkey % 2 = 0")


@register("udf_surface_all", (304,), "SELECT o_orderkey, o_totalprice * 1.1 AS scaled FROM orders")
def udf_surface_all(spark, d):
    """The function on all orders; udf_surface keeps to the even keys of its SQL."""
    scale = F.pandas_udf(lambda s: s * 1.1, "double")
    return table(spark, d, "orders").select("o_orderkey", scale("o_totalprice").alias("scaled"))


@register("asof_join", (), "SELECT a.event_id, b.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof(spark, d):
    from ..operators.joins import asof_join

    events = table(spark, d, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return asof_join(left, right, ["user_id"], "ts", "value", "last_view").select("event_id", "last_view")



