"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans of fixed patterns for four kinds. The two words before a
span are its lexical pattern. Other tokens with a digit or an at sign, and runs
of digit groups over several tokens, are candidates with patterns of their own. Patterns and instances form a graph:
a pattern's confidence in a kind is the share of the kind in its distinct
instances, an instance's the noisy-or over its confident patterns; Spark scores
both in turn for ROUNDS rounds, and a candidate after a confident pattern is
found if its own confidence and its shape fit.

Base spans are row-local. Patterns and instances are counted by partial
aggregates, so a frequent pattern never meets in one task, and the graph keeps
only patterns that enough different seeds support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the fixed patterns: they match the same spans, in linear time and bounded stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?<=[0-9])(?:\.|$)){4}$"
#: Stands for each character of a base span where candidates are sought; a private-use character.
MASK = "\ue000"
#: A token of digit groups only, less the punctuation behind it; a run of them with single spaces between; any token with a digit or an at sign.
GROUPS = rf"\(?+[0-9]++(?:[().-]{{1,2}}+[0-9]++)*+\)?+(?=[^\s0-9@{MASK}\p{{L}}]*+(?!\S))"
RUN = rf"[^\s0-9@{MASK}\p{{L}}+(]*+\+?+{GROUPS}(?:\x20{GROUPS})*+\S*+"
CANDIDATE = rf"(?<!\S)(?:{RUN}|[^\s0-9@]*+[0-9@]\S*+)"
#: Shapes that an unseen identifier of a kind may have.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^(?=.*[0-9])(?:[0-9A-Fa-f]{0,4}[:.]){2,7}[0-9A-Fa-f]{0,4}$",
    "card": r"^[0-9](?:[0-9\x20-]*[0-9])$",
    "phone": r"^\+?[0-9(](?:[0-9().\x20-]*[0-9])$",
}
DIGITS = {"email": (0, 10**6), "ip": (1, 39), "card": (12, 19), "phone": (7, 15)}
CONTEXT_CHARS, CONTEXT_WORDS = 64, 2
#: Different seeds that a pattern needs, and the confidence for a pattern to vote and for a candidate to be found.
MIN_SEEDS, VOTE, FOUND, ROUNDS = 4, 0.5, 0.8, 3
#: Values folded at once, and characters of a chunk that texts are cut from.
BLOCK, CHUNK = 128, 512


def running(values: Column, add, zero: Column) -> Column:
    """For each of an array's values the fold of those before it: blocks first, then within blocks, so that no long array grows value by value."""
    def befores(items, first):
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def cut(held):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int")), lambda b: F.slice(held, b * BLOCK + 1, F.lit(BLOCK)))

    def folded(blocks):  # each block's fold from zero, and what stands before it
        return F.flatten(F.zip_with(blocks, befores(F.transform(blocks, lambda x: F.aggregate(x, zero, add)), zero), befores))

    return once(values, lambda held: F.when(F.size(held) > 0, once(cut(held), folded)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, t, before>>: start, end, text, and the gap before.

    Code points, end exclusive; found from the matches and the gaps between them, in time linear in the text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("t"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("before"))

    def placed(pairs: Column) -> Column:
        starts = running(F.transform(pairs, lambda m: F.char_length(m["t"]) + F.char_length(m["before"])), lambda a, x: a + x, F.lit(0))
        return F.zip_with(pairs, starts, lambda m, at: F.struct((at + F.char_length(m["before"])).alias("s"), (at + F.char_length(m["before"]) + F.char_length(m["t"])).alias("e"), m["t"].alias("t"), m["before"].alias("before")))

    return once(pairs, placed)


def once(value: Column, fn) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def replaced(text: Column, found: Column, piece) -> Column:
    """The text with piece(m, from, fresh) for each span m of an array by start; `from`: where what is new of m begins, `fresh`: whether m overlaps none before it.

    The text is cut from chunks of CHUNK characters, so that a place far on costs no more than one near the start.
    """

    def of(chunks: Column) -> Column:
        def cut(a, b):  # characters a..b-1
            i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
            head = F.substring(F.get(chunks, i), a - i * CHUNK + 1, F.lit(CHUNK))
            tail = F.substring(F.coalesce(F.get(chunks, j), F.lit("")), F.lit(1), b - j * CHUNK)
            same = F.substring(F.coalesce(F.get(chunks, i), F.lit("")), a - i * CHUNK + 1, b - a)
            inner = F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
            return F.when(a >= b, "").when(i == j, same).otherwise(F.concat(head, inner, tail))

        def put(spans: Column) -> Column:
            ends = running(F.transform(spans, lambda x: x["m"]["e"]), lambda a, x: F.greatest(a, x), F.lit(0))
            made = F.zip_with(spans, ends, lambda x, at: F.concat(cut(at, F.greatest(at, x["m"]["s"])), piece(x["m"], F.greatest(at, x["m"]["s"]), x["m"]["s"] >= at)))
            last = F.array_max(F.transform(spans, lambda x: x["m"]["e"]))
            length = (F.size(chunks) - 1) * CHUNK + F.char_length(F.element_at(chunks, -1))
            return F.concat(F.array_join(made, ""), cut(last, length))

        return once(F.transform(found, lambda m: F.struct(m.alias("m"))), put)

    return F.when(F.size(found) > 0, once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), of)).otherwise(text)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(number)

    def add(total, i):
        d = F.substring(number, n - i, 1).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(IP_PARTS)
    if kind == "card":
        n = F.char_length(digits(text))
        return F.when(n.between(14, 19), luhn(digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits(text)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Fixed-pattern spans as array<struct<s, k, e, t, before>>, by start, then kind."""

    def of(k: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["t"]))
        made = F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), m["t"].alias("t"), m["before"].alias("before")))
        test = text.contains(NEEDED[kind]) if NEEDED[kind] else text.rlike("[0-9][ -]?[0-9]")
        return F.when(test, made).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,t:string,before:string>>"))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def context(before: Column) -> Column:
    """The last words of the gap before a span, letters only, in lower case; empty if there are too few."""
    words = F.filter(F.split(F.lower(F.substring(before, -CONTEXT_CHARS, CONTEXT_CHARS)), r"\s+"), lambda w: w != "")
    letters = F.transform(F.slice(words, -CONTEXT_WORDS, CONTEXT_WORDS), lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
    return F.when(F.size(words) >= CONTEXT_WORDS, F.concat_ws(" ", letters)).otherwise("")


def _scan(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, key, base, loose): base spans, and candidates that overlap none, with contexts instead of gaps.

    A token that a base span is in, or that holds the character MASK, is no candidate. A run ends at a base span. It is a candidate as a whole if that has the shape of a kind, or else its first token is.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("key"), "text", base_spans(F.col("text")).alias("raw"))
    base = F.transform("raw", lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e"), m["t"].alias("t"), context(m["before"]).alias("p")))

    def trimmed(m):  # less the punctuation around it
        lead = F.char_length(m["t"]) - F.char_length(F.regexp_replace(m["t"], r"^[^\p{L}0-9+(]+", ""))
        body = F.regexp_replace(F.regexp_replace(m["t"], r"^[^\p{L}0-9+(]+", ""), r"[^\p{L}0-9]+$", "")
        return F.struct((m["s"] + lead).alias("s"), (m["s"] + lead + F.char_length(body)).alias("e"), body.alias("t"), context(m["before"]).alias("p"))

    def fitting(m):
        whole = trimmed(m)["t"]
        shaped = _fits("card", whole) | _fits("phone", whole)
        first = F.struct(m["s"].alias("s"), (m["s"] + F.char_length(F.substring_index(m["t"], " ", 1))).alias("e"), F.substring_index(m["t"], " ", 1).alias("t"), m["before"].alias("before"))
        return F.when(m["t"].contains(" ") & ~shaped, first).otherwise(m)

    masked = replaced(F.col("text"), F.col("base"), lambda m, at, fresh: F.repeat(F.lit(MASK), F.greatest(m["e"] - at, F.lit(0))))
    rows = rows.withColumn("base", base).withColumn("masked", masked)
    apart = F.filter(matches(F.col("masked"), CANDIDATE), lambda m: ~m["t"].contains(MASK))
    loose = F.filter(F.transform(F.transform(apart, fitting), trimmed), lambda m: (m["p"] != "") & (m["e"] > m["s"]))
    return rows.select("id", "key", "base", F.when(F.col("text").rlike("[0-9@]"), loose).otherwise(F.array().cast("array<struct<s:int,e:int,t:string,p:string>>")).alias("loose"))


def _fits(kind: str, text: Column) -> Column:
    low, high = DIGITS[kind]
    return text.rlike(SHAPES[kind]) & F.char_length(digits(text)).between(low, high)


def discovered(scanned: DataFrame) -> DataFrame:
    """(id, key, s, k, e) of the candidates that the graph finds."""
    seeds = scanned.select(F.explode("base").alias("m")).select(F.col("m.p").alias("p"), F.col("m.t").alias("t"), F.col("m.k").alias("k")).filter("p <> ''").distinct()
    support = checkpoint(seeds.groupBy("p", "k").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= MIN_SEEDS))
    if support.isEmpty():  # no pattern, so no candidate is heard
        return scanned.limit(0).select("id", "key", *[F.lit(0).alias(c) for c in ("s", "k", "e")])
    named = F.filter(F.array(*[F.when(_fits(kind, F.col("t")), F.lit(k)) for k, kind in enumerate(KINDS)]), lambda x: x.isNotNull())
    loose = scanned.select("id", "key", F.explode("loose").alias("m")).select("id", "key", "m.s", "m.e", F.col("m.t").alias("t"), F.col("m.p").alias("p"))
    loose = checkpoint(loose.join(support.select("p").distinct(), "p", "left_semi"))
    pairs = loose.select("p", "t").distinct()
    total = pairs.groupBy("p").agg(F.count("*").alias("loose")).withColumnRenamed("p", "q")
    all_seeds = seeds.join(support.select("p").distinct(), "p", "left_semi").groupBy("p").agg(F.count_distinct("t").alias("n")).withColumnRenamed("p", "r")
    base = support.join(all_seeds, F.col("p") == F.col("r")).join(total, F.col("p") == F.col("q"), "left").select("p", "k", "seeds", (F.col("n") + F.coalesce("loose", F.lit(0))).alias("n"))
    edges = pairs.select("p", "t", F.explode(named).alias("k"))
    pattern = base.select("p", "k", (F.col("seeds") / F.col("n")).alias("c"))
    for _ in range(ROUNDS):
        voted = edges.join(pattern.filter(F.col("c") >= VOTE), ["p", "k"])
        instance = voted.groupBy("t", "k").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))).alias("ci"))
        heard = edges.join(instance, ["t", "k"]).groupBy("p", "k").agg(F.sum("ci").alias("more"))
        pattern = checkpoint(base.join(heard, ["p", "k"], "left").select("p", "k", ((F.col("seeds") + F.coalesce("more", F.lit(0.0))) / F.col("n")).alias("c")))
    voted = edges.join(pattern.filter(F.col("c") >= VOTE), ["p", "k"])
    instance = voted.groupBy("t", "k").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))).alias("ci"))
    good = edges.join(pattern.filter(F.col("c") >= FOUND), ["p", "k"]).join(instance.filter(F.col("ci") >= FOUND), ["t", "k"]).groupBy("p", "t").agg(F.min("k").alias("k"))
    return loose.join(good, ["p", "t"]).select("id", "key", "s", "k", "e")


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda m: F.concat_ws(":", F.get(name, m["k"]), m["s"].cast("string"), m["e"].cast("string"))))


def _found_by_row(scanned: DataFrame) -> DataFrame:
    return discovered(scanned).groupBy("id", "key").agg(F.collect_list(F.struct("s", "k", "e")).alias("more"))


def _with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("id").alias("f_id"), F.col("key").alias("f_key"), "more")
    return rows.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left").drop("f_id", "f_key")


def spans(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, key, base, spans) for each row: arrays of struct<s, k, e>, k an index of KINDS, by start, then kind.

    Null text: like an empty one, no spans. Equal rows have equal spans; rows
    without an id take part. An empty table gives no rows.
    """
    scanned = checkpoint(_scan(df, text, doc_id))
    rows = scanned.select("id", "key", F.transform("base", lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e"))).alias("base"))
    rows = _with_found(rows, _found_by_row(scanned).distinct())
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return rows.select("id", "key", "base", F.array_sort(F.concat("base", F.array_distinct(F.coalesce("more", none)))).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span's label in its place; spans that run into one another get one label."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, found, lambda m, at, fresh: F.when(fresh, F.get(labels, m["k"])).otherwise(""))


def redact(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with its columns, personal data in the text replaced by labels; a null text stays null."""
    found = _found_by_row(checkpoint(_scan(df, text, doc_id)))
    key, more, mine = (free_name(df, n) for n in ("text_key", "found_more", "found_all"))
    rows = df.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    found = found.select(F.col("id").alias("f_id"), F.col("key").alias("f_key"), F.array_distinct("more").alias(more))
    rows = rows.join(found, rows[f"`{doc_id}`"].eqNullSafe(F.col("f_id")) & (rows[key] == F.col("f_key")), "left").drop("f_id", "f_key")
    base = F.transform(base_spans(F.col(f"`{text}`")), lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))
    rows = rows.withColumn(mine, F.array_sort(F.concat(base, F.coalesce(more, F.array().cast("array<struct<s:int,k:int,e:int>>")))))
    new = F.when(F.size(mine) > 0, redacted(F.col(f"`{text}`"), F.col(mine))).otherwise(F.col(f"`{text}`"))
    return rows.select(*[new.alias(c) if c.lower() == text.lower() else rows[f"`{c}`"] for c in df.columns])


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = spans(docs)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda m: m["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
