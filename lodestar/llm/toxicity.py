"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams
(hashed, with word edges) and of itself; a bag is a few consecutive words and
its vector their mean; a softmax over two classes follows. Embeddings and
softmax are trained jointly in numpy. A text is as toxic as its worst bag, so a
few words in a long text count as much as in a short one; in training a text's
bags share its label by attention that sharpens from the mean to the worst bag.
Since the softmax is linear, a trained model folds into one number per n-gram.

Training takes at most SAMPLE labelled rows (half of either class, by hash of
the id) in one task, whole texts of at most LONGEST bytes and together of at
most SAMPLE_BYTES; an id counts once. Scoring is a narrow stage over whole texts
of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, U64, Words, arrow_schema, crc_mod, free_name, mix64, ngram_hashes, release, slices, small_batches, text_buffer

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 2_400
#: Bytes of their texts, half of either class, and of one of them, at most: training takes about 30 bytes of memory for each.
SAMPLE_BYTES, LONGEST = 16_000_000, 256_000
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
BAG = 3
STEPS = 80
RATE = 0.07
THRESHOLD = 0.7
#: Distinct words whose n-grams are worked on at once.
PART = 20_000


def subwords(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the chosen words' n-grams, one word after the other, and the number of each word."""
    size = words.end[which] - words.start[which] + 2
    to = np.cumsum(size)
    first = to - size
    buf = np.empty(int(to[-1]) if len(to) else 0, np.int64)
    inner = np.ones(len(buf), bool)
    inner[first], inner[to - 1] = False, False
    at = np.arange(int((size - 2).sum())) + np.repeat(words.start[which] - np.cumsum(np.concatenate([[0], size[:-1] - 2])), size - 2)
    buf[inner] = words.buf[at]
    buf[first], buf[to - 1] = 256, 257
    code = np.concatenate([_BYTE, mix64(np.array([1001, 1002], U64))])[buf]
    word = np.repeat(np.arange(len(which), dtype=np.int32), size)
    left = (np.repeat(to, size) - np.arange(len(buf))).astype(np.int32)  # bytes from here to the word's end
    ids, owner = [], []
    for n in GRAMS:
        h = ngram_hashes(code, n)
        ok = left[: len(h)] >= n
        ids.append((h[ok] % U64(BUCKETS)).astype(np.int32))
        owner.append(word[: len(h)][ok])
        del h, ok
    h = np.add.reduceat(code * mix64(np.arange(len(buf), dtype=U64) - np.repeat(first, size).astype(U64) + U64(7)), first) if len(first) else np.zeros(0, U64)
    ids.append((mix64(h) % U64(BUCKETS)).astype(np.int32))
    owner.append(np.arange(len(which), dtype=np.int32))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(which))


def bag_sums(scores: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean score of each bag of BAG words, the first word of each, and each text's number of bags.

    A text of fewer words is one bag of them all; one without words has none.
    """
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    bags = np.where(count > 0, np.maximum(count - BAG + 1, 1), 0)
    start = np.arange(int(bags.sum())) + np.repeat(first - (np.cumsum(bags) - bags), bags)
    end = np.minimum(start + BAG, np.repeat(first + count, bags))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return (total[end] - total[start]) / (end - start), start, bags


def _tokens(buf: np.ndarray, offsets: np.ndarray):
    words = Words(buf, offsets, lower=True)
    inverse = words.encoded()[1]
    first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1))  # words are numbered by first use
    made = [subwords(words, first[at : at + 10_000]) for at in range(0, len(first), 10_000)]
    ids = np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.int32)
    n = np.concatenate([m[1] for m in made]) if made else np.zeros(0, np.int64)
    return words.count, inverse, ids, n


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> np.ndarray:
    """One number per n-gram bucket and the bias, float32; with no rows of a class, a model that rejects nothing."""
    out = np.zeros(BUCKETS + 1, np.float32)
    out[-1] = -4.0
    if not len(toxic) or toxic.min() == toxic.max():
        return out
    count, inverse, ids, n = _tokens(*text_buffer(texts))
    keep = count > 0
    y, text_words = toxic[keep].astype(np.float64), count[keep]
    if not len(y):
        return out
    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.array([0.0, -2.0])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    used = np.flatnonzero(np.bincount(ids, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    local = place[ids]
    del ids, place
    emb = emb[used]
    params = [emb, soft, bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        side = soft[:, 1] - soft[:, 0]
        gram, word = emb @ side, np.empty(len(n))
        for at in range(0, len(n), PART):
            first, last = int(starts[at]), int(starts[min(at + PART, len(n)) - 1] + n[min(at + PART, len(n)) - 1])
            word[at : at + PART] = np.add.reduceat(gram[local[first:last]], starts[at : at + PART] - first)
        word /= n
        z, start, bags = bag_sums(word[inverse], text_words)
        z = z + bias[1] - bias[0]
        first = np.concatenate([[0], np.cumsum(bags)[:-1]])
        sharp = min(8.0, 8.0 * step / (0.5 * STEPS))
        top = np.maximum.reduceat(z, first)
        a = np.exp(np.minimum(0, (z - np.repeat(top, bags)) * sharp))
        a /= np.repeat(np.add.reduceat(a, first), bags)
        pooled = np.add.reduceat(a * z, first)
        g = (1 / (1 + np.exp(-pooled)) - y) * weight
        # bags -> words -> distinct words -> n-grams
        gb = a * np.repeat(g, bags)
        end = np.minimum(start + BAG, np.repeat(np.cumsum(text_words), bags))
        gb = gb / (end - start)
        flow = np.bincount(start, gb, len(inverse) + 1) - np.bincount(end, gb, len(inverse) + 1)
        gw = np.bincount(inverse, np.cumsum(flow)[:-1], len(n)) / n
        del z, a, gb, end, start, flow
        gg = np.zeros(len(used))
        for at in range(0, len(n), PART):
            some, first = n[at : at + PART], int(starts[at])
            gg += np.bincount(local[first : first + int(some.sum())], np.repeat(gw[at : at + PART], some), len(used))
        d_side = emb.T @ gg
        grads = [gg[:, None] * side, np.stack([-d_side, d_side], 1) + 1e-5 * soft, np.array([-g.sum(), g.sum()])]
        for i, (p, d) in enumerate(zip(params, grads)):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.98 * v[i] + 0.02 * d * d
            p -= RATE * min(1.0, 2 * (1 - step / (STEPS + 1))) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.98**step)) + 1e-8)
    # buckets that no training text has keep their first value, whose mean is zero
    out[:-1][used] = emb @ (soft[:, 1] - soft[:, 0])
    out[-1] = bias[1] - bias[0]
    return out


def score_buffer(buf: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    count, inverse, ids, n = _tokens(buf, offsets)
    worst = np.full(len(count), 0.0)
    if len(inverse):
        word = np.add.reduceat(model[ids].astype(np.float64), np.concatenate([[0], np.cumsum(n)[:-1]])) / n
        z, _, bags = bag_sums(word[inverse], count)
        some = bags > 0
        worst[some] = np.maximum.reduceat(z, (np.cumsum(bags) - bags)[some])
    return 1 / (1 + np.exp(-np.clip(worst + model[-1], -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> np.ndarray:
    """Fits on at most `sample` labelled rows whose crc32(id) mod 3 is not 1, half of either class.

    Of rows that repeat an id the least text stands for all; one that is null
    or over LONGEST bytes is not learnt from. Rows are taken by hash of the id
    while they fit into a class's half of SAMPLE_BYTES.
    """
    label = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    label = label.filter(crc_mod("doc_id", 3) != 1)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picks = [label.filter(F.col("toxic") == k).orderBy(*order).limit(sample // 2) for k in (0, 1)]
    chosen = picks[0].unionAll(picks[1]).select(F.col("doc_id").alias("l_id"), "toxic")  # at most `sample` rows
    small_batches(docs.sparkSession)
    mine = docs.select(F.col(f"`{doc_id}`").alias("l_doc"), F.col(f"`{text}`").alias("l_text"))
    rows = mine.join(F.broadcast(chosen), F.col("l_doc") == F.col("l_id")).filter(F.octet_length("l_text") <= LONGEST)
    rows = rows.groupBy("l_doc", "toxic").agg(F.min("l_text").alias("l_text"))  # an id's copies meet after a partial aggregate
    so_far = F.sum(F.octet_length("l_text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("l_doc"), "l_doc").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("l_bytes", so_far).filter(F.col("l_bytes") <= SAMPLE_BYTES // 2).select("l_doc", "l_text", "toxic")

    def run(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("l_doc", pa.int64()), ("l_text", pa.string()), ("toxic", pa.int32())]))
        table = table.sort_by([("l_doc", "ascending"), ("l_text", "ascending")])
        model = train(table["l_text"].combine_chunks(), table["toxic"].to_numpy())
        del table
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])

    rows = rows.select(F.col("l_doc").cast("bigint"), "l_text", F.col("toxic").cast("int"))
    got = rows.repartition(1).mapInArrow(run, "model binary").collect()  # one row of fixed size, none for no labels
    return np.frombuffer(got[0]["model"], np.float32) if got else train(pa.array([], pa.string()), np.zeros(0, np.int32))


def score(df: DataFrame, model: np.ndarray, text: str = "text", to: str = "score") -> DataFrame:
    """Adds each whole text's score. Null and empty texts get the model's bias.

    Other columns pass through, one of the added name is replaced; repeated
    rows stay; an empty table gives no rows.
    """
    rest = [c for c in df.columns if c.lower() != to.lower()]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(to, T.DoubleType())])
    names, column = arrow_schema(schema), next(i for i, c in enumerate(rest) if c.lower() == text.lower())
    held = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 1 numbers

    small_batches(df.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, whole.schema.names[column], 1_000_000):
                made = score_buffer(*text_buffer(batch.column(column)), held.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], schema=names)
            release()

    return df.select(*[df[f"`{c}`"] for c in rest]).mapInArrow(run, schema)


def clean(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under the threshold, unchanged."""
    key = free_name(df, "toxicity")
    return score(df, fit(df, labels, text, doc_id), text, key).filter(F.col(key) < threshold).drop(key)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
