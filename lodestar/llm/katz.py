"""Language-model scores by Katz backoff over words.

The model has n-grams of `order` words at most; one whose n-gram was not seen
backs off to the history less its first word, down to words and then to one
class of unknown words. Counts up to K are discounted by Good-Turing; a
history's left-over mass goes to the words not seen after it, in proportion to
their probability one order below, so that each history's probabilities sum to
one exactly.

The model lives in tables partitioned by hash, a table an order. Chunks of
documents ask the tables about their distinct words, which are compared by
their bytes and get numbers; then about their distinct pairs of numbers, which
get numbers in turn, and so on (chunks.py): nothing is told apart by hashes, and
map-side counting comes before any exchange. Evaluation goes up the same
orders, each token's probability from its n-gram's answer or its backoff. A
task holds one chunk or one part. A history with more than a thousandth of all
tokens is split over all parts by the next word, and its sums meet in a small
aggregate.
"""

from __future__ import annotations

import json
import pickle
import struct
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import U64, Words, arrow_schema, crc_mod, mix64, pack_bytes, pack_ints, pack_sorted, text_buffer, unpack_bytes, unpack_ints, unpack_sorted

K = 5
#: A history of this share of the tokens is dealt out by the next word.
HOT_SHARE = 1024
CHUNK_BYTES = 8_000_000
ORDER = 2
#: Words hold no white space, so these name the end of a text and the history of its first token.
END, START = b"\n", b"\t"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def blobs(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def unblobs(raw: bytes, n: int) -> list[bytes]:
    size = struct.unpack_from(f"<{n}Q", raw)
    at, out = 8 * n, []
    for s in size:
        out.append(raw[at : at + s])
        at += s
    return out


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount factors d[0..K] from the numbers of types seen 1..K+1 times; d[0] is unused.

    Where those numbers give no factor between 0 and 1, half a count is taken off instead.
    """
    d = 1 - 0.5 / np.arange(1, K + 1)
    if n[0] > 0:
        top = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and n[r] > 0 and top < 1:
                x = ((r + 1) * n[r] / (n[r - 1] * r) - top) / (1 - top)
                if 0 < x < 1:
                    d[r - 1] = x
    return np.concatenate([[1.0], d])


class Unigrams:
    """Word probabilities: discounted counts, and the rest of the mass for the unknown."""

    def __init__(self, n: int, v: int, r: list[int]):
        self.n, self.v, self.d = n, v, discounts(r)
        lost = sum((1 - self.d[i]) * i * r[i - 1] for i in range(1, K + 1))
        if n == 0:
            self.unknown, self.scale = 1.0, 0.0
        elif lost > 0:
            self.unknown, self.scale = lost / n, 1.0
        else:
            self.unknown, self.scale = 1 / (n + 1), n / (n + 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        seen = self.d[np.where(count <= K, count, 0)] * count / max(1, self.n) * self.scale
        return np.where(count > 0, seen, self.unknown)


def left_over(d: np.ndarray, total: np.ndarray, none: np.ndarray, few: np.ndarray) -> np.ndarray:
    """The mass that histories keep to back off with.

    total: their counts; few: [.., K] numbers of successors seen 1..K times;
    none: whether there are no such, so that no count is discounted. Then one
    more than the total is divided by, and the one backs off.
    """
    left = (few * ((1 - d[1:]) * np.arange(1, K + 1))).sum(axis=-1) / np.maximum(total, 1)
    return np.where(none, 1 / (total + 1), left)


class Level:
    """A chunk's distinct n-grams of one order: their history (an n-gram of the order below) and word, what they back off to, and training counts."""

    def __init__(self, which, history, word, lower, mine):
        self.which = which  # of each token, -1 where it stands too near the start of its text
        self.history, self.word, self.lower, self.mine = history, word, lower, mine


class Tokens:
    """A chunk's tokens by document, and its levels."""

    def __init__(self, batch: pa.RecordBatch):
        words = Words(*text_buffer(batch.column(1)), lower=True)
        distinct, index = words.encoded()
        self.names = [*distinct.to_pylist(), END, START]
        self.count = words.count + 1
        self.doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), self.count)
        last = np.cumsum(self.count) - 1
        token = np.full(len(self.doc), len(distinct), np.int64)
        word = np.ones(len(self.doc), bool)
        word[last] = False
        token[word] = index
        self.train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        self.weight = self.train[self.doc]
        self.place = np.arange(len(token)) - np.repeat(last + 1 - self.count, self.count)
        self.levels = [Level(token, None, None, None, np.bincount(token[self.weight], minlength=len(self.names)))]

    def level(self, k: int) -> Level:
        """The n-grams of k words; a text's first token has the history START, and none longer."""
        while len(self.levels) < k:
            n, below, word = len(self.levels) + 1, self.levels[-1].which, self.levels[0].which
            at = np.flatnonzero(self.place >= n - 2)
            history = np.where(self.place[at] > 0, below[at - 1], len(self.names) - 1)
            pair, first, which = np.unique(history * len(self.names) + word[at], return_index=True, return_inverse=True)
            every = np.full(len(word), -1, np.int64)
            every[at] = which
            mine = np.bincount(which[self.weight[at]], minlength=len(pair))
            self.levels.append(Level(every, pair // len(self.names), pair % len(self.names), below[at[first]], mine))
        return self.levels[k - 1]


def _ranges(part: np.ndarray, hot: np.ndarray) -> list[tuple[str, int, int, int]]:
    """(kind, part, first, last) of the runs of equal part and kind."""
    if not len(part):
        return []
    edge = np.concatenate([[0], np.flatnonzero((np.diff(part) != 0) | (np.diff(hot) != 0)) + 1, [len(part)]]).tolist()
    return [("hot" if hot[a] else "plain", int(part[a]), a, b) for a, b in zip(edge, edge[1:])]


class Model:
    """What the tables have answered a chunk so far: by level, numbers and counts of its n-grams, and what its histories keep."""

    def __init__(self, tokens: Tokens, parts: int, rows: list[tuple]):
        """rows: (level, part, kind, a, b, c) and, of level zero, what the whole corpus says of each level."""
        self.tokens, self.parts, self.rows = tokens, parts, rows
        self.said = [json.loads(r[3]) for r in sorted((r for r in rows if r[0] == 0), key=lambda r: r[1])]
        self.by = {r[:3]: r[3:] for r in rows if r[0]}
        self.id, self.total, self.p, self.sums, self.none = [], [], [], [], []
        for k in range(1, len(self.said) + 1):
            self._words() if k == 1 else self._grams(k)

    def word_plan(self):
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, self.tokens.names), U64, len(self.tokens.names))
        part = (hashed % U64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, _ranges(part[order], np.zeros(len(order), np.int8))

    def plan(self, k: int):
        """The order that level k is asked in, and runs of it by part."""
        level = self.tokens.level(k)
        size = self.total[k - 2].copy()
        if k == 2:
            size[-1] = size[-2]  # as many texts begin as end
        hot = (size * HOT_SHARE >= max(1, self.said[0]["n"]))[level.history]
        history, word = self.id[k - 2][level.history], self.id[0][level.word]
        part = (mix64(np.where(hot, ~word, history).astype(U64)) % U64(self.parts)).astype(np.int64)
        order = np.lexsort((word, history, hot, part))
        return order, _ranges(part[order], hot[order].astype(np.int8))

    def _words(self):
        n = len(self.tokens.names)
        ids, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order, plan = self.word_plan()
        for kind, p, a, b in plan:
            local, counts, _ = self.by[1, p, kind]
            ids[order[a:b]] = unpack_ints(local, np.int64) * self.parts + p
            total[order[a:b]] = unpack_ints(counts, np.int64)
        said = self.said[0]
        self.uni = Unigrams(said["n"], said["v"], said["r"])
        self._add(ids, total, self.uni.p(total), None, None)

    def _add(self, *values):
        for held, value in zip((self.id, self.total, self.p, self.sums, self.none), values):
            held.append(value)

    def _grams(self, k: int):
        level, d = self.tokens.level(k), discounts(self.said[k - 1]["r"])
        order, plan = self.plan(k)
        total, ids, wide = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), len(self.id[k - 2])
        sums, none, alpha = np.zeros(wide, np.int64), np.zeros(wide, bool), np.ones(wide)
        for kind, p, a, b in plan:
            counts, about, local = self.by[k, p, kind]
            mine = order[a:b]
            total[mine] = unpack_ints(counts, np.int64)
            if local is not None:
                ids[mine] = unpack_ints(local, np.int64) * self.parts + p
            if kind == "plain":
                who = level.history[mine][_runs(level.history[mine])[0]]
                need = np.isin(who, level.history[mine][total[mine] == 0])
                both, few, covered = unblobs(about, 3)
                both = unpack_ints(both, np.int64)
                sums[who], none[who] = both >> 1, both & 1
                who = who[need]
                left = left_over(d, sums[who], none[who], unpack_ints(few, np.int64).reshape(-1, K))
                alpha[who] = np.where(sums[who] > 0, left / np.maximum(1 - unpack_ints(covered, np.float64), 1e-12), 1.0)
        hot = {x["h"]: x for x in self.said[k - 1]["hot"]}
        for i in np.flatnonzero(np.isin(self.id[k - 2], list(hot))) if hot else ():
            x = hot[int(self.id[k - 2][i])]
            few = np.array(x["n"])
            sums[i], none[i] = x["c"], x["c"] > 0 and not few.any()
            alpha[i] = left_over(d, sums[i], none[i], few) / max(1 - x["s"], 1e-12) if x["c"] else 1.0
        h = level.history
        scale = np.where(none[h], sums[h] / (sums[h] + 1), 1.0)
        seen = d[np.where(total <= K, total, 0)] * total / np.maximum(sums[h], 1) * scale
        self._add(ids, total, np.where(total > 0, seen, alpha[h] * self.p[k - 2][level.lower]), sums, none)

    def ask(self, k: int, chunk: int):
        """Messages of level k."""
        if k == 1:
            order, plan = self.word_plan()
            mine = self.tokens.levels[0].mine[order]
            return [(p, chunk, kind, pack_bytes(b" ".join([self.tokens.names[i] for i in order[a:b].tolist()])), pack_ints(mine[a:b]), None) for kind, p, a, b in plan]
        level, out = self.tokens.level(k), []
        order, plan = self.plan(k)
        history, word, mine, lower = level.history[order], level.word[order], level.mine[order], level.lower[order]
        of_lower = np.where(mine > 0, self.total[k - 2][lower], 0)  # needed where the n-gram was seen
        for kind, p, a, b in plan:
            first, size = _runs(history[a:b])
            who = history[a:b][first]
            below = b""
            if k > 2:  # the count of the history less its first word, where words were seen
                h = self.tokens.level(k - 1).history[lower[a:b][first]]
                below = pack_ints(self.sums[k - 2][h] * 2 + self.none[k - 2][h])
            grams = blobs(pack_sorted(self.id[k - 2][who].astype(U64)), pack_ints(size), below, json.dumps(self.said).encode() if k == 2 else json.dumps([{"r": x["r"]} for x in self.said]).encode())
            out.append((p, chunk, kind, grams, blobs(pack_ints(self.id[0][word[a:b]]), pack_ints(of_lower[a:b])), pack_ints(mine[a:b])))
        return [*out, (C.home_part(chunk, self.parts), chunk, "echo", pickle.dumps(self.rows), None, None)]


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equals begin, and their lengths."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.concatenate([first, [len(h)]]))


def _answer_words(part: int, rows: list) -> list[tuple]:
    """The words of a part: their numbers, the same word's the same, and counts."""
    held = [unpack_bytes(a).split(b" ") for _, _, a, _, _ in rows]
    size = [len(h) for h in held]
    which = pa.array([w for h in held for w in h], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    del held
    total = np.bincount(which, np.concatenate([unpack_ints(b, np.int64) for _, _, _, b, _ in rows])).astype(np.int64)
    order = np.argsort(-total, kind="stable")  # frequent words have small numbers
    number = np.empty(len(total), np.int64)
    number[order] = np.arange(len(total))
    out, at = [], 0
    for (chunk, kind, *_), n in zip(rows, size):
        mine = which[at : at + n]
        out.append((part, chunk, kind, pack_ints(number[mine]), pack_ints(total[mine]), None))
        at += n
    said = {"n": int(total.sum()), "v": int((total > 0).sum()), "r": np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist(), "hot": []}
    return [*out, (part, -1, "stats", json.dumps(said).encode(), None, None)]


def _answer_grams(part: int, rows: list, level: int, last: bool) -> list[tuple]:
    """The n-grams of a part: their counts and numbers, and what their histories keep."""
    out = [(part, chunk, "echo", a, b, c) for chunk, kind, a, b, c in rows if kind == "echo"]
    rest, hot_sums, base = np.zeros(K + 1, np.int64), [], 0
    for kind in ("plain", "hot"):
        asked = [r for r in rows if r[1] == kind]
        if not asked:
            continue
        histories_, sizes, below, words, of_lower, counts = ([] for _ in range(6))
        for _, _, a, b, c in asked:
            x, y, z, said = unblobs(a, 4)
            histories_.append(unpack_sorted(x))
            sizes.append(unpack_ints(y, np.int64))
            if level > 2:
                below.append(unpack_ints(z, np.int64))
            x, y = unblobs(b, 2)
            words.append(unpack_ints(x, np.int64))
            of_lower.append(unpack_ints(y, np.int64))
            counts.append(unpack_ints(c, np.int64))
        said = json.loads(said)
        known, h_of = np.unique(np.concatenate(histories_), return_inverse=True)
        h = np.repeat(h_of, np.concatenate(sizes))
        names, w = np.unique(np.concatenate(words), return_inverse=True)
        _, first, which = np.unique(h * len(names) + w, return_index=True, return_inverse=True)
        del words, w
        total = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        of, seen = h[first], total > 0
        few = np.zeros((len(known), K), np.int64)
        small = seen & (total <= K)
        np.add.at(few, (of[small], total[small] - 1), 1)
        sums = np.bincount(of, total, len(known)).astype(np.int64)
        lower = np.zeros(len(first), np.int64)
        np.maximum.at(lower, which, np.concatenate(of_lower))
        if level == 2:
            p = Unigrams(said[0]["n"], said[0]["v"], said[0]["r"]).p(lower)
        else:
            both = np.zeros(len(known), np.int64)
            np.maximum.at(both, h_of, np.concatenate(below))
            count, none = both[of] >> 1, both[of] & 1
            p = discounts(said[level - 2]["r"])[np.where(lower <= K, lower, 0)] * lower / np.maximum(count, 1) * np.where(none, count / (count + 1), 1.0)
        covered = np.bincount(of[seen], p[seen], len(known))
        rest += np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2]
        none = (sums > 0) & ~few.any(axis=1)
        at = hat = 0
        for (chunk, *_), hs, size in zip(asked, histories_, sizes):
            n, mine = int(size.sum()), h_of[hat : hat + len(hs)]
            gram, about = which[at : at + n], None
            if kind == "plain":  # what is backed off with goes to chunks that need it
                need = np.add.reduceat((total[gram] == 0).astype(np.int64), np.cumsum(size) - size) > 0
                about = blobs(pack_ints(sums[mine] * 2 + none[mine]), pack_ints(few[mine[need]].ravel()), pack_ints(covered[mine[need]]))
            out.append((part, chunk, kind, pack_ints(total[gram]), about, None if last else pack_ints(gram + base)))
            at, hat = at + n, hat + len(hs)
        if kind == "hot":
            hot_sums = [{"h": x, "c": a, "n": b, "s": c} for x, a, b, c in zip(known.astype(np.int64).tolist(), sums.tolist(), few.tolist(), covered.tolist())]
        base += len(total)
    return [*out, (part, -1, "stats", json.dumps({"n": 0, "v": 0, "r": rest.tolist(), "hot": hot_sums}).encode(), None, None)]


def _said(answers: DataFrame):
    """What the parts say of a level, summed: one JSON string. Hot histories are fewer than HOT_SHARE + 2."""
    said = answers.filter("kind = 'stats'").select(F.from_json(F.col("a").cast("string"), "n bigint, v bigint, r array<bigint>, hot array<struct<h:bigint,c:bigint,n:array<bigint>,s:double>>").alias("x"))
    sums = said.agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v"), F.array(*[F.coalesce(F.sum(F.col("x.r")[i]), F.lit(0)) for i in range(K + 1)]).alias("r"))
    hot = said.select(F.explode("x.hot").alias("y")).groupBy("y.h").agg(F.sum("y.c").alias("c"), F.array(*[F.sum(F.col("y.n")[i]) for i in range(K)]).alias("n"), F.sum("y.s").alias("s"))
    hot = hot.agg(F.collect_list(F.struct("h", "c", "n", "s")).alias("hot"))
    return sums.select(F.to_json(F.struct("n", "v", "r", hot.scalar().alias("hot"))))


def scores(df: DataFrame, train, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """RESULT for each row; `train` is a boolean Column: which rows the model learns from.

    Tokens are lower-cased (A-Z) words and one end a text. Null text: like an
    empty one, its end only. Null ids and repeated rows count like any others.
    With no training rows every token is unknown with probability one. An empty
    table gives no rows; other columns are not read. `order`: words of the
    longest n-grams, 1 or more.
    """
    source = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    parts, names = C.parts_for(df, text), arrow_schema(RESULT)
    chunks = C.packed(source, "text", "doc_id", CHUNK_BYTES)

    def heard(rows: list, level: int) -> list[tuple]:
        """The rows of all levels up to this one, from its answers and the echo of those below."""
        out = [x for r in rows if r[1] == "echo" for x in pickle.loads(r[2])]
        return [*out, (0, level, "", rows[0][-1], None, None), *[(level, r[0], *r[1:5]) for r in rows if r[1] != "echo"]]

    def ask_words(chunk, batch):
        return Model(Tokens(batch), parts, []).ask(1, chunk)

    def ask_grams(chunk, batch, rows, level):
        return C.messages(Model(Tokens(batch), parts, heard(rows, level - 1)).ask(level, chunk))

    def evaluate(chunk, batch, rows):
        t = Tokens(batch)
        model = Model(t, parts, heard(rows, order))
        word, uni = t.levels[0].which, model.uni
        p = model.p[0][word]
        for k in range(2, order + 1):
            which = t.level(k).which
            p = np.where(which >= 0, model.p[k - 1][which] if len(model.p[k - 1]) else p, p)
        known, base = model.total[0] > 0, np.log10((model.total[0] + 1) / (uni.n + uni.v + 1))
        docs = batch.num_rows
        columns = [
            batch.column(0), pa.array(~t.train), pa.array(t.count, pa.int64()),
            pa.array(np.bincount(t.doc, known[word], docs).astype(np.int64)), pa.array(np.full(docs, uni.n, np.int64)),
            pa.array(np.bincount(t.doc, base[word], docs)), pa.array(np.bincount(t.doc, np.log10(p), docs)),
        ]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, names)], schema=names)

    answers = C.answer(C.ask(chunks, ask_words), _answer_words)
    for level in range(2, order + 1):
        told = answers.filter("kind <> 'stats'").withColumn("said", _said(answers).scalar())
        answers = C.answer(C.told(chunks, told, partial(ask_grams, level=level), C.MESSAGE), partial(_answer_grams, level=level, last=level == order))
    return C.told(chunks, answers.filter("kind <> 'stats'").withColumn("said", _said(answers).scalar()), evaluate, RESULT)


def op9_katz_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scores(docs, crc_mod("doc_id", 7) != 2)
