"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is split by the vocabulary's pattern. The distinct pieces that a task
has not met before are sorted into length buckets; each bucket is one padded
matrix of token ids. In each round every row finds its leftmost pair of
minimum rank by a hashed pair lookup, merges it and is compacted by one
column; rows without a pair leave the matrix. Texts are then put together
from the pieces' ids, so that a piece is merged once a task, not once a use.

Encoding and decoding are narrow stages: no shuffle; a task holds one Arrow
batch, the tables and at most CACHE_PIECES pieces.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, exact, release, slices, small_batches

NONE = np.int32(2**31 - 1)
#: Pieces whose ids a task keeps; beyond it the cache starts anew.
CACHE_PIECES = 400_000
#: Longer pieces (in bytes) take the linked-list path, whose time is n log n.
LONG_PIECE = 2_048
#: Characters that are split into pieces at once; a longer text is split alone.
CHARS = 1_000_000
#: Fixed value: the pattern whose pieces Splitter finds; others go to the regex library.
PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cells of one padded matrix.
CELLS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level tokenizers file.

    Printable bytes stand for themselves, the others follow from code point 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_tokenizer(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]]]:
    """Token ids and merges (left, right, merged) of a byte-level tokenizers file, whose merges rank as their ids do."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    letters, model, special = byte_letters(), made["model"], {x["content"] for x in made["added_tokens"]}
    if model["type"] != "BPE" or model.get("byte_fallback") or made.get("normalizer"):
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in special}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    triples = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges]
    if any(x[2] >= y[2] for x, y in zip(triples, triples[1:])):
        raise ValueError(f"its merges aren't in the order of their ids: {path}")
    return {raw[t]: i for t, i in model["vocab"].items() if t in raw}, triples


def splits(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Every split of each token into two tokens, for rank files, where any pair that makes a token merges."""
    out = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a = ranks.get(token[:cut])
            if a is not None and (b := ranks.get(token[cut:])) is not None:
                out.append((a, b, rank))
    return out


class PairTable:
    """Open-addressed hash table from a pair of token ids to the merged token's rank."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        left, right, to = zip(*merges)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(len(key) * 2).bit_length())
        self.key = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.value = np.full(1 << self.bits, NONE)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.key[slot] == np.uint64(2**64 - 1)
            self.key[slot[free]] = key[todo[free]]  # of several for a slot one stays
            won = self.key[slot] == key[todo]
            self.value[slot[won]] = np.array(to, np.int32)[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where two tokens don't merge; any shape."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        flat, out = key.ravel(), np.full(key.size, NONE)
        todo, slot = np.arange(key.size), self._slot(flat)
        while len(todo):
            there = self.key[slot]
            hit = there == flat[todo]
            out[todo[hit]] = self.value[slot[hit]]
            more = ~hit & (there != np.uint64(2**64 - 1))
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(key.shape)


class Splitter:
    """The pieces of PLAIN_PATTERN, found with numpy over the code points of many texts.

    Runs of letters, of numbers and of other characters are pieces, each with
    one space before it. White space before them is a piece less its last
    character, which is one of its own unless it is such a space; at the end of
    a text white space is one piece. An apostrophe that begins a piece takes s,
    t, re, ve, m, ll or d after it and ends the piece there.
    """

    SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

    def __init__(self):
        import regex

        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        self.kind = np.full(0x110000, self.OTHER, np.uint8)
        for kind, pattern in ((self.SPACE, r"\s"), (self.LETTER, r"\p{L}"), (self.NUMBER, r"\p{N}")):
            self.kind[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind

    def pieces(self, whole: str, lengths: np.ndarray):
        """Where each piece begins and ends in the UTF-8 bytes, and each text's range of pieces."""
        point = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n, text_end = len(point), np.cumsum(lengths)
        kind = self.kind[point]
        fresh = np.ones(n + 1, bool)
        fresh[1:n] = kind[1:] != kind[:-1]
        fresh[text_end[text_end < n]] = True
        run = np.flatnonzero(fresh)[:-1] if n else np.zeros(0, np.int64)
        if not len(run):
            return run, run, np.zeros(len(lengths) + 1, np.int64)
        run_end = np.concatenate([run[1:], [n]])
        run_kind = kind[run]
        last_of_text = np.isin(run_end, text_end)
        begins = np.zeros(n + 1, bool)
        blank = run_kind == self.SPACE
        inner = blank & ~last_of_text
        by_space = inner & (point[run_end - 1] == 32)
        begins[run[blank & ~by_space]] = True
        begins[run[by_space & (run_end - run > 1)]] = True
        begins[run_end[inner] - 1] = True  # a space goes with the next run, another character is a piece
        after_space = np.concatenate([[False], by_space[:-1]])
        begins[run[~blank & ~after_space]] = True
        # contractions: a lone apostrophe without a space, and a run of letters that begins with an ending
        quote = np.flatnonzero((run_kind == self.OTHER) & (run_end - run == 1) & (point[run] == 39) & ~after_space & ~last_of_text)
        quote = quote[run_kind[quote + 1] == self.LETTER]
        if len(quote):
            at, size = run[quote + 1], (run_end - run)[quote + 1]
            one, two = point[at], np.where(size > 1, point[np.minimum(at + 1, n - 1)], 0)
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            taken = np.where(short, 1, np.where(long, 2, 0))
            hit = taken > 0
            begins[at[hit]] = False
            rest = hit & (size > taken)
            begins[at[rest] + taken[rest]] = True
        start = np.flatnonzero(begins[:n])
        end = np.concatenate([start[1:], [n]])
        bounds = np.searchsorted(start, np.concatenate([[0], text_end]))
        byte = np.concatenate([[0], np.cumsum(1 + (point >= 0x80) + (point >= 0x800).astype(np.int64) + (point >= 0x10000))])
        return byte[start], byte[end], bounds


class Bpe:
    """An encoder and decoder for a rank file, or for a byte-level tokenizers file (.json)."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.whole = not path.endswith(".json")  # rank files look whole pieces up first
        self.ranks, merges = (ranks := read_ranks(path), splits(ranks)) if self.whole else read_tokenizer(path)
        self.split = regex.compile(pattern).findall
        self.spans = Splitter() if pattern == PLAIN_PATTERN else None
        self.pairs = PairTable(merges)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        token = [b""] * size
        for t, r in self.ranks.items():
            token[r] = t
        self.length = np.array([len(t) for t in token], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.ranks = self.ranks if self.whole else {}  # else of no more use
        self.cache: dict[bytes, bytes] = {}  # ids, by piece

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as bytes) of pieces of at least one byte, by rounds of merges over a padded matrix."""
        size = np.array([len(p) for p in pieces], np.int64)
        width, out = int(size.max()), [None] * len(pieces)
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rows, rank = np.arange(len(pieces)), np.full((len(pieces), width), NONE)
        ok = np.arange(width - 1) < size[:, None] - 1
        rank[:, : width - 1][ok] = self.pairs.lookup(ids[:, :-1][ok], ids[:, 1:][ok])
        while True:
            at = rank.argmin(axis=1)  # the leftmost of equals
            best = rank[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                raw, step = ids[done].tobytes(), 4 * ids.shape[1]
                for k, (i, n) in enumerate(zip(rows[done].tolist(), size[done].tolist())):
                    out[i] = raw[k * step : k * step + 4 * n]
                go = ~done
                if not go.any():
                    return out
                ids, rank, rows, size, at, best = ids[go], rank[go], rows[go], size[go], at[go], best[go]
            line = np.arange(len(rows))
            # compaction: what stands right of the pair moves one column left
            take = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > at[:, None])
            ids[line, at] = best
            ids = np.take_along_axis(ids, take, axis=1)
            rank = np.take_along_axis(rank, take, axis=1)
            size = size - 1
            # only the two pairs with the new token have new ranks
            rank[line, at] = NONE
            r = np.flatnonzero(at + 1 < size)
            rank[r, at[r]] = self.pairs.lookup(ids[r, at[r]], ids[r, at[r] + 1])
            r = np.flatnonzero(at > 0)
            rank[r, at[r] - 1] = self.pairs.lookup(ids[r, at[r] - 1], ids[r, at[r]])
            trim = int(size.max())
            if trim < ids.shape[1] - 8:
                ids, rank = ids[:, :trim].copy(), rank[:, :trim].copy()

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, over a linked list and a heap."""
        n = len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.pairs.lookup(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                pair = ids[i], ids[j]
                r = known.get(pair)
                if r is None:
                    r = known[pair] = int(self.pairs.lookup(np.array([pair[0]]), np.array([pair[1]]))[0])
                if r != NONE:
                    heapq.heappush(heap, (r, i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x, ok in zip(ids, alive) if ok], np.int32)

    def learn(self, raw: list[bytes]) -> list[bytes]:
        """The ids of pieces, as bytes."""
        out: list = [None] * len(raw)
        left = range(len(raw))
        if self.whole:
            whole = list(map(self.ranks.get, raw))
            left = [i for i, r in enumerate(whole) if r is None]
            out = [None if r is None else r.to_bytes(4, "little") for r in whole]
        size = np.fromiter((len(raw[i]) for i in left), np.int64, len(left))
        order = np.argsort(size, kind="stable")
        size, order, at = size[order], np.asarray(left, np.int64)[order], 0
        while at < len(order):  # a bucket: lengths within an eighth (and two bytes), and a bounded matrix
            n, to = int(size[at]), int(np.searchsorted(size, size[at] * 9 // 8 + 2, side="right"))
            to = min(to, at + max(1, CELLS // int(size[to - 1])))
            some = order[at:to].tolist()
            if n > LONG_PIECE:
                made = [self.merge_long(raw[i]).tobytes() for i in some]
            else:
                made = self.merge_rows([raw[i] for i in some])
            for i, ids in zip(some, made):
                out[i] = ids
            at = to
        return out

    def known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces, from the cache or learnt."""
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache.clear()
            release()
        found = list(map(self.cache.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(new, self.learn([pieces[i] for i in new])):
            found[i] = self.cache[pieces[i]] = ids
        return found

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as int32."""
        if self.spans is None:
            found = [self.split(t) for t in texts]
            distinct = list(set().union(*found)) if found else []
            ids = dict(zip(distinct, self.known([p.encode() for p in distinct])))
            return [np.frombuffer(b"".join(map(ids.__getitem__, pieces)), np.int32) for pieces in found]
        out, at = [], 0
        size = np.cumsum([len(t) for t in texts])
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, side="right")))
            out += self._encode_some(texts[at:to])
            at = to
        return out

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        start, end, bounds = self.spans.pieces(whole, np.array([len(t) for t in texts], np.int64))
        distinct, which = exact(np.frombuffer(whole.encode(), np.uint8), end - start)
        ids = self.known(distinct.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, place = np.frombuffer(b"".join(ids), np.int32), np.cumsum(length) - length
        size = length[which]
        to = np.cumsum(size)
        tokens = flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(place[which] - (to - size), size)]
        cuts = np.concatenate([[0], to])[bounds].tolist()
        return [tokens[x:y] for x, y in zip(cuts, cuts[1:])]

    def forget(self) -> None:
        """Empties the cache at the end of a task, so that other stages have the memory."""
        self.cache.clear()
        release()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the token table."""
        if not len(ids):
            return b""
        size = self.length[ids]
        end = np.cumsum(size)
        at = np.arange(int(end[-1])) + np.repeat(self.first[ids] - (end - size), size)
        return self.bytes[at].tobytes()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the token ids of each text as array<int>; null text: no ids.

    No special tokens: their strings are ordinary text. Other columns pass
    through, one of the added name is replaced. Repeated rows stay; an empty
    table gives no rows.
    """
    rest = [c for c in df.columns if c.lower() != to.lower()]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(to, T.ArrayType(T.IntegerType(), False))])
    names, column = arrow_schema(schema), next(i for i, c in enumerate(rest) if c.lower() == text.lower())

    small_batches(df.sparkSession)

    def run(batches):
        bpe = coder(path, pattern)
        for whole in batches:
            for batch in slices(whole, whole.schema.names[column], 4_000_000):
                ids = bpe.encode_batch(["" if t is None else t for t in batch.column(column).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                made = pa.ListArray.from_arrays(pa.array(offsets), values).cast(names.field(len(rest)).type)
                yield pa.RecordBatch.from_arrays([*batch.columns, made], schema=names)
        bpe.forget()

    return df.select(*[df[f"`{c}`"] for c in rest]).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's ids as binary; null ids: empty bytes."""
    rest = [c for c in df.columns if c.lower() != to.lower()]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(to, T.BinaryType())])
    names, column = arrow_schema(schema), next(i for i, c in enumerate(rest) if c.lower() == ids.lower())

    small_batches(df.sparkSession)

    def run(batches):
        bpe = coder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                made = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in batch.column(column)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], schema=names)

    return df.select(*[df[f"`{c}`"] for c in rest]).mapInArrow(run, schema)


def op2_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, path, pattern).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "ids",
    )
    return decode(ids, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
