"""Substring dedup: seed and extend on winnowed anchors.

In every window of WINDOW words the five-word shingle of least hash is the
window's anchor, so equal windows share it (winnowing). Anchors seed: one that
occurs once in the corpus leads nowhere. Documents are then joined on their
repeated anchors, each with the words around it as far as a window through the
anchor reaches to either side. There the matches are extended word by word:
windows are equal if all their words are, hashes only bring them together. Runs
of overlapping windows that started earlier are the maximal repeats of at least
WINDOW words, and their words are removed. The first occurrence, by document id
and place, stays.

Both steps are questions of chunks to parts of the hash range (chunks.py):
repeats within a chunk are found there, and a passage in very many documents
is asked once a chunk. The texts cross the network once, the words around
repeated anchors once more.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as C
from .common import U64, Words, arrow_schema, free_name, mix64, ngram_hashes, pack_bytes, pack_ints, pack_sorted, run_ids, text_buffer, unpack_bytes, unpack_ints, unpack_sorted, xxh

WINDOW = 20
SHINGLE = 5
CHUNK_BYTES = 4_000_000
NO_ID = 2**63 - 1


def equal_windows(words: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each word sequence, and which sequence each window has; words are numbers, windows ascend."""
    if not len(start):
        return start, start
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + window, -1)
    held = np.flatnonzero(np.cumsum(covered)[:-1] > 0)  # only words of these windows are compared
    runs = run_ids(words[held], window)[np.searchsorted(held, start)]
    _, first, which = np.unique(runs, return_index=True, return_inverse=True)
    return first, which


class Windows:
    """The windows of a chunk, the anchor of each, and the distinct anchors."""

    def __init__(self, batch: pa.RecordBatch, text: int, window: int, shingle: int):
        self.window = window
        self.words = Words(*text_buffer(batch.column(text)))
        distinct, self.word = self.words.encoded()
        of = self.words.text_of()
        n = max(0, len(self.word) - window + 1)
        self.start = np.flatnonzero(of[:n] == of[window - 1 :]) if n else np.zeros(0, np.int64)
        self.text = of[self.start]
        grams = ngram_hashes(xxh(distinct)[self.word], shingle)
        # leftmost least shingle of each window, by doubling
        width, low = window - shingle + 1, grams
        done = 1
        while done < width:
            step = min(done, width - done)
            low = np.minimum(low[: len(low) - step], low[step:])
            done += step
        # mixed again: least hashes crowd at the low end, and parts are ranges of hashes
        anchor = mix64(low[self.start]) if len(self.start) else np.zeros(0, U64)
        self.anchors, self.anchor_of = np.unique(anchor, return_inverse=True)
        self.grams = grams

    def repeated_here(self) -> np.ndarray:
        """Whether an anchor's shingle occurs more than once in the chunk."""
        grams = mix64(self.grams)
        at = np.searchsorted(self.anchors, grams)
        at[at == len(self.anchors)] = 0
        hit = self.anchors[at] == grams if len(self.anchors) else np.zeros(len(grams), bool)
        return np.bincount(at[hit], minlength=len(self.anchors)) > 1

    def seeded(self, anywhere: np.ndarray):
        """The windows whose anchor is repeated: their numbers, the first of each word sequence, and which sequence each has."""
        ok = np.flatnonzero((anywhere | self.repeated_here())[self.anchor_of]) if len(self.anchor_of) else np.zeros(0, np.int64)
        return ok, *equal_windows(self.word, self.start[ok], self.window)

    def asked(self, ok: np.ndarray, first: np.ndarray, parts: int):
        """The first windows in the order that they are asked in, and runs of them (part, first, last): consecutive windows of a text whose anchors one part has."""
        mine = ok[first]
        part = np.searchsorted(C.part_bounds(self.anchors, parts)[1:-1], self.anchor_of[mine], side="right")
        order = np.lexsort((self.start[mine], part))
        at, part = mine[order], part[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (part[1:] != part[:-1]) | (self.start[at[1:]] != self.start[at[:-1]] + 1) | (self.text[at[1:]] != self.text[at[:-1]])
        begin = np.flatnonzero(fresh)
        return order, at, part[begin], begin, np.append(begin, len(at))[1:]


def _bits(rows: list, kind: str, n: int) -> np.ndarray:
    """The answers' bits, joined in the order of the parts."""
    found = [np.unpackbits(np.frombuffer(a, np.uint8), count=int.from_bytes(b, "little")) for _, k, a, b, _ in (r[:5] for r in rows) if k == kind]
    out = np.concatenate(found).astype(bool) if found else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers to {n} questions")
    return out


def _reply(flags: np.ndarray) -> tuple[bytes, bytes]:
    return np.packbits(flags).tobytes(), len(flags).to_bytes(8, "little")


def _count_anchors(part: int, rows: list) -> list[tuple]:
    held = [unpack_sorted(a) for _, _, a, _, _ in rows]
    _, which, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    flags, out, at = (count > 1)[which], [], 0
    for (chunk, *_), h in zip(rows, held):
        out.append((part, chunk, "anchors", *_reply(flags[at : at + len(h)]), None))
        at += len(h)
    return out


def _first_windows(part: int, rows: list, window: int) -> list[tuple]:
    """Tells each chunk whether its first window of a word sequence is the corpus's first."""
    out = [(part, chunk, "echo", a, b, None) for chunk, kind, a, b, _ in rows if kind == "echo"]
    asked = [r for r in rows if r[1] == "windows"]
    if not asked:
        return out
    raw = b"".join([unpack_bytes(a) for _, _, a, _, _ in asked])
    size, doc = ([unpack_ints(r[k], np.int64) for r in asked] for k in (3, 4))
    segments = np.repeat(np.arange(len(asked)), [len(x) for x in size])  # the chunk of each
    words = Words(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(np.concatenate(size))]))
    word, of = words.encoded()[1], words.text_of()
    del raw
    n = max(0, len(word) - window + 1)
    start = np.flatnonzero(of[:n] == of[window - 1 :])
    _, which = equal_windows(word, start, window)
    of = of[start]
    chunk, doc = segments[of], np.concatenate(doc)[of]
    order = np.lexsort((chunk, doc, which))
    run = which[order]
    first = np.ones(len(order), bool)
    first[1:] = run[1:] != run[:-1]
    flags = np.zeros(len(order), bool)
    flags[order[first]] = True
    edge = np.searchsorted(chunk, np.arange(len(asked) + 1))
    for (number, *_), a, b in zip(asked, edge, edge[1:]):
        out.append((part, number, "windows", *_reply(flags[a:b]), None))
    return out


def _cut(words: Words, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Each text without the bytes of word spans, up to the next word if the text has one."""
    n = len(words.buf)
    if len(begin):
        last = np.searchsorted(words.bounds, begin, side="right")  # the text's end among the bounds
        inside = end < words.bounds[last]
        to = np.where(inside, words.start[np.minimum(end, len(words.start) - 1)], words.end[end - 1])
        gone = np.cumsum(np.bincount(words.start[begin], minlength=n + 1) - np.bincount(to, minlength=n + 1))[:n] > 0
    else:
        gone = np.zeros(n, bool)
    at = np.concatenate([[0], np.cumsum(~gone)])[words.offsets].tolist()
    raw = words.buf[~gone].tobytes()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, shingle: int = SHINGLE, layout: bool = False) -> DataFrame:
    """Adds n_words, n_removed, kept_text and repeats (removed word spans, end exclusive) to each row.

    A word is removed if a window of `window` words over it has the word
    sequence of a window that starts earlier: at a smaller id, or before it in
    the same document. Null text: no words. Rows without an id come after all
    others; of rows that share an id the one in the earlier chunk comes first.
    Texts shorter than a window lose nothing. kept_text is the kept words joined
    by one space, or with `layout` the text as it was, less each removed passage
    and the space after it. Columns of the added names are
    replaced. An empty table gives no rows.
    """
    added = {"n_words": "bigint", "n_removed": "bigint", "kept_text": "string", "repeats": "array<struct<start:bigint,end:bigint>>"}
    rest = [c for c in df.columns if c.lower() not in added]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items()])
    names, order = arrow_schema(schema), free_name(df, "row_order")
    column = next(i for i, c in enumerate(rest) if c.lower() == text.lower())
    parts = C.parts_for(df, text)
    source = df.select(*[df[f"`{c}`"] for c in rest], F.coalesce(df[f"`{doc_id}`"].cast("bigint"), F.lit(NO_ID)).alias(order))
    chunks = C.packed(source, rest[column], order, CHUNK_BYTES)

    def ask_anchors(chunk, batch):
        keys = Windows(batch, column, window, shingle).anchors
        edge = C.part_bounds(keys, parts)
        return [(p, chunk, "anchors", pack_sorted(keys[a:b]), None, None) for p, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]

    def ask_windows(chunk, batch, rows):
        made = Windows(batch, column, window, shingle)
        anywhere = _bits(rows, "anchors", len(made.anchors))
        ok, first, _ = made.seeded(anywhere)
        _, at, part, begin, end = made.asked(ok, first, parts)
        low, high = made.words.start[made.start[at[begin]]], made.words.end[made.start[at[end - 1]] + window - 1]
        doc = batch.column(len(rest)).to_numpy()[made.text[at[begin]]].astype(np.int64)
        raw, out, edge = made.words.buf.tobytes(), [], np.searchsorted(part, np.arange(parts + 1))
        for p in np.unique(part).tolist():
            a, b = int(edge[p]), int(edge[p + 1])
            text = b"".join([raw[x:y] for x, y in zip(low[a:b].tolist(), high[a:b].tolist())])
            out.append((p, chunk, "windows", pack_bytes(text), pack_ints((high - low)[a:b]), pack_ints(doc[a:b])))
        return C.messages(out + [(C.home_part(chunk, parts), chunk, "echo", *_reply(anywhere), None)])

    def remove(chunk, batch, rows):
        made = Windows(batch, column, window, shingle)
        ok, first, which = made.seeded(_bits(rows, "echo", len(made.anchors)))
        order = made.asked(ok, first, parts)[0]
        is_first = np.zeros(len(first), bool)
        is_first[order] = _bits(rows, "windows", len(first))
        again = np.ones(len(ok), bool)
        again[first[is_first]] = False
        at = made.start[ok[again]]
        total = len(made.word)
        cover = np.cumsum(np.bincount(at, minlength=total + 1)[: total + 1] - np.bincount(at + window, minlength=total + 1)[: total + 1])[:total] > 0
        words = made.words
        csum = np.concatenate([[0], np.cumsum(cover)])
        removed = csum[words.bounds[1:]] - csum[words.bounds[:-1]]
        # spans of removed words, cut at the ends of texts
        edge = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
        cuts = words.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < total)]
        cuts = np.unique(cuts[cover[cuts] & cover[cuts - 1]]) if len(cuts) else cuts
        begin, end = (np.sort(np.concatenate([np.flatnonzero(edge == e), cuts])) for e in (1, -1))
        of = words.text_of()[begin] if len(begin) else begin
        base = words.bounds[of] if len(begin) else begin
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())], names=["start", "end"]),
        )
        kept = pa.array([b.decode() for b in (_cut(words, begin, end) if layout else words.joined(~cover))], pa.string())
        columns = [*batch.columns[: len(rest)], pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), kept, spans]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, names)], schema=names)

    anchors = C.answer(C.ask(chunks, ask_anchors), _count_anchors)
    windows = C.answer(C.told(chunks, anchors, ask_windows, C.MESSAGE), partial(_first_windows, window=window))
    return C.told(chunks, windows, remove, schema)


def without_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with each text less its repeated passages; texts that lose nothing stay as they are, character for character."""
    made = dedup(df, text, doc_id, layout=True)
    new = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"`{text}`"))  # a null text stays null
    return made.select(*[new.alias(c) if c.lower() == text.lower() else made[f"`{c}`"] for c in df.columns])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
