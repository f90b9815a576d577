"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from lodestar.llm import bpe, chat, katz, media, neighbours, pack, pii, simhash, substring, toxicity
from pyspark.sql import functions as F

RANKS, BYTES, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
LONG = "wörd " * 30_000
REPEAT = " ".join(f"w{i}" for i in range(40))
ROWS = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, REPEAT), (5, REPEAT), (6, "x " + REPEAT), (None, REPEAT), (None, "alone"), (7, LONG), (8, "é" * 5_000), (9, "[]{}~<|x|>")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    # names that the operators themselves use
    return rows.withColumns({n: F.lit("kept") for n in ("score", "ids", "fp", "anchor", "rows", "chunk", "part", "length", "key", "rank", "n_words_")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def text_of(t):
    return t or ""


def test_bpe(docs, empty):
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted(text_of(t).encode() for _, t in ROWS)
    assert all(len(r["ids"]) == 0 for r in got if not r["text"])
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0


def test_bpe_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [64])], "k int, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(rows, RANKS, PATTERN).orderBy("k").collect()][0] == b""


def test_media(docs, empty):
    got = media.audio_columns(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        raw = text_of(r["text"]).encode()
        samples, rate = media.wav_samples(bytes(r["media"]))
        assert samples[: len(raw)] == raw and set(samples[len(raw) :]) <= {255}
        assert len(samples) % 576 == 0 and len(samples) >= 576 and len(samples) - len(raw) <= 576 and rate == media.RATE
        tensors, spans = media.read_tensors(bytes(r["tensors"]))
        assert tensors.shape[1:] == media.SHAPE and len(tensors) == len(spans) == r["n_segments"]
    same = {r["feature"] for r in got if r["text"] == REPEAT}
    assert len(same) == 1
    assert media.audio_columns(empty).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, 0), (7, 0, None), (99, 0, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    nothing = toxicity.fit(docs, labels.limit(0))  # no labels: nothing is rejected
    assert toxicity.score(docs, nothing).filter("score >= 0.7").count() == 0
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.clean(docs, labels.limit(0)).columns == docs.columns


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    zero = {c for (_, fp), c in by.items() if fp == 0}
    assert zero == {1}
    assert {c for (d, fp), c in by.items() if d == 5} == {5}
    assert all(c is None or d is None or c <= d for (d, _), c in by.items())
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(5) == 1 and ids.count(1) == 1 and 2 not in ids
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_simhash_without_ids(spark, docs):
    """Unlinked texts stay, whatever their ids; one row of each component stays."""
    assert "alone" in [r["text"] for r in simhash.one_of_each(docs).select("text").collect()]

    def two(seed):  # a text and a near one
        rng = np.random.default_rng(seed)
        words = [f"t{x}" for x in rng.integers(0, 10**6, 600)]
        for i in range(len(words)):
            near = [*words[:i], "changed", *words[i + 1 :]]
            a, b = " ".join(words), " ".join(near)
            if 1 <= (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() <= simhash.THRESHOLD:
                return a, b
        raise AssertionError

    (a, near_a), (b, near_b), (c, near_c) = two(1), two(2), two(3)
    rows = [(5, a), (None, near_a), (9, b), (None, near_b), (None, c), (None, near_c), (None, c), (None, "lone words here"), (7, "seven one"), (7, "another text of seven")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert labels == {(5, 5), (None, 5), (9, 9), (None, 9), (None, None), (7, 7)}
    kept = [tuple(r) for r in simhash.one_of_each(df).collect()]
    of_c = [r for r in kept if r in ((None, c), (None, near_c))]
    assert len(of_c) == 1
    assert sorted((r for r in kept if r not in of_c), key=str) == sorted([(5, a), (9, b), (None, "lone words here"), (7, "seven one"), (7, "another text of seven")], key=str)


def test_substring(docs, empty):
    got = substring.dedup(docs).collect()
    assert len(got) == len(ROWS)
    both = sorted(r["n_removed"] for r in got if r["doc_id"] == 5)
    assert both == [0, 40]
    six = next(r for r in got if r["doc_id"] == 6)
    assert (six["n_words"], six["n_removed"], six["kept_text"]) == (41, 40, "x") and [tuple(s) for s in six["repeats"]] == [(1, 41)]
    unnamed = next(r for r in got if r["doc_id"] is None and r["text"] == REPEAT)
    assert unnamed["n_removed"] == 40
    long = next(r for r in got if r["doc_id"] == 7)
    assert long["n_words"] == 30_000 and long["n_removed"] == 29_999  # the first window stays but for what later windows cover
    plain = substring.without_repeats(docs)
    assert plain.columns == docs.columns and plain.filter("doc_id = 3").first()["text"] == "   \n"
    assert substring.dedup(empty).count() == 0


def test_pii(docs, empty):
    got = pii.spans(docs).collect()
    assert len(got) == len(ROWS) and all(r["spans"] == [] for r in got)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in clean.collect()) == sorted((d or 0, text_of(t)) for d, t in ROWS)
    assert pii.spans(empty).count() == 0 and pii.redact(empty).count() == 0


def test_pii_in_long_texts_of_digits(spark):
    """10 MB of numbers, and many spans in one text: the fixed patterns as a plain loop finds them, in time linear in the text."""
    import re

    phone = "+1 (988) 555-2499"
    texts = [" ".join(f"n{i}x 10.0.{i % 250}.{i % 256},{phone}" for i in range(40_000)), "x".join(str(i % 10_000) for i in range(2_100_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(2)
    got = {r["id"]: r["base"] for r in pii.spans(df).collect()}
    want = [(m.start(), 1 if m[0][0] != "+" else 3, m.end()) for m in re.finditer(r"10\.0\.\d+\.\d+|\+1 \(988\) 555-2499", texts[0])]
    assert [(m["s"], m["k"], m["e"]) for m in got[0] if m["k"] != 2] == want and got[1] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == re.sub(r"10\.0\.\d+\.\d+", "[IP]", texts[0].replace(phone, "[PHONE]")) and clean[1] == texts[1]


def test_pack(docs, empty):
    got = pack.pack(docs, BYTES, PATTERN).collect()
    places: dict = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= pack.CAPACITY
    assert {r["length"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert pack.pack(empty, BYTES, PATTERN).count() == 0


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"score": F.lit(1), "block": F.lit(2), "rank": F.lit(3)})
    got = [tuple(r) for r in neighbours.nearest(df, 100, 10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 2**0.5), (0, 2, 4, 2**0.5), (0, 3, 100, 2**0.5), (100, 1, 0, 0.0), (100, 2, 3, 0.0), (100, 3, 4, 0.0), (100, 4, 0, 2**0.5)]
    assert neighbours.nearest(df.limit(0), 100).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be <|begin|>x<|end|>"), (1, 1, None, None), (1, 1, "user", "~0~1"), (1, 1, "user", "~0~1"), (1, None, "assistant", "first"), (2, 5, "assistant", ""), (None, 0, "as\nsistant", "[INST]</s>"), (3, 2, "assistant", "x" * 9_000), (3, 3, "assistant", "<s>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"w": F.lit(1), "idx": F.lit(2), "block": F.lit(3)})
    made = chat.windows(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    back: dict = {}
    loss: dict = {}
    for r in sorted(made, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["window"])):
        back.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"][r["n_context"] :])
        loss.setdefault(r["conv_id"], []).extend(r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["loss"])
    assert back[1] == [("assistant", "first"), ("system", "be <|begin|>x<|end|>"), ("", ""), ("user", "~0~1"), ("user", "~0~1")]
    assert back[None] == [("as\nsistant", "[INST]</s>")] and back[2] == [("assistant", "")]
    assert [len(x) for x in loss[3]] == [9_000, 2] and loss[1] == ["first"]
    assert chat.windows(df.limit(0)).count() == 0


def test_katz(docs, empty):
    got = katz.scores(docs, F.col("doc_id") != 4).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    none = katz.scores(docs, F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in none} == {(0, 0)} and all(r["score"] == 0 for r in none)
    assert katz.scores(empty, F.lit(True)).count() == 0


def test_hashes_are_of_whole_texts(spark):
    a, b = "a " * 5_000 + "end", "a " * 5_000 + "END"
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    kept = [hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in substring.dedup(rows).orderBy("doc_id").collect()]
    assert len(set(kept)) == 2


def thue_morse(n: int) -> tuple[str, str]:
    """A Thue-Morse word of 2**n letters and its complement, which polynomial hashes modulo a power of two take for the same."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [10, 11, 13])
def test_words_and_pieces_that_plain_hashes_confuse(spark, n):
    a, b = thue_morse(n)
    for path in (RANKS, BYTES):
        coder = bpe.Bpe(path, PATTERN)
        assert [coder.decode(x) for x in coder.encode_batch([a, b, f"{a} {b}"])] == [x.encode() for x in (a, b, f"{a} {b}")]
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest}")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.dedup(df).collect()} == {1: 0, 2: 0, 3: 20}
    known = {r["doc_id"]: r["n_known"] for r in katz.scores(df, F.col("doc_id") == 1).collect()}
    assert known == {1: 21, 2: 20, 3: 20}
    packed = {r["doc_id"]: r["ids_crc32"] for r in pack.pack(df, BYTES, PATTERN, 65_536).collect()}
    assert packed[1] != packed[2] == packed[3]
