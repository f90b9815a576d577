"""Each operator against a plain version of its contract, on small generated texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from lodestar.llm import bpe, components, katz, neighbours, pack, pii, simhash, substring, toxicity
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, BYTES, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def corpus(n: int = 160) -> list[tuple[int, str]]:
    rng = random.Random(4)
    vocabulary = [rng.choice(["ä", "", "x"]) + "".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(90)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 19, 20, 21, 60, 200]))
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            cut = rng.randint(0, 30)
            words[at:at] = passage.split()[cut : cut + rng.randint(15, 60)]
        if i % 5 == 0 and texts:
            words = rng.choice(texts).split()
            if words and i % 2:
                words[rng.randrange(len(words))] = "Changed"
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    ids = rng.sample(range(1, 10_000), n)
    return list(zip(ids, texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


@pytest.mark.parametrize("chunk", [2_000, 10**7])
def test_substring(docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", chunk)
    seen, want = set(), {}
    for i, text in sorted(rows):
        w = WORD.findall(text)
        cover = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                cover[s : s + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(cover), " ".join(x for x, c in zip(w, cover) if not c))
    assert sum(v[1] for v in want.values()) > 500
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.dedup(docs).collect()}
    assert got == want


def test_substring_keeps_layout(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage), (2, f"head\n\n{passage}\ntail  é\n"), (3, f"a {passage}"), (4, f"{passage}\n"), (5, "x\ty ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in substring.without_repeats(df).collect()}
    assert got == {1: passage, 2: "head\n\ntail  é\n", 3: "a ", 4: "\n", 5: "x\ty "}


@pytest.mark.parametrize("hot", [2, 20_000])
def test_simhash(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    prints = []
    for i, text in sorted(rows):
        w = WORD.findall(lower(text))
        runs = [" ".join(w[j : j + 4]) for j in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0))
    parent = {i: i for i, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 4 and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, find(i)) for i, f in prints}


def test_every_close_pair_meets_at_a_home_anchor():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 3_000, dtype=np.uint64)
    flips = [rng.choice(64, rng.integers(0, 5), replace=False) for _ in a]
    b = np.array([int(x) ^ sum(1 << int(k) for k in f) for x, f in zip(a, flips)], np.uint64)
    home, reached = collections.defaultdict(set), collections.defaultdict(set)
    for where, fp, only_home in ((home, a, True), (reached, b, False)):
        for rows, number, is_home in simhash.anchors(fp):
            if is_home or not only_home:
                for r, n in zip(rows.tolist(), number.tolist()):
                    where[r].add(n)
    assert all(home[i] & reached[i] for i in range(len(a)))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, rng.randint(201, 240)) for _ in range(80)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_bpe_like_tiktoken(spark, docs, rows):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs, RANKS, PATTERN).collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in rows}
    rng = random.Random(6)
    letters = list("ab  '\n\tsSé漢字कि0१²\x1c\x85​　😀ثßIİ.,!t")
    fuzz = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1_500)] + ["a" * 5_000, "ab" * 3_000, "!" * 2_500]
    for path, encode in ((RANKS, own.encode_ordinary), (BYTES, None)):
        coder = bpe.Bpe(path, PATTERN)
        if encode is None:
            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            encode = lambda x, t=t: t.encode(x, add_special_tokens=False).ids
        made = coder.encode_batch([*fuzz, "a <|endoftext|> b"])
        assert [x.tolist() for x in made] == [encode(x) for x in [*fuzz, "a <|endoftext|> b"]]
        assert all(coder.decode(x) == f.encode() for x, f in zip(made, fuzz))


@pytest.mark.parametrize("chars", [1, 60, 10**6])
def test_pieces_like_the_pattern(chars, monkeypatch):
    """Contractions, white space and the ends of texts, where texts are split together."""
    import regex

    monkeypatch.setattr(bpe, "CHARS", chars)
    assert PATTERN == bpe.PLAIN_PATTERN
    rng, split = random.Random(7), regex.compile(PATTERN).findall
    texts = ["".join(rng.choices("''''strevmldST  \n\t1!é²　😀", k=rng.randint(0, 30))) for _ in range(1_000)]
    whole = "".join(texts)
    start, end, bounds = bpe.Splitter().pieces(whole, np.array([len(t) for t in texts]))
    pieces = [whole.encode()[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
    assert [pieces[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())] == [split(t) for t in texts]
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert [x.tolist() for x in bpe.Bpe(RANKS, PATTERN).encode_batch(texts)] == [own.encode_ordinary(t) for t in texts]


def test_other_patterns():
    """A pattern that isn't the plain one goes through the regex library."""
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = ["a b  c", "", "don't é"]
    assert [x.tolist() for x in bpe.Bpe(RANKS, r"\S+|\s+").encode_batch(texts)] == [own.encode_ordinary(t) for t in texts]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = int(ch) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "x", "1", "2 ", "-", ".", "+", "(", ")", " ", "255", "256", "4539 1488 0343 6467", "4539148803436467", "1.2.3.4", "é", "😀", "@", "\n", "00", "%", "_", "+1 (988) 555-2485"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(1_500)] + [(5_000, "1" * 30_000 + "a" * 30_000 + "@" + "b.c" * 9_000)]
    got = {r["id"]: [(m["s"], m["k"], m["e"]) for m in r["base"]] for r in pii.spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: base_spans(t) for i, t in rows}


def test_pii_discovers_by_context(spark):
    rows = [(i, f"hello member contact number +1 (988) 555-24{i:02d} thanks") for i in range(12)]
    rows += [(50, "note member contact number 988-555-2499 thanks"), (51, "note random words here 988-555-2411 thanks"), (52, "plain member contact number tomorrow")]
    got = {r["id"]: (r["base"], r["spans"]) for r in pii.spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(m["s"], pii.KINDS[m["k"]], m["e"]) for m in got[50][1]] == [(27, "phone", 39)] and got[50][0] == []
    assert got[51][1] == [] and got[52][1] == []
    text = pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("doc_id = 50").first()["text"]
    assert text == "note member contact number [PHONE] thanks"


def test_pii_discovers_spaced_forms(spark):
    def luhn(number):
        d = [int(x) for x in number if x != " "]
        return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0

    cards = [n for n in (f"4539 1488 03{i:02d} 6467" for i in range(100)) if luhn(n)][:8]
    assert len(cards) == 8 and not luhn("4539 1488 0343 6468")
    rows = [(i, f"hello member contact number +1 (988) 555-24{i:02d} thanks") for i in range(20)]
    rows += [(30 + i, f"hello his payment card {n} thanks") for i, n in enumerate(cards)]
    cases = {
        50: ("note member contact number (017) 555-7713, thanks", "note member contact number [PHONE], thanks"),
        51: ("note member contact number 988 555 2499 thanks", "note member contact number [PHONE] thanks"),
        52: ("note his payment card 4539 1488 0343 6468.", "note his payment card [CARD]."),
        53: ("note member contact number 988.555 24-99", "note member contact number [PHONE]"),
        54: ("note random words here 988 555 2411 thanks", None),
        55: ("note member contact number 988 555 2499 1.2.3.4 x", "note member contact number [PHONE] [IP] x"),  # a base span ends a run
        56: ("note member contact number 988-555-2499 988-555-2411 x", "note member contact number [PHONE] 988-555-2411 x"),  # the whole fits nothing
        57: ("note member contact number 988 55x 2499", None),
        58: ("note member contact number 5 6 tomorrow " + "1 " * 30_000, None),
    }
    rows += [(i, text) for i, (text, _) in cases.items()]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got[i] for i in cases} == {i: want or text for i, (text, want) in cases.items()}


def test_pack_is_best_fit(spark, docs, rows):
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    got = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in pack.pack(docs, BYTES, PATTERN, capacity=128).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        want = [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(pack.cut(len(ids), 128))]
        assert sorted(got[i]) == want
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= math.ceil(total / 128) * 1.05 + 1


def plain_best_fit(lengths, capacity, gaps=()):
    gaps = list(gaps)
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps[gaps.index(min(fits))] -= x
        else:
            gaps.append(capacity - x)
    return gaps


def test_sweeps_like_the_plain_loop():
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 120))]
        free = sorted(rng.randint(1, 50) for _ in range(rng.choice([0, 0, 5, 30])))
        moves, n, left = pack.best_fit(collections.Counter(lengths), 50, np.array(free, np.int64))
        gaps = plain_best_fit(lengths, 50, free)
        assert n == len(gaps) and sum(b - a for _, a, b, _, _, _ in moves) == len(lengths)
        assert sorted(g for g, spans in left.items() for a, b in spans for _ in range(b - a)) == sorted(g for g in gaps if g)


@pytest.mark.parametrize("lane_rows", [20, 10**6])
def test_pack_needs_as_many_sequences_as_plain_best_fit(docs, lane_rows):
    got = pack.pack(docs, BYTES, PATTERN, capacity=256, lane_rows=lane_rows).collect()
    want = len(plain_best_fit([r["length"] for r in got], 256))
    made = len({r["sequence_id"] for r in got})
    if lane_rows > len(got):
        assert made == want
    else:  # lanes may each leave a sequence a round open
        assert made <= want + len(pack.bands(256)) * -(-len(got) // lane_rows)


@pytest.mark.parametrize("spread, block_rows", [(0, 8_192), (0, 500), (30, 500)])
def test_neighbours_recall(spark, spread, block_rows):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((3_000, 24)) + spread * rng.standard_normal((40, 24))[rng.integers(0, 40, 3_000)]).astype(np.float32)
    v[100:1_100] = v[0]  # a third of the rows are one vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, 100, 10, block_rows=block_rows).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits, w = 0, v.astype(np.float64)
    for q in range(0, 3_000, 100):
        d = np.sqrt(((w - w[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len({x[1] for x in got[q]} & set(best.tolist()))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in got[q]) and [x[0] for x in sorted(got[q])] == list(range(1, 11))
    assert hits >= 0.9 * 300


def test_neighbours_visit_only_blocks_in_reach(spark):
    """Far clusters: a query is routed to blocks that its last neighbour's distance reaches on the ordering line."""
    bounds = [(2, b, 10.0 * b, 10.0 * b + 4) for b in range(50)]
    rows = [(1, [0.0, 1.0], 2, 102.0, 3.0, 10), (2, [0.0, 1.0], 2, 104.0, 7.0, 10), (3, [0.0, 1.0], 2, 0.0, float("inf"), 0)]
    got = collections.defaultdict(set)
    for r in neighbours._routed(spark.createDataFrame(rows, neighbours.ASKED), bounds).collect():
        got[r["vec_id"]].add(r["block"])
    assert got == {2: {11}, 3: set(range(1, 50))}


@pytest.mark.parametrize("order, chunk", [(1, 3_000), (2, 3_000), (2, 10**7), (3, 3_000), (4, 5_000)])
def test_katz(docs, rows, order, chunk, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows}
    tokens = {i: [*WORD.findall(lower(t)), "\n"] for i, t in rows}
    counts = [collections.Counter() for _ in range(order)]
    after = collections.defaultdict(collections.Counter)

    def history(w, at, n):
        """The n words before a token, with one start; none if there are fewer."""
        before = ["\t", *w[:at]]
        return tuple(before[-n:]) if 0 < n <= len(before) else None if n else ()

    for i, w in tokens.items():
        for at, word in enumerate(w) if train[i] else ():
            for n in range(order):
                if (h := history(w, at, n)) is not None:
                    counts[n][*h, word] += 1
                    after[h][word] += 1
    d = [katz.discounts([sum(x == k for x in c.values()) for k in range(1, 7)]) for c in counts]
    n, v = sum(counts[0].values()), len(counts[0])
    uni = katz.Unigrams(n, v, [sum(x == k for x in counts[0].values()) for k in range(1, 7)])
    cache = {}

    def p(h, w):
        if not h:
            return float(uni.p(np.array([counts[0][w,]]))[0])
        if h not in after:
            return p(h[1:], w)
        if h not in cache:
            seen, f = after[h], d[len(h)]
            total = sum(seen.values())
            left, scale = sum((1 - (f[c] if c <= 5 else 1)) * c for c in seen.values()) / total, 1.0
            if left <= 0:
                left, scale = 1 / (total + 1), total / (total + 1)
            cache[h] = total, scale, left / (1 - sum(p(h[1:], x) for x in seen))
        total, scale, alpha = cache[h]
        c = after[h][w]
        return scale * (f := d[len(h)])[c if c <= 5 else 0] * c / total if c else alpha * p(h[1:], w)

    for n_words in range(order):  # every history's probabilities sum to one
        for h in [h for h in after if len(h) == n_words][:15]:
            assert abs(sum(p(h, w) for (w,) in counts[0]) + p(h, "unseen") - 1) < 1e-9
    for r in katz.scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, order=order).collect():
        w = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[r["doc_id"]], len(w), sum(counts[0][x,] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((counts[0][x,] + 1) / (n + v + 1)) for x in w)) < 1e-6
        longest = [max((h for n in range(order) if (h := history(w, at, n)) is not None), key=len) for at in range(len(w))]
        assert abs(r["score"] - sum(math.log10(p(h, x)) for h, x in zip(longest, w))) < 1e-6


def test_toxicity_finds_unseen_misspellings():
    rng = random.Random(9)
    plain = ["".join(rng.choices("aeioustrnl", k=rng.randint(2, 8))) for _ in range(400)]
    bad = ["zzkworv" + rng.choice("abcdefghij") for _ in range(10)]

    def text(toxic, words):
        w = rng.choices(plain, k=rng.randint(5, 300))
        for _ in range(2 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    y = np.array([i % 4 == 0 for i in range(600)])
    model = toxicity.train(pa.array([text(t, bad) for t in y]), y.astype(int))
    unseen = ["zzkworv" + c for c in "klmnop"]
    from lodestar.llm.common import text_buffer

    test = [text(i % 2 == 0, unseen) for i in range(200)]
    score = toxicity.score_buffer(*text_buffer(pa.array(test)), model)
    right = sum((s >= 0.7) == (i % 2 == 0) for i, s in enumerate(score))
    assert right >= 190


def test_digests(spark, docs, rows):
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).select("doc_id", F.sha2("decoded", 256).alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
