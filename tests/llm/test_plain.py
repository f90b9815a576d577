"""Audio features against plain loops, and the toxicity query against its contract."""

import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestar.llm import media, toxicity

DIR = "/root/testdata/sf0.001"


def prototype(up, down, taps):
    n = taps * up
    cut = 1 / max(up, down)
    h = []
    for i in range(n):
        t = cut * (i - (n - 1) / 2)
        sinc = 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
        h.append(sinc * (0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (n + 1))))
    return np.array(h) * up / sum(h)


@pytest.mark.parametrize("up,down", [(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 2), (5, 4)])
@pytest.mark.parametrize("size", [1, 7, 576])
def test_resampling_is_a_filter_over_zero_stuffed_samples(up, down, size):
    taps = 16
    x = np.random.default_rng(size).normal(size=size)
    stuffed = np.zeros(size * up)
    stuffed[::up] = x
    h, n_out = prototype(up, down, taps), -(-size * up // down)
    want, delay = np.zeros(n_out), (taps - 1 - taps // 2) * up
    for k in range(n_out):
        for i, c in enumerate(h):
            at = k * down + delay - i
            want[k] += c * stuffed[at] if 0 <= at < len(stuffed) else 0
    got = media.resample(x.astype(np.float32), up, down, taps)
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-4)


@pytest.mark.parametrize("size", [1, 256, 300, 1000])
def test_log_mel_by_a_plain_transform(size):
    rate, x = 8_000.0, np.random.default_rng(size).normal(size=size).astype(np.float32)
    mel, energy = media.log_mel(x, rate)
    frames = 1 + max(0, math.ceil((size - media.FRAME) / media.HOP))
    assert mel.shape == (frames, media.MELS) and energy.shape == (frames,)
    edges = [700 * (10 ** (2595 * math.log10(1 + rate / 1400) * k / (media.MELS + 1) / 2595) - 1) for k in range(media.MELS + 2)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    for f in range(frames):
        part = np.zeros(media.FRAME)
        some = x[f * media.HOP : f * media.HOP + media.FRAME]
        part[: len(some)] = some
        part *= [0.5 - 0.5 * math.cos(2 * math.pi * i / media.FRAME) for i in range(media.FRAME)]
        power = np.abs(turn @ part) ** 2
        assert abs(energy[f] - math.log(power.sum() + 1e-6)) < 1e-3
        for b in range(media.MELS):
            total = 0.0
            for k, p in enumerate(power):
                hz, (low, mid, high) = k * rate / media.FRAME, edges[b : b + 3]
                total += p * max(0.0, min((hz - low) / (mid - low), (high - hz) / (high - mid)))
            assert abs(mel[f, b] - math.log(total + 1e-6)) < 1e-2


def test_hysteresis_and_pooling_by_a_plain_walk():
    rng = np.random.default_rng(3)
    for n in [0, 1, 2, 9, 200, 200, 200]:
        energy = rng.normal(scale=0.15, size=n)
        want, opened = [], None
        for i, e in enumerate(energy):
            if opened is None and e >= media.HIGH:
                opened = i
            elif opened is not None and e < media.LOW:
                want.append((opened, i))
                opened = None
        if opened is not None:
            want.append((opened, n))
        assert media.hysteresis(energy) == want
        mel = rng.normal(size=(n, media.MELS)).astype(np.float32)
        got = media.pooled(mel, want)
        assert got.shape == (len(want), *media.SHAPE)
        for (a, b), tensor in zip(want, got):
            for k, row in enumerate(tensor):
                left = a + k * (b - a) // media.SHAPE[0]
                right = max(left + 1, a + (k + 1) * (b - a) // media.SHAPE[0])
                assert np.allclose(row, np.mean(mel[left:right], axis=0), atol=1e-5)


def test_toxicity_query_learns_from_no_held_out_label(spark, tmp_path):
    docs, labels = (pq.read_table(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in labels["doc_id"].to_pylist()])
    turned = np.where(held, 1 - labels["toxic"].to_numpy(), labels["toxic"].to_numpy())
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(labels.set_column(labels.schema.get_field_index("toxic"), "toxic", [turned.astype(np.int32)]), tmp_path / "labels.parquet")
    got, other = (toxicity.op4_toxicity(spark, str(d)).orderBy("doc_id").collect() for d in (DIR, tmp_path))
    assert got == other and sorted(r["doc_id"] for r in got) == sorted(docs["doc_id"].to_pylist())
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_toxicity_fits_on_bounded_bytes(spark, monkeypatch):
    """Copies of an id count once, longer texts and those beyond the class's bytes are not learnt from."""
    docs = [(i, "zzbad words here" if i % 2 else "good words here") for i in range(40)] + [(1, "zzbad words here")] * 500 + [(100, "x " * toxicity.LONGEST), (102, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100, 1), (102, 0)], "doc_id bigint, toxic int")
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.fit(rows, labels)
    want = toxicity.train(toxicity.pa.array([docs[i][1] for i in kept]), np.array([i % 2 for i in kept]))
    assert np.allclose(model, want, atol=1e-4)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2 * len("zzbad words here") - 2)  # one clean text fits, no toxic one
    assert toxicity.score(rows, toxicity.fit(rows, labels)).filter("score >= 0.7").count() == 0
