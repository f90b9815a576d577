"""Media columns: audio features of byte payloads.

A payload is stored losslessly as unsigned 8-bit PCM in a WAV container. The
features are computed from the samples read back from that container:
polyphase resampling, overlapped log-mel filterbanks, hysteresis energy
segmentation, and one fixed-shape tensor for each segment with its time span.

Rows are independent, so the operator is one narrow stage: no shuffle, memory
bounded by a batch and the longest single payload.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, free_name, small_batches

RATE = 16_000
UP, DOWN, TAPS = 1, 2, 16
FRAME, HOP, MELS = 256, 128, 24
#: Shape of a segment's tensor: pooled frames x mel bands.
SHAPE = (8, MELS)
#: A segment opens at HIGH and closes below LOW, in natural-log energy over the file's mean.
HIGH, LOW = 0.10, -0.10
BLOCK = 576


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """An unsigned 8-bit mono PCM WAV file; odd data get RIFF's pad byte."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """The samples and rate of a file that wav_bytes() made, by walking its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (channels, bits) != (1, 8):
                raise ValueError("only 8-bit mono is read here")
        if kind == b"data":
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@lru_cache(maxsize=4)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """The polyphase branches, [up, taps], of a Hann-windowed sinc low-pass."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hanning(n + 2)[1:-1] * up
    return np.ascontiguousarray((h / h.sum() * up).reshape(taps, up).T[:, ::-1].astype(np.float32))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Rational-rate polyphase resampling; zero-padded at both ends."""
    branches = _phases(up, down, taps)
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    if up == 1:
        return view[:: down][:n_out] @ branches[0]
    m = np.arange(n_out) * down
    out = np.empty(n_out, np.float32)
    for p in range(up):
        mine = np.flatnonzero(m % up == p)
        out[mine] = view[m[mine] // up] @ branches[p]
    return out


@lru_cache(maxsize=4)
def _mel(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangular mel filters, [frame // 2 + 1, mels]."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    rise = (f[:, None] - hz[None, :-2]) / (hz[1:-1] - hz[:-2])
    fall = (hz[None, 2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies, [frames, MELS], and each frame's log energy; the last frame is zero-padded."""
    n = max(1, 1 + -(-max(0, len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    filters, mel, energy = _mel(rate, FRAME, MELS), np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for a in range(0, n, 512):  # bounded memory for long payloads
        spectrum = np.fft.rfft(view[a : a + 512] * window, axis=1)
        power = spectrum.real.astype(np.float32) ** 2 + spectrum.imag.astype(np.float32) ** 2
        mel[a : a + 512] = np.log(power @ filters + 1e-6)
        energy[a : a + 512] = np.log(power.sum(1) + 1e-6)
    return mel, energy


def hysteresis(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Frame spans that open where energy reaches high and last until it falls under low."""
    state = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    known = np.flatnonzero(state >= 0)
    if not len(known):
        return []
    last = np.searchsorted(known, np.arange(len(state)), side="right") - 1
    on = np.where(last >= 0, state[known[np.maximum(last, 0)]], 0)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def pooled(mel: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """A fixed-shape tensor for each span: its frames averaged into SHAPE[0] even parts."""
    k = SHAPE[0]
    if not spans:
        return np.zeros((0, *SHAPE), np.float32)
    total = np.concatenate([np.zeros((1, mel.shape[1])), np.cumsum(mel, axis=0, dtype=np.float64)])
    s = np.asarray(spans)
    size = (s[:, 1] - s[:, 0])[:, None]
    a = s[:, :1] + np.arange(k) * size // k
    b = np.maximum(s[:, :1] + np.arange(1, k + 1) * size // k, a + 1)
    return ((total[b] - total[a]) / (b - a)[:, :, None]).astype(np.float32)


def tensor_blob(tensors: np.ndarray, spans_ms: list[tuple[int, int]]) -> bytes:
    """An Arrow stream with a fixed_shape_tensor column and the time spans."""
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), SHAPE[0] * SHAPE[1])
    batch = pa.record_batch(
        [pa.ExtensionArray.from_storage(kind, flat), pa.array([a for a, _ in spans_ms], pa.int64()), pa.array([b for _, b in spans_ms], pa.int64())],
        names=["tensor", "start_ms", "end_ms"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(blob: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The tensors, [segments, *SHAPE], and time spans in ms of a tensor column's value."""
    table = pa.ipc.open_stream(blob).read_all()
    tensor = table["tensor"].combine_chunks()
    tensor = tensor.chunk(0) if isinstance(tensor, pa.ChunkedArray) else tensor
    values = tensor.to_numpy_ndarray() if len(tensor) else np.zeros((0, *SHAPE), np.float32)
    return values, list(zip(table["start_ms"].to_pylist(), table["end_ms"].to_pylist()))


def features(media: bytes) -> tuple[bytes, str, int]:
    """Tensor column value, a short digest of the features, and the number of segments."""
    samples, rate = wav_samples(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    mel, energy = log_mel(y, rate * UP / DOWN)
    spans = hysteresis(energy - energy.mean())
    step = 1000 * HOP * DOWN / UP / rate
    spans_ms = [(round(a * step), round(b * step)) for a, b in spans]
    tensors = pooled(mel, spans)
    digest = hashlib.sha256(np.round(tensors, 2).astype("<f4").tobytes() + repr(spans_ms).encode()).hexdigest()[:16]
    mean = ",".join(f"{v:.2f}" for v in mel.mean(axis=0)[::6])
    return tensor_blob(tensors, spans_ms), f"frames={len(mel)};segments={len(spans)};mel={mean};tensors={digest}", len(spans)


def audio_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds media (WAV), n_bytes, tensors (Arrow stream), n_segments and feature.

    The payload is the text's UTF-8 bytes and then bytes 255 up to a positive
    multiple of 576. Null text: like an empty one. Other columns pass through;
    columns of the added names are replaced. Repeated rows stay, equal texts
    get equal values, an empty table gives no rows.
    """
    key = free_name(df, "payload_text")
    added = {"media": "binary", "n_bytes": "bigint", "tensors": "binary", "n_segments": "bigint", "feature": "string"}
    rest = [c for c in df.columns if c.lower() not in added]
    schema = T.StructType([df.schema[c] for c in rest] + T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in added.items())).fields)
    source = df.select(*[df[f"`{c}`"] for c in rest], F.coalesce(df[f"`{text}`"], F.lit("")).cast("binary").alias(key))
    names = arrow_schema(schema)

    small_batches(df.sparkSession)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                media, size, blobs, count, said = [], [], [], [], []
                for value in batch.column(len(rest)):
                    raw = value.as_buffer().to_pybytes()
                    payload = raw + b"\xff" * (BLOCK - len(raw) if not raw else -len(raw) % BLOCK)
                    stored = wav_bytes(payload)
                    blob, digest, n = features(stored)
                    for out, x in zip((media, size, blobs, count, said), (stored, len(raw), blob, n, digest)):
                        out.append(x)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(rest)], pa.array(media, pa.binary()), pa.array(size, pa.int64()), pa.array(blobs, pa.binary()), pa.array(count, pa.int64()), pa.array(said, pa.string())],
                    schema=names,
                )

    return source.mapInArrow(run, schema)


def payload_of(media):
    """The stored samples of a media column, read back from the container."""
    return F.substring(media, 45, 2**31 - 46)


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = audio_columns(docs).drop("tensors")
    payload = payload_of(F.col("media"))  # always of even length, so RIFF adds no pad byte
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "n_segments",
    )
