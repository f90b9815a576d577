"""Portable Roaring bitmaps: 32-bit sets, and 64-bit sets as maps of them."""

from __future__ import annotations

import struct

import numpy as np

COOKIE_RUNS, COOKIE = 12347, 12346


def read32(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The values, ascending, and the place after the bitmap."""
    cookie = struct.unpack_from("<I", raw, at)[0]
    if cookie & 0xFFFF == COOKIE_RUNS:
        n, at = (cookie >> 16) + 1, at + 4
        runs = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), bitorder="little")[:n].astype(bool)
        at += (n + 7) // 8
    elif cookie == COOKIE:
        n, at = struct.unpack_from("<I", raw, at + 4)[0], at + 8
        runs = np.zeros(n, bool)
    else:
        raise ValueError("not a Roaring bitmap")
    heads = np.frombuffer(raw, "<u2", 2 * n, at).reshape(n, 2)
    at += 4 * n
    if not runs.any() or n >= 4:
        at += 4 * n  # offsets, which the order of the containers implies
    out = []
    for (key, card), run in zip(heads.tolist(), runs.tolist()):
        base = key << 16
        if run:
            k = struct.unpack_from("<H", raw, at)[0]
            pairs = np.frombuffer(raw, "<u2", 2 * k, at + 2).reshape(k, 2).astype(np.int64)
            at += 2 + 4 * k
            out += [np.arange(a, a + b + 1) + base for a, b in pairs.tolist()]
        elif card + 1 <= 4096:
            out.append(np.frombuffer(raw, "<u2", card + 1, at).astype(np.int64) + base)
            at += 2 * (card + 1)
        else:
            out.append(np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, 8192, at), bitorder="little")) + base)
            at += 8192
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), at


def write32(values) -> bytes:
    v = np.unique(np.asarray(values, np.int64))
    keys, first = np.unique(v >> 16, return_index=True)
    parts = np.split(v & 0xFFFF, first[1:]) if len(keys) else []
    heads, bodies = b"", []
    for key, part in zip(keys.tolist(), parts):
        heads += struct.pack("<HH", key, len(part) - 1)
        if len(part) <= 4096:
            bodies.append(part.astype("<u2").tobytes())
        else:
            bits = np.zeros(65536, np.uint8)
            bits[part] = 1
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
    at, offsets = 8 + len(heads) + 4 * len(parts), b""
    for b in bodies:
        offsets += struct.pack("<I", at)
        at += len(b)
    return struct.pack("<II", COOKIE, len(parts)) + heads + offsets + b"".join(bodies)


def read64(raw: bytes) -> np.ndarray:
    n, at, out = struct.unpack_from("<Q", raw, 0)[0], 8, []
    for _ in range(n):
        high = struct.unpack_from("<I", raw, at)[0]
        values, at = read32(raw, at + 4)
        out.append(values + (high << 32))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def write64(values) -> bytes:
    v = np.unique(np.asarray(values, np.int64))
    keys, first = np.unique(v >> 32, return_index=True)
    parts = np.split(v & 0xFFFFFFFF, first[1:]) if len(keys) else []
    return struct.pack("<Q", len(parts)) + b"".join(struct.pack("<I", k) + write32(p) for k, p in zip(keys.tolist(), parts))


def contains(values: np.ndarray, x: int) -> bool:
    i = int(np.searchsorted(values, x))
    return i < len(values) and int(values[i]) == x
