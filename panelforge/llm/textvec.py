"""Vectorised text access: words, word hashes and shingles of many texts at once, straight from the
UTF-8 buffers of an Arrow string array. Nothing here makes a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 19

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words separated by the bytes 0x20 and 0x09-0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, a-z and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        def run(p: np.uint64) -> np.ndarray:
            x = np.full(max(n, _BLOCK), p, dtype=np.uint64)
            x[0] = 1
            return np.multiply.accumulate(x)

        _powers = run(_P), run(_P_INV)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its texts in them."""
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offs = np.frombuffer(arr.buffers()[1], dtype=width)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


class Words:
    """The words of n texts: start and end byte of each word, and the n + 1 word offsets of the texts."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, kind: np.ndarray = SPACED, lower: bool = True):
        self.buf = LOWER[raw] if lower else raw
        inside = kind[self.buf]
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            cuts = offs[:-1][offs[:-1] < len(inside)]
            before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        if len(inside):
            after[-1] = False
            after[:-1] = inside[1:]
            cuts = offs[1:][offs[1:] > 0] - 1
            after[cuts] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.offs = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), dtype=np.uint64)
        i, n = 0, len(self.start)
        while i < n:
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + _BLOCK, side="right")))
            b = self.end[j - 1]
            p, inv = _pow(int(b - a) + 1)
            total = np.empty(int(b - a) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[self.buf[a:b]] * p[: b - a], out=total[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = (total[e] - total[s]) * inv[s]
            i = j
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles of one word sequence; a shorter one is a single shingle."""
    if not len(h):
        return h
    m = min(n, len(h))
    out = np.zeros(len(h) - m + 1, dtype=np.uint64)
    for k in range(m):
        out += mix(h[k : k + len(out)] * _GRAM[k] + _GRAM[k + 32])
    return mix(out + np.uint64(m))


def gram_sets(w: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text, sorted, one after the other, and their offsets."""
    count = len(w.offs) - 1
    parts = [np.unique(grams(h[w.offs[i] : w.offs[i + 1]], n)) for i in range(count)]
    offs = np.zeros(count + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offs[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offs


class Counts:
    """Counts of 64-bit keys, handed out when there are many."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.size += len(k)
        if self.size > 2 * self.limit:
            self._merge()
            if self.size > self.limit:
                yield from self.out()

    def _merge(self) -> None:
        k, c = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        u, at = np.unique(k, return_inverse=True)
        self.parts, self.size = [(u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64))], len(u)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            k, c = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["k", "c"])
        self.parts, self.size = [], 0
