"""Whole batches of UTF-8 text at once in NumPy: word bounds and hashes of words, word windows and byte windows.

A range of bytes is hashed eight bytes at a step, each step a bijection of the state mixed with the bytes, so different
bytes have equal hashes by chance alone, whatever their pattern (a polynomial modulo a power of two has patterns that
collide). Windows of one length at every place are hashed by doubling: the hash of 2n bytes is a mix of two of n."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260101))
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
#: Ranges of more bytes go one by one to BLAKE2, so a long range costs no steps for the short ones.
LONG = 512
#: The bytes that are in a range of which so many are left.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def view(column, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of rows at..to of a pyarrow binary array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset + at : column.offset + to + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as a number, the first lowest; beyond the end they are 0."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded.tobytes(), strides=(1,))


class Hashes:
    """Hashes of any byte ranges of buf."""

    def __init__(self, buf: np.ndarray, salt: int = 0) -> None:
        self.buf, self.eight, self.salt = buf, eights(buf), salt

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(U) * _ODD[62] + _ODD[63] + U(self.salt))
        live, depth = np.flatnonzero(size <= LONG), 0
        while len(live):
            left = size[live] - depth
            if left.min() <= 0:
                live = live[left > 0]
                continue
            word = self.eight[start[live] + depth].astype(U) & _MASK[np.minimum(left, 8)]
            out[live] = mix((out[live] ^ word) * _ODD[61])
            depth += 8
        for i in np.flatnonzero(size > LONG):
            digest = hashlib.blake2b(self.buf[start[i] : end[i]], digest_size=8, key=self.salt.to_bytes(8, "little"))
            out[i] = int.from_bytes(digest.digest(), "little")
        return out


def grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes (8 or more) from every place that has as many."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, size = mix(eights(buf)[: len(buf) - 7] ^ _ODD[60]), 8
    while size < k:
        step = min(size, k - size)
        out = mix(out[:-step] * _ODD[59] + out[step:])
        size += step
    return out


class Words:
    """Words of the rows of a batch: byte bounds start and end, row, first (of each row, and the end)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        solid = ~SPACE[buf]
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        open_, close = np.empty(len(buf), bool), np.empty(len(buf), bool)
        if len(buf):
            open_[0], close[-1] = True, True
            open_[1:], close[:-1] = ~solid[:-1], ~solid[1:]
            open_[offsets[filled]], close[offsets[filled + 1] - 1] = True, True
        self.start = np.flatnonzero(solid & open_)
        self.end = np.flatnonzero(solid & close) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.solid = solid

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive word hashes, len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF, U)
    for j in range(k):
        out = mix(out * _ODD[58] + hashes[j : j + n])
    return out


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, A-Z lower-cased: hashes, sorted within a row, and each row's first.
    A row of fewer words has its whole sequence as one, one without words none."""
    buf = LOWER[buf]
    w = Words(buf, offsets)
    h = Hashes(buf).of(w.start, w.end)
    counts = w.counts()
    all_ = windows(h, k)
    out, first = [], np.zeros(len(offsets), np.int64)
    for i, n in enumerate(counts):
        at = w.first[i]
        if n >= k:
            own = np.sort(all_[at : at + n - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = windows(h[at : at + n], int(n))
        else:
            own = np.zeros(0, U)
        out.append(own)
        first[i + 1] = first[i] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, U)), first
