"""Counting quotient filters of packed n-grams: exact counters in sorted, compact form.

A key is an n-gram of word ids, packed into two lanes of at most 64 bits. A Feistel network permutes
the keys: it can be undone, and spreads them evenly. The leading bits of a permuted key are its quotient;
all its other bits are kept as the remainder, so nothing is lost and no two keys are mixed up.
A filter holds the keys of one range of leading bits in order: a bit for each quotient that occurs,
a bit for each entry that ends the run of its quotient, the remainders in as few bytes as they
need, and a byte for each count (larger counts aside). Sorted filters are merged by
adding the counts of equal keys.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
_KEYS = np.random.default_rng(77).integers(1, 1 << 63, size=6, dtype=np.uint64)
_HEAD = struct.Struct("<qqqq")


def _mixed(x: np.ndarray, key: np.uint64, bits: int) -> np.ndarray:
    h = (x ^ key) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15) >> _U(64 - bits)


class Keys:
    """n-grams of ids of ``bits`` bits as permuted keys."""

    def __init__(self, n: int, bits: int):
        if not 0 < bits <= 32 or not 2 <= n <= 4:
            raise ValueError("two to four ids of at most 32 bits")
        self.n, self.bits = n, bits
        self.left, self.right = bits * (n // 2), bits * (n - n // 2)

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The lanes of n-grams whose i-th words are ids[i], permuted."""
        half, b = self.n // 2, _U(self.bits)
        lanes = []
        for part in (ids[:half], ids[half:]):
            lane = part[0].astype(np.uint64)
            for more in part[1:]:
                lane = (lane << b) | more.astype(np.uint64)
            lanes.append(lane)
        left, right = lanes
        for i in range(0, 6, 2):
            right = right ^ _mixed(left, _KEYS[i], self.right)
            left = left ^ _mixed(right, _KEYS[i + 1], self.left)
        return left, right

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        for i in (4, 2, 0):
            left = left ^ _mixed(right, _KEYS[i + 1], self.left)
            right = right ^ _mixed(left, _KEYS[i], self.right)
        mask, out = _U((1 << self.bits) - 1), []
        for lane, words in ((left, self.n // 2), (right, self.n - self.n // 2)):
            out += [((lane >> _U(self.bits * k)) & mask).astype(np.int64) for k in range(words - 1, -1, -1)]
        return out

    def summed(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, each once, with the sum of its counts. Sorted runs are merged, as the sort is a run-aware one."""
        if not len(left):
            return left, right, counts
        if self.left + self.right <= 64:
            order = np.argsort((left << _U(self.right)) | right, kind="stable")
        else:
            order = np.lexsort((right, left))
        left, right, counts = left[order], right[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        return left[first], right[first], np.add.reduceat(counts, first)


def _trimmed(values: np.ndarray, bits: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)].tobytes()


def _widened(data: memoryview, m: int, bits: int) -> np.ndarray:
    size = -(-bits // 8)
    out = np.zeros((m, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data[:m * size], dtype=np.uint8).reshape(m, size)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def encode(keys: Keys, prefix: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of sorted keys that agree in their first ``prefix`` bits."""
    m = len(left)
    q = min(keys.left - prefix, max(0, m.bit_length() - 1))
    rest = keys.left - prefix - q
    own = left & _U((1 << (keys.left - prefix)) - 1)
    quotient = (own >> _U(rest)).astype(np.int64)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    ends = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if m else np.empty(0, bool)
    large = np.flatnonzero(counts >= 255)
    small = np.minimum(counts, 255).astype(np.uint8)
    return b"".join([_HEAD.pack(m, q, prefix, len(large)), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), small.tobytes(),
                     counts[large].astype("<i8").tobytes(), _trimmed(own & _U((1 << rest) - 1), rest), _trimmed(right, keys.right)])


def decode(keys: Keys, place: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted keys and counts of the filter of range ``place``."""
    m, q, prefix, n_large = _HEAD.unpack_from(data)
    at, view = _HEAD.size, memoryview(data)

    def take(n: int) -> memoryview:
        nonlocal at
        at += n
        return view[at - n:at]

    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(take(-(-(1 << q) // 8)), dtype=np.uint8), count=1 << q))
    ends = np.unpackbits(np.frombuffer(take(-(-m // 8)), dtype=np.uint8), count=m).astype(np.int64)
    counts = np.frombuffer(take(m), dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(take(8 * n_large), dtype="<i8")
    rest = keys.left - prefix - q
    low = _widened(take(m * -(-rest // 8)), m, rest)
    right = _widened(take(m * -(-keys.right // 8)), m, keys.right)
    quotient = occupied[np.cumsum(ends) - ends].astype(np.uint64) if m else np.empty(0, np.uint64)
    left = (quotient << _U(rest)) | low
    if prefix:
        left |= _U(place) << _U(keys.left - prefix)
    return left, right, counts


def find(keys: Keys, place: int, data: bytes, ids: list[int]) -> int:
    """The count of one n-gram; 0 if the filter has none."""
    left, right = keys.pack([np.array([i]) for i in ids])
    lefts, rights, counts = decode(keys, place, data)
    at = np.flatnonzero((lefts == left) & (rights == right))
    return int(counts[at[0]]) if len(at) else 0
