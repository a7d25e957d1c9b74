"""Hashed word shingles of a text, and signatures that similar sets must share.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A set holds 64-bit hashes of all
distinct runs of five words; fewer words make one shingle of the whole sequence.

Segment signatures: sets x and y with Jaccard similarity of at least 4/5 and |x| <= |y| differ in at
most (|x| + |y|) / 9 <= |x| / 4 elements, and |y| <= 5/4 |x|. Cut the hash range into more parts than
that; if more parts than the greatest difference hold elements, some part holds equal elements in both
sets, and its signature is shared. A set with too few filled parts also signs a finer cut, at last one
of single elements, so no pair is missed. Sizes are grouped in classes, and a set that may be the
larger partner of the class below signs there too. There are more parts than needed, so that similar
sets share several signatures and each may leave out its most frequent ones, which passages cause that
many texts repeat.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np

SIZE = 5
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = [int(x) for x in _RANDOM.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, extended as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            tables = np.array([[_BASE], [_INVERSE]], np.uint64).repeat(n, axis=1)
            tables[:, 0] = 1
            self.up, self.down = np.cumprod(tables, axis=1, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a lower-cased text: its bytes as a polynomial modulo 2**64, mixed."""
    data = np.frombuffer(text, np.uint8)
    solid = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    words = word_hashes((text or b"").lower())
    n = len(words)
    if not n:
        return words
    if n < SIZE:
        total = np.uint64(0xA5A5A5A5)
        return mixed(np.atleast_1d((words * np.array(_PLACES[:n], np.uint64)).sum(dtype=np.uint64) + total * np.uint64(n)))
    total = np.zeros(n - SIZE + 1, np.uint64)
    for i, place in enumerate(_PLACES):
        total += words[i : n - SIZE + 1 + i] * np.uint64(place)
    return np.unique(mixed(total))


def digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


TAG_BITS = 8  # a signature's lowest bits name its class and cut


def _bounds() -> list[int]:
    found = [1]
    while len(found) < 1 << TAG_BITS - 2:
        found.append(max(found[-1] + 1, found[-1] * 3 // 2))
    return found


BOUNDS = _bounds()  # first size of each class
LEVELS = 3  # cuts of a class: coarse, twice as fine, single elements


def differences(label: int) -> int:
    """The most elements in which similar sets differ, the smaller one being of this class."""
    return (BOUNDS[label + 1] - 1) // 4


def _sign(items: np.ndarray, tag: int, parts: int) -> np.ndarray:
    """Signatures of the filled parts of a cut of the hash range; 0 parts: of single elements."""
    if parts:
        part = (items >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        values, where = np.add.reduceat(mixed(items), starts), part[starts]
    else:
        values, where = mixed(items), np.zeros(len(items), np.uint64)
    seed = np.uint64((tag + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    low = np.uint64((1 << TAG_BITS) - 1)
    return mixed(values + mixed(where + seed)) & ~low | np.uint64(tag)


def signatures(items: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(tag, signatures) of each cut that a set signs.

    In a cut of which a set fills f parts, it shares at least f - d signatures with every set that it
    must meet there, d being the class's differences(). So of each cut, after any one order of all
    signatures, its first d + 1 are enough: one of them is shared, and is among the other set's too.
    """
    n = len(items)
    if not n:
        return []
    own = bisect_right(BOUNDS, n) - 1
    labels = [own]
    if own and 4 * n <= 5 * (BOUNDS[own] - 1):
        labels.append(own - 1)
    out = []
    for label in labels:
        differ = differences(label)
        parts = (differ + 1) * 13 // 10 + 1
        for level in range(LEVELS):
            tag = label * 4 + level
            found = _sign(items, tag, (parts << level) if level < LEVELS - 1 else 0)
            out.append((tag, found))
            if len(found) > differ:
                break
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
