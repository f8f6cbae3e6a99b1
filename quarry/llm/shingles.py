"""Word-shingle sets of many texts at once, in numpy.

Words are runs of bytes other than the six ASCII blanks, A-Z lower-cased.  A
text's set holds the 64-bit hashes of its distinct ``size``-word shingles; a
text with fewer words (but some) is one shingle, one without words is empty.
Everything is prefix sums over the batch's bytes: no per-word Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20250101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text); null as empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    offsets -= offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    word = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)  # a text's first byte
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _power(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power, out=sums[1:], dtype=np.uint64)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text one after the other,
    set size of every text)."""
    words, counts = word_hashes(texts)
    first = np.cumsum(counts) - counts
    if not len(words):
        return words, counts
    doc = np.repeat(np.arange(len(counts)), counts)
    sums = np.zeros(len(words), np.uint64)
    for k in range(size):
        sums[: len(words) - k] += words[k:] * _PLACE[k]
    whole = (first + counts)[doc] - np.arange(len(words)) >= size
    hashes, owner = mix(sums[whole], 1), doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = [mix(np.array([(words[first[d]: first[d] + counts[d]] * _PLACE[: counts[d]]).sum(dtype=np.uint64)]), 1 + int(counts[d]) * 7)[0] for d in short]
        hashes, owner = np.concatenate([hashes, np.array(own, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.bincount(owner[keep], minlength=len(counts))


def set_digests(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 16-byte digest of every set (an array of void-16), whatever the order."""
    ends = np.cumsum(sizes)
    out = np.zeros((len(sizes), 2), np.uint64)
    for k in range(2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes, 11 + k), dtype=np.uint64)])
        out[:, k] = mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64), 21 + k)
    return out


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """Bit i is the parity of the hashes that fall on it; the number of bits
    is the power of two at or above twice the set's size (64 at least).  The
    XOR of two sets' bitmaps has at most as many bits as the sets differ in
    elements, which bounds their overlap from above."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    at = (mix(hashes, 31) & _U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def fold(bitmap: np.ndarray, n: int) -> np.ndarray:
    """A parity bitmap (bytes) folded to n bytes: lower address bits stay."""
    while len(bitmap) > n:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements the two sets differ in."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, n) ^ fold(y, n)).sum())
