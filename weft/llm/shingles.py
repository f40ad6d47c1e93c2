"""Word shingles of text batches as 64-bit hashes, and MinHash signatures over them (numpy, inside tasks).

Words are runs of characters other than the six ASCII spaces (blank and 0x09-0x0D), compared as bytes.
A document's shingles are the set of its runs of ``k`` successive words.  A text with fewer words than
``k``, but at least one, has a single shingle: all of its words.  Null, empty and blank texts have none.
"""
from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and for each text the offset of its first word (length + 1)."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(b) for b in blobs), dtype=np.int64, count=len(blobs))
    ends_text = np.cumsum(lengths + 1)
    space = _SPACE[data]
    inside = ~space
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(space & before)
    # polynomial prefix sums modulo 2**64, so that each word's hash is one subtraction
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE), out=prefix[1:])
    back = _powers(len(data), _INV)
    hashes = mix64((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    offsets = np.zeros(len(blobs) + 1, dtype=np.int64)
    offsets[1:] = np.searchsorted(starts, ends_text)
    return hashes, offsets


def shingle_sets(texts: Iterable[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, with offsets (length + 1)."""
    words, offsets = word_hashes(texts)
    rolled = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        rolled = rolled * _STEP + words[i : i + len(rolled)]
    rolled = mix64(rolled)
    sets = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            one = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                one = one * _STEP + w
            sets.append(mix64(one + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    out = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=out[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), out


def minhash_params(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minhash(flat: np.ndarray, offsets: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """MinHash signatures (texts x n, uint32) of concatenated shingle sets; empty sets give all ones."""
    out = np.full((len(offsets) - 1, n), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    mult, add = minhash_params(n, seed)
    low = (flat >> np.uint64(32)).astype(np.uint32)
    starts = offsets[full]
    for j in range(n):
        out[full, j] = np.minimum.reduceat((low ^ add[j]) * mult[j], starts)
    return out


def set_digest(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Order-free 64-bit digest of each set (sum of mixed members, with the size)."""
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(mix64(flat + _STEP), out=sums[1:])
    return mix64((sums[offsets[1:]] - sums[offsets[:-1]]) + np.diff(offsets).astype(np.uint64))
