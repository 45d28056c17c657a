"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words, A-Z lower-cased, split at ASCII white space.

    Fewer words, but not none, are one shingle of their own; no words or no text: empty.
    """
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - width + 1
    s = np.zeros(n, np.uint64)
    for k in range(width):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mixed(s))
