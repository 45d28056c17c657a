"""Byte n-grams of whole texts as 63-bit integers, their counts over a corpus, and scoring by a table of them.

A symbol takes 9 bits: 0 fills the context before a text, 1 to 256 are the bytes and 257 ends a text. A gram is the `order`
symbols of context followed by the symbol they predict, so a text of n bytes has n + 1 grams and every lower-order count is
the sum of the grams that share a suffix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, SYMBOL = 9, 511
END = 257
#: Positions handled at once: bounds a task's memory whatever the length of a text.
PIECE, FLUSH = 1 << 18, 1 << 22


def mask(n: int) -> np.int64:
    """Of the last n symbols."""
    return np.int64((1 << BITS * n) - 1)


def symbols(text: bytes | None, order: int):
    """Pieces of a text: the context and the symbols that follow it."""
    text = text or b""
    full = np.zeros(order + len(text) + 1, np.int64)
    full[order:-1] = np.frombuffer(text, np.uint8)
    full[order:-1] += 1
    full[-1] = END
    for k in range(0, len(text) + 1, PIECE):
        yield full[k : k + PIECE + order]


def keys(pieces: list[np.ndarray], order: int) -> np.ndarray:
    """The grams of all pieces, one after the other."""
    s = np.concatenate(pieces)
    g = np.zeros(max(0, len(s) - order), np.int64)
    for k in range(order + 1):
        g <<= BITS
        g |= s[k : k + len(g)]
    keep = np.ones(len(g), bool)
    at = np.cumsum([len(p) for p in pieces])[:-1]
    for k in range(order):
        keep[at - order + k] = False
    return g[keep]


def totals(key: np.ndarray, *n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of n over each."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return (k[at], *(np.add.reduceat(x[order], at) if len(at) else x[:0] for x in n))


class Counter:
    """Counts of 64-bit keys in two columns, merged whenever FLUSH positions are held."""

    def __init__(self):
        self.held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.size = 0

    def add(self, key: np.ndarray, train: bool) -> None:
        self.held[train].append(key)
        self.size += len(key)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, counts in training texts, counts in all texts)"""
        got = {t: np.unique(np.concatenate(x), return_counts=True) for t, x in self.held.items() if x}
        self.held, self.size = {False: [], True: []}, 0
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        (a, m), (b, n) = got.get(True, none), got.get(False, none)
        return totals(np.concatenate([a, b]), np.concatenate([m, np.zeros(len(n), np.int64)]), np.concatenate([m, n]))


class Lookup:
    """Values by key in sorted arrays; `None` columns are left out. The first bits of a mixed key lead to a short run."""

    def __init__(self, key: np.ndarray, *values: np.ndarray):
        mixed = self.mix(key)
        order = np.argsort(mixed, kind="stable")
        self.key, self.values = mixed[order], [v[order] for v in values]
        self.bits = max(1, int(len(key)).bit_length())
        self.start = np.searchsorted(self.key, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(64 - self.bits)) if len(key) else np.zeros(3, np.int64)
        if len(key):
            self.start[-1] = len(key)
        self.start = self.start.astype(np.int32)
        self.most = int(np.diff(self.start).max()) if len(key) else 0

    @staticmethod
    def mix(key: np.ndarray) -> np.ndarray:
        """One to one, so that equal mixed keys are equal keys."""
        x = key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it isn't there."""
        out = np.full(len(key), -1, np.int32)
        if not len(self.key):
            return out
        m = self.mix(key)
        slot = (m >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        hit = self.key[np.minimum(at, len(self.key) - 1)] == m
        out[hit] = at[hit]
        todo = np.flatnonzero(~hit & (at + 1 < end))
        for k in range(1, self.most):
            if not len(todo):
                break
            a = at[todo] + k
            hit = self.key[a] == m[todo]
            out[todo[hit]] = a[hit]
            todo = todo[~hit & (a + 1 < end[todo])]
        return out


def _model_rows(df: DataFrame, kinds: list) -> list[np.ndarray]:
    t = df.toArrow().combine_chunks()
    return [t.column(k).to_numpy().astype(kind) for k, kind in enumerate(kinds)]


def fetched(df: DataFrame, kinds: list) -> list[np.ndarray]:
    """The columns of a table whose size the caller has checked, as arrays."""
    return _model_rows(df, kinds)


def batch_of(batches, text_column: int, most: int = 1 << 21):
    """Record batches split so that one holds about `most` bytes of text, or a single row."""
    for b in batches:
        size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(text_column)], np.int64)
        cut = [0]
        held = 0
        for k, n in enumerate(size):
            if held and held + n > most:
                cut.append(k)
                held = 0
            held += n
        for lo, hi in zip(cut, [*cut[1:], b.num_rows], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def sums_by_text(values: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Sum of the values of each text, which has one at least."""
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return np.add.reduceat(values.astype(np.float64), at) if len(lengths) else np.zeros(0)


def summed(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


__all__ = ["BITS", "END", "FLUSH", "SYMBOL", "Counter", "Lookup", "batch_of", "fetched", "keys", "mask", "pa", "summed", "sums_by_text", "symbols", "totals"]
