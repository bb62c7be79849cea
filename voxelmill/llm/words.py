"""Word ids and hashes shared by the text operators. Everything here runs inside Arrow batches."""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z and nothing else.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: ASCII characters that are neither letters nor digits become spaces.
ASCII_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class Vocabulary:
    """Numbers words in the order of first sight. ``fresh`` gives the words numbered since the last call.

    Bounded: ``renew`` forgets everything once more than ``cap`` words are held, and says so.
    """

    def __init__(self, cap: int = 300_000):
        self.cap = cap
        self._ids: defaultdict = defaultdict(itertools.count().__next__)
        self._known = 0

    def renew(self) -> bool:
        if len(self._ids) <= self.cap:
            return False
        self._ids = defaultdict(itertools.count().__next__)
        self._known = 0
        return True

    def __len__(self) -> int:
        return len(self._ids)

    def words(self) -> list:
        return list(self._ids)

    def number(self, words: list) -> np.ndarray:
        return np.fromiter(map(self._ids.__getitem__, words), dtype=np.int64, count=len(words))

    def fresh(self) -> list:
        new = len(self._ids) - self._known
        self._known = len(self._ids)
        return list(itertools.islice(reversed(self._ids), new))[::-1]


class GrowingTable:
    """Rows by word id, appended as words appear."""

    def __init__(self, width: int | None, dtype):
        self._rows = np.zeros((1024,) if width is None else (1024, width), dtype=dtype)
        self.n = 0

    def append(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self._rows):
            grown = np.zeros((max(need, 2 * len(self._rows)), *self._rows.shape[1:]), dtype=self._rows.dtype)
            grown[: self.n] = self._rows[: self.n]
            self._rows = grown
        self._rows[self.n : need] = rows
        self.n = need

    @property
    def rows(self) -> np.ndarray:
        return self._rows[: self.n]


def hash64(words: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer than k words make one shingle; none, an empty set."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if n < k:
            return mix(np.array([np.sum(h * _MULT[:n], dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
        s = h[: n - k + 1] * _MULT[0]
        for j in range(1, k):
            s = s + h[j : n - k + 1 + j] * _MULT[j]
        return np.unique(mix(s))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def fold_of(doc_id, folds: int) -> int:
    """crc32 of the id written as text, modulo folds."""
    return zlib.crc32(str(doc_id).encode()) % folds


def slices(batch: pa.RecordBatch, max_rows: int = 1000, max_bytes: int = 16 << 20):
    """Parts of a batch of at most so many rows and about so many bytes."""
    if not batch.num_rows:
        return
    rows = max(1, min(max_rows, int(max_bytes * batch.num_rows / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
