"""Vectorised word and shingle hashing over Arrow text batches (used inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; bounds the working arrays whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20
#: Words in a shingle.
SHINGLE = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its text passes `limit` bytes; a single longer text comes alone."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    word[128:] = True
    for low, high in ((48, 58), (97, 123)):
        word[low:high] = True
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
    return word, values


@lru_cache(maxsize=1)
def _powers() -> list:
    return [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    held = _powers()
    if len(held[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for k, base in enumerate((_ODD, inverse)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            held[k] = np.multiply.accumulate(table)
    return held[0], held[1]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of every text in order, offsets of the texts in it).

    A word is a run of letters, digits and non-ASCII characters of the lower-cased text.
    """
    lowered = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([b"", *lowered, b""]), np.uint8)
    is_word, values = _tables()
    hashes, places, low = [], [], 0
    while low < len(data):  # pieces that end between words, so that a very long text needs little at once
        high = min(low + SLICE_BYTES, len(data))
        while high < len(data) and is_word[data[high - 1]]:
            rest = is_word[data[high : high + 4096]]
            high += len(rest) if rest.all() else int(rest.argmin()) + 1
        piece = data[low:high]
        edges = np.diff(np.concatenate([[False], is_word[piece], [False]]).view(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        power, inverse = _power_table(len(piece))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * power[: len(piece)], out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * inverse[starts]))
        places.append(starts + low)
        low = high
    at = np.cumsum([1, *(len(x) + 1 for x in lowered)])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), at)


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of the `width` consecutive words from each position on (shorter by width - 1)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _ODD + hashes[k : k + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles of one text; a text of fewer words has one shingle of all of them, an empty one none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(shingles(hashes, min(width, len(hashes))))
