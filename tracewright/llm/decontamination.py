"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For every benchmark item, the windows of a document with as many words as the item are compared with it. A window gets
a 64-bit SimHash of its five-word shingles; the items' fingerprints are indexed by eight 8-bit blocks, and probing each
block within radius // 8 finds every fingerprint within `radius` (pigeonhole). Candidates are verified by the weighted
Jaccard similarity of the shingle multisets. Windows that hold too few benchmark shingles for the threshold to be
reachable are skipped beforehand, which loses none. A document shorter than an item is its own single window, compared
with the items that share a shingle with it. Items of fewer than five words are one shingle of all their words, found by
equality. Documents are never shuffled; they are read once for every CHUNK_BYTES of benchmark text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SHINGLE, shingles, slices, strings, words

#: Least weighted Jaccard similarity of a window and an item.
SIMILARITY = 0.8
#: Fingerprints compared within this Hamming distance. At similarity 0.8 the expected distance is about 10 of 64 bits.
RADIUS = 20
BLOCKS = 8
#: Benchmark text sent to every task at once; a larger benchmark is handled in several passes over the documents.
CHUNK_BYTES = 16 << 20
#: Windows of a text, and (window, item) cells, that are looked at together.
WINDOWS, CELLS = 1 << 14, 1 << 20
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_BITMAP = 20


def simhash(window_sums: np.ndarray) -> np.ndarray:
    """Signs of the 64 bit sums of each window as one fingerprint each (uint64)."""
    return np.packbits(window_sums >= 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _bit_sums(features: np.ndarray) -> np.ndarray:
    """Running sums over features of +1 / -1 per bit; row i covers the first i features."""
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.zeros((len(features) + 1, 64), np.int32)
    np.cumsum(bits * 2 - 1, axis=0, out=sums[1:])
    return sums


class BenchmarkIndex:
    """Fingerprints and shingles of benchmark items, by item length."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        hashes, offsets = words([t or "" for _, t in items])
        self.item_ids, self.multisets, by_length, short = [], [], {}, {}
        for k, (item_id, _) in enumerate(items):
            own = hashes[offsets[k] : offsets[k + 1]]
            if len(own) >= SHINGLE:
                features = shingles(own)
                fingerprint = simhash(_bit_sums(features)[-1:])[0]
                by_length.setdefault(len(own), []).append((len(self.item_ids), fingerprint))
                self.item_ids.append(item_id)
                self.multisets.append(np.unique(features, return_counts=True))
            elif len(own):
                short.setdefault(len(own), []).append((shingles(own, len(own))[0], item_id))
        #: for each number of words below five, the sorted shingles and their items
        self.short = {n: (np.array([f for f, _ in pairs], np.uint64), [i for _, i in pairs]) for n, group in sorted(short.items()) for pairs in [sorted(group, key=lambda g: g[0])]}
        known = [m[0] for m in self.multisets]
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[(self.known >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
        self.lengths = {n: self._block_tables(group) for n, group in sorted(by_length.items())}
        self.sizes, self.prints = np.zeros(len(self.item_ids), np.int64), np.zeros(len(self.item_ids), np.uint64)
        for n, group in by_length.items():
            for number, fingerprint in group:
                self.sizes[number], self.prints[number] = n - SHINGLE + 1, fingerprint
        # items by shingle: those of known[k] are posted[posts[k] : posts[k + 1]]
        owner = np.repeat(np.arange(len(known)), [len(f) for f in known])
        place = np.searchsorted(self.known, np.concatenate(known)) if known else np.zeros(0, np.int64)
        self.posted = owner[np.argsort(place, kind="stable")].astype(np.int32)
        self.posts = np.r_[0, np.cumsum(np.bincount(place, minlength=len(self.known)))]

    def _block_tables(self, group: list[tuple[int, np.uint64]]):
        """Item numbers, fingerprints and, for each block, the items whose block value is near each of the 256 values."""
        numbers = np.array([g[0] for g in group])
        prints = np.array([g[1] for g in group], np.uint64)
        values = prints.view(np.uint8).reshape(-1, BLOCKS)
        tables = []
        for b in range(BLOCKS):
            near = _POPCOUNT[np.arange(256, dtype=np.uint8)[:, None] ^ values[None, :, b]] <= self.radius // BLOCKS
            tables.append((np.r_[0, np.cumsum(near.sum(axis=1))], np.nonzero(near)[1]))
        return numbers, prints, tables

    def known_positions(self, features: np.ndarray) -> np.ndarray:
        """Which features are shingles of some item."""
        hit = self.bitmap[(features >> np.uint64(64 - _BITMAP)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, features[at]), len(self.known) - 1)
            hit[at] = self.known[place] == features[at]
        return hit

    def matches(self, features: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item id, first word, words, similarity, Hamming distance) of the best window for each matched item."""
        best: dict[int, tuple] = {}
        longest = max(self.lengths, default=0)
        for base in range(0, len(features), WINDOWS):
            own = slice(base, base + WINDOWS + longest)
            if hit[own].any():
                self._windows(features[own], hit[own], base, best)
        best |= self._longer_items(features, hit, int(hit.sum()))
        return [(self.item_ids[k], *v) for k, v in sorted(best.items())]

    def _windows(self, features: np.ndarray, hit: np.ndarray, base: int, best: dict[int, tuple]) -> None:
        """Updates `best` from the windows that start at the first WINDOWS places of a piece of a text, which begins at `base`."""
        seen = np.r_[0, np.cumsum(hit)]
        total, sums = int(seen[-1]), None
        for n, (numbers, prints, tables) in self.lengths.items():
            m = n - SHINGLE + 1
            if m > len(features):  # see _longer_items
                break
            # similarity = shared / (2 m - shared), so a match shares at least this many shingles, all of them known
            least = math.ceil(2 * m * self.similarity / (1 + self.similarity) - 1e-9)
            if total < least:
                continue
            starts = np.flatnonzero((seen[m:] - seen[:-m])[:WINDOWS] >= least)
            if not len(starts):
                continue
            if sums is None:
                sums = _bit_sums(features)
            fingerprints = simhash(sums[starts + m] - sums[starts])
            step = max(1, CELLS // len(numbers))
            for k in range(0, len(starts), step):
                for window, item in self._candidates(fingerprints[k : k + step], prints, tables):
                    start, number = int(starts[k + window]), int(numbers[item])
                    similarity = self._similarity(features[start : start + m], number)
                    if similarity >= self.similarity - 1e-12 and (number not in best or similarity > best[number][2]):
                        distance = int(_POPCOUNT[(fingerprints[k + window : k + window + 1] ^ prints[item : item + 1]).view(np.uint8)].sum())
                        best[number] = (base + start, n, similarity, distance)

    def _similarity(self, window: np.ndarray, number: int) -> float:
        """Weighted Jaccard similarity of the shingles of a window and an item."""
        kinds, weights = np.unique(window, return_counts=True)
        other, other_weights = self.multisets[number]
        _, a, b = np.intersect1d(kinds, other, assume_unique=True, return_indices=True)
        shared = int(np.minimum(weights[a], other_weights[b]).sum())
        return shared / (len(window) + int(self.sizes[number]) - shared)

    def _longer_items(self, features: np.ndarray, hit: np.ndarray, total: int) -> dict[int, tuple]:
        """Matches of the whole document with items longer than it, by item number."""
        size = len(features)
        # shared <= size, so the similarity is reachable only for items of at most size / similarity shingles
        if total < math.ceil((2 * size + 1) * self.similarity / (1 + self.similarity) - 1e-9):
            return {}
        places = np.searchsorted(self.known, np.unique(features[hit]))
        items = np.unique(np.concatenate([self.posted[self.posts[p] : self.posts[p + 1]] for p in places]))
        items = items[(self.sizes[items] > size) & (self.sizes[items] * self.similarity <= size + 1e-9)]
        found = {}
        for number in items.tolist():
            similarity = self._similarity(features, number)
            if similarity >= self.similarity - 1e-12:
                distance = int(_POPCOUNT[(simhash(_bit_sums(features)[-1:]) ^ self.prints[number : number + 1]).view(np.uint8)].sum())
                found[number] = (0, size + SHINGLE - 1, similarity, distance)
        return found

    def short_matches(self, hashes: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int, float, int]]]:
        """Matches of the items of fewer than five words, by text: the first place of each."""
        found: dict[int, dict] = {}
        for n, (prints, ids) in self.short.items():
            features = shingles(hashes, n)
            at = np.flatnonzero(np.isin(features, prints))
            text = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[np.minimum(text + 1, len(offsets) - 1)]
            at, text = at[inside], text[inside]
            # the first place of each shingle in each text
            _, first = np.unique(np.stack([text.astype(np.uint64), features[at]]), axis=1, return_index=True)
            for place, k in zip(at[first].tolist(), text[first].tolist(), strict=True):
                for i in range(np.searchsorted(prints, features[place]), np.searchsorted(prints, features[place], "right")):
                    found.setdefault(k, {})[n, i] = (ids[i], place - int(offsets[k]), n, 1.0, 0)
        return {k: list(v.values()) for k, v in found.items()}

    def _candidates(self, fingerprints: np.ndarray, prints: np.ndarray, tables: list) -> np.ndarray:
        """(window, item) pairs whose fingerprints are within the radius, found through the blocks."""
        values = fingerprints.view(np.uint8).reshape(-1, BLOCKS)
        found = []
        for b, (offsets, items) in enumerate(tables):
            low, size = offsets[values[:, b]], offsets[values[:, b].astype(int) + 1] - offsets[values[:, b]]
            window = np.repeat(np.arange(len(values)), size)
            at = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            found.append(window * len(prints) + items[at])
        pairs = np.unique(np.concatenate(found))
        window, item = pairs // len(prints), pairs % len(prints)
        distance = _POPCOUNT[(fingerprints[window] ^ prints[item]).view(np.uint8).reshape(-1, 8)].sum(axis=1)
        near = distance <= self.radius
        return np.stack([window[near], item[near]], axis=1)


def _indexes(benchmark: DataFrame, text: str, item_id: str, similarity: float, radius: int, chunk_bytes: int) -> Iterator:
    """Broadcast indexes that together hold the whole benchmark, each of bounded text."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    for c in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c)
        rows = sorted({(r.item_id is None, r.item_id, r.text) for r in part.collect()}, key=lambda r: (r[0], r[1] or 0, r[2]))
        yield benchmark.sparkSession.sparkContext.broadcast(BenchmarkIndex([r[1:] for r in rows], similarity, radius))


def _scan(index: BenchmarkIndex, texts: list[str]) -> Iterator[list]:
    """Matches of each text."""
    hashes, offsets = words(texts)
    features = shingles(hashes)
    hit = index.known_positions(features) if len(features) else np.zeros(0, bool)
    short = index.short_matches(hashes, offsets)
    for k in range(len(texts)):
        a, b = int(offsets[k]), int(offsets[k + 1]) - SHINGLE + 1
        yield short.get(k, []) + (index.matches(features[a:b], hit[a:b]) if b > a and hit[a:b].any() else [])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, start_word, n_words, similarity, hamming.

    The row tells the most similar window, the first of equals; a document shorter than the item is one window. Items of
    fewer than five words match where their words stand in order. Null texts and texts without words match nothing.
    Repeated documents give repeated rows, repeated items count once. Extra columns are ignored; an empty table on either
    side gives no rows. A very long text is looked at piece by piece.
    """
    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, start_word long, n_words long, similarity double, hamming int"
    out = None
    for shared in _indexes(benchmark, text, item_id, similarity, radius, chunk_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(_scan(index, strings(part, "text")))
                    owner = [k for k, f in enumerate(found) for _ in f]
                    columns = list(zip(*[m for f in found for m in f], strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(owner, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                        ["doc_id", "item_id", "start_word", "n_words", "similarity", "hamming"],
                    )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, text: str = "text", item_id: str = "item_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`docs`, all columns, without the documents in which a benchmark item is found. A filter: no shuffle, no join."""
    for shared in _indexes(benchmark, text, item_id, similarity, radius, chunk_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    yield part.filter(pa.array([not m for m in _scan(shared.value, strings(part, text))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
