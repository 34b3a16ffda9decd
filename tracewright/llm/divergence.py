"""Source divergence audit by in-mapper stripes.

Every task folds whole documents into stripes (term -> number of documents, occurrences by source), spills them when it
holds too many entries, and the spilled stripes of a term are merged in key order. The merged stripes of a language emit
the divergences of its sources directly, block by block of the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._bytes import pieces
from ._text import slices

#: Documents of its language that a term needs to be kept.
MIN_DOCS = 3
#: Ranks of a group's most over-used terms.
TOP_TERMS = 200
#: Stripe entries (term and source) a task holds before it spills them.
SPILL_ENTRIES = 1_000_000
#: Additions of single texts that wait before they are folded into the stripes.
PENDING = 500_000
#: Stripe entries of a block of the vocabulary, about; blocks of a language are compared side by side.
BLOCK_ENTRIES = 50_000
#: Cells (terms times sources) compared at once.
CELLS = 1 << 20
#: Key salts that spread the terms of one language.
SALTS = 64
#: Parts of a probability.
ONE = 1_000_000_000

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_STRIPE = "lang string, term string, docs long, total long, stripe map<string, long>"


class _Numbers(dict):
    """Key -> number, in order of first use."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


class StripeFolder:
    """The stripes of a task: documents by (language, term), occurrences by (language, term, source)."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.terms, self.langs, self.sources = _Numbers(), _Numbers(), _Numbers()
        self.terms[b""]  # number 0: the stripe that names the sources of a language
        self.docs = self.counts = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.new_docs: list = []
        self.new_counts: list = []
        self.waiting = 0

    def add(self, text: bytes, lang: str, source: str) -> None:
        """Fold one document in. `lower` of bytes changes A-Z only."""
        number = self.terms.__getitem__
        found = [np.fromiter(map(number, words), np.int64, len(words)) for words in (_TERM.findall(p) for p in pieces(text.lower(), _GAP))]
        ids, counts = np.unique(np.concatenate([*found, [0]]), return_counts=True)
        counts[0] -= 1  # the empty term is only named
        keys = ids << 16 | self.langs[lang]
        self.new_docs.append((keys, (ids > 0).astype(np.int64)))
        self.new_counts.append((keys << 24 | self.sources[source], counts))
        self.waiting += len(ids)
        if self.waiting >= PENDING:
            self.settle()

    def settle(self) -> None:
        self.docs, self.counts = (_summed(*map(np.concatenate, zip(held, *new, strict=True))) for held, new in ((self.docs, self.new_docs), (self.counts, self.new_counts)))
        self.new_docs, self.new_counts, self.waiting = [], [], 0

    def full(self) -> bool:
        """Are there enough entries to spill? Languages and sources have 16 and 24 bits of a key."""
        return len(self.counts[0]) + self.waiting >= SPILL_ENTRIES or len(self.langs) >= 1 << 16 or len(self.sources) >= 1 << 24

    def spill(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        (keys, docs), (entries, counts) = self.docs, self.counts
        names = [pa.array(list(n), t) for n, t in ((self.terms, pa.binary()), (self.langs, pa.string()), (self.sources, pa.string()))]
        for low in range(0, len(keys), 50_000):
            some = keys[low : low + 50_000]
            first, last = np.searchsorted(entries, [some[0] << 24, (some[-1] + 1) << 24])
            offsets = np.append(np.searchsorted(entries[first:last], some << 24), last - first)
            yield _batch(names[1].take(pa.array(some & 0xFFFF)), names[0].take(pa.array(some >> 16)).cast(pa.string()), docs[low : low + 50_000], offsets, names[2].take(pa.array(entries[first:last] & 0xFFFFFF)), counts[first:last])
        self.clear()


def _batch(lang: pa.Array, term: pa.Array, docs: np.ndarray, offsets: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    totals = np.add.reduceat(counts, offsets[:-1]) if len(docs) else np.zeros(0, np.int64)  # no stripe is empty
    stripe = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), sources, pa.array(counts, pa.int64()))
    return pa.RecordBatch.from_arrays([lang, term, pa.array(docs, pa.int64()), pa.array(totals, pa.int64()), stripe], ["lang", "term", "docs", "total", "stripe"])


def fold_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (text in UTF-8, lang, source) to stripes, folded inside the task; a stripe of the empty term names the sources."""
    folder = StripeFolder()
    for batch in batches:
        for part in slices(batch, "text"):
            for text, lang, source in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                folder.add(text, lang, source)
                if folder.full():
                    yield from folder.spill()
    yield from folder.spill()


def _merger(least: int):
    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of equal (lang, term) that follow each other, as one."""
        lang, term, docs = batch.column("lang"), batch.column("term"), np.asarray(batch.column("docs"))
        stripe = batch.column("stripe")
        offsets = np.asarray(stripe.offsets).astype(np.int64)
        named, counts = stripe.keys.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode(), np.asarray(stripe.items)[offsets[0] : offsets[-1]]
        same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1]))
        group = np.cumsum(np.r_[0, ~np.asarray(same.to_numpy(zero_copy_only=False), bool)])
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        entries, sums = _summed(np.repeat(group, np.diff(offsets)) << 32 | np.asarray(named.indices, np.int64), counts)
        at = pa.array(first)
        return _batch(lang.take(at), term.take(at), np.add.reduceat(docs, first), np.searchsorted(entries, np.arange(len(first) + 1) << 32), named.dictionary.take(pa.array(entries & 0xFFFFFFFF)), sums)

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pc.or_(pc.greater_equal(batch.column("docs"), least), pc.equal(batch.column("term"), "")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stripes in key order to one stripe a key; terms in fewer than `least` documents go."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            whole = merged(batch)
            yield kept(whole.slice(0, whole.num_rows - 1))
            held = whole.slice(whole.num_rows - 1)  # its key may go on in the next batch
        if held is not None:
            yield kept(held)

    return merge


def term_stripes(docs: DataFrame, least: int = MIN_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One stripe a (lang, kept term): docs, total occurrences, and occurrences by source (absent: 0).

    Null text, lang and source read as ''. Of every language one further stripe, of the empty term, holds each of its
    sources with 0. Repeated rows count as documents of their own; other columns are ignored; an empty table gives none.
    """
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    folded = rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(fold_stripes, _STRIPE)
    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merger(least), _STRIPE)


def _shares(counts: np.ndarray, size) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / size), exact whatever the counts."""
    if counts.size and int(counts.max()) >= (1 << 63) // ONE - 1:
        return np.array([1 + ONE * (int(c) + 1) // int(s) for c, s in np.broadcast(counts, size)], np.int64).reshape(np.broadcast(counts, size).shape)
    return 1 + ONE * (counts.astype(np.int64) + 1) // size


def _away(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _block_divergences(terms: list[str], rows: np.ndarray, at: np.ndarray, counts: np.ndarray, sizes: np.ndarray, lang_size: int, top: int):
    """(sum of f of every ordered pair of sources, the best terms of each source) of one block of the vocabulary.

    `rows`, `at` and `counts` are the stripe entries (term, source, occurrences) in term order; `sizes` is N + V by
    source. Most counts of a wide stripe are 0, where a source's share is one constant: only entries are compared, and
    pairs of two zeros are counted.
    """
    n_sources = len(sizes)
    zero = _shares(np.zeros(n_sources, np.int64), sizes)
    pairs = np.zeros((n_sources, n_sources), np.int64)
    best: list[list[tuple[int, str]]] = [[] for _ in range(n_sources)]
    step = max(1, CELLS // n_sources)
    for low in range(0, len(terms), step):
        n_terms = min(step, len(terms) - low)
        first, last = np.searchsorted(rows, [low, low + n_terms])
        table = np.zeros((n_terms, n_sources), np.int64)
        table[rows[first:last] - low, at[first:last]] = counts[first:last]
        p, some = _shares(table, sizes[None, :]), table > 0
        q = _shares(table.sum(1), lang_size)
        both = some.T.astype(np.int64) @ some.astype(np.int64)
        alone = np.diag(both)
        pairs += (n_terms - alone[:, None] - alone[None, :] + both) * _away(zero[:, None], zero[None, :])
        for a in range(n_sources):
            mine = some[:, a]
            if not mine.any():
                continue
            mine_p, other = p[mine, a], p[mine]
            pairs[a] += _away(mine_p[:, None], other).sum(0)
            pairs[a] -= np.where(some[mine], _away(zero[a], other), 0).sum(0)
            pairs[:, a] += _away(zero[:, None], mine_p[None, :]).sum(1)
            more = np.flatnonzero(mine)[mine_p > q[mine]]
            f = _away(p[more, a], q[more])
            if len(f) > top:
                edge = np.partition(f, len(f) - top)[len(f) - top]
                more, f = more[f >= edge], f[f >= edge]
            found = best[a] + [(-int(v), terms[low + k].encode()) for k, v in zip(more, f, strict=True)]
            best[a] = sorted(found)[:top]
    return pairs, best


def _emitter(top: int):
    def emit(stripes: pa.Table, groups: pa.Table) -> pa.Table:
        sources = groups.column("source").to_pylist()
        known = {s: k for k, s in enumerate(sources)}
        lang, n_terms = groups.column("lang")[0].as_py(), groups.column("n_terms")[0].as_py()
        counts_of = np.array(groups.column("n").to_pylist(), np.int64)
        entries = stripes.column("stripe").combine_chunks() if stripes.num_rows else None
        rows = at = counts = np.zeros(0, np.int64)
        if entries is not None:
            if isinstance(entries, pa.ChunkedArray):
                entries = pa.concat_arrays(entries.chunks)
            lengths = np.diff(np.asarray(entries.offsets))
            rows = np.repeat(np.arange(stripes.num_rows), lengths)
            at = np.array([known[s] for s in entries.keys.to_pylist()], np.int64)
            counts = np.asarray(entries.items, np.int64)
        terms = stripes.column("term").to_pylist()
        pairs, best = _block_divergences(terms, rows, at, counts, counts_of + n_terms, int(counts_of.sum()) + n_terms, top)
        out: tuple[list, ...] = ([], [], [], [])
        for a, source in enumerate(sources):
            lines = [("pair", other, int(pairs[a, b])) for b, other in enumerate(sources) if b != a]
            lines += [("term", term.decode(), -value) for value, term in best[a]]
            for part, item, value in lines:
                for column, held in zip(out, (source, part, item, value), strict=True):
                    column.append(held)
        columns = [pa.array([lang] * len(out[0]), pa.string()), *(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], pa.int64())]
        return pa.Table.from_arrays(columns, ["lang", "source", "part", "item", "value"])

    return emit


def source_divergence(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP_TERMS, block_entries: int = BLOCK_ENTRIES, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank: how far every source of a language is from the others and from all of it.

    Kept are the V terms (runs of letters and non-ASCII characters, A-Z lower-cased) in at least `least` documents of
    the language. A group (lang, source) gives a kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)), N its
    occurrences of kept terms; the language gives q the same way. f = floor((p - q)^2 / q). Part `pair`: f summed over
    all kept terms against each other source of the language (0 without kept terms). Part `term`: the `top` terms that
    the group uses and whose p exceeds q. Ranks go by value downwards, then by the UTF-8 of the item; integer arithmetic
    throughout. A language of one source has no pairs; a source without terms has no `term` rows. See `term_stripes` for
    nulls, repeated rows and empty tables. A task holds the distinct terms of one document at a time, not its text.
    """
    stripes = materialize(term_stripes(docs, least, **columns))
    kept = stripes.where("term <> ''")
    groups = stripes.select("lang", F.explode("stripe").alias("source", "count")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    sizes = stripes.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("n_terms"), F.ceil(F.sum(F.when(F.col("term") != "", F.size("stripe")).otherwise(0)) / block_entries).alias("blocks"))
    sizes = materialize(sizes.withColumn("blocks", F.greatest(F.col("blocks"), F.lit(1))))
    salted = sizes.select("lang", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    blocks = (
        kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
        .join(salted, ["lang", "salt"])
        .select("lang", F.pmod(F.xxhash64("term", F.lit(1)), "blocks").alias("block"), "term", "stripe")
    )
    sources = materialize(groups.join(sizes, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "n", "n_terms"))
    found = materialize(blocks.groupBy("lang", "block").cogroup(sources.groupBy("lang", "block")).applyInArrow(_emitter(top), "lang string, source string, part string, item string, value long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
