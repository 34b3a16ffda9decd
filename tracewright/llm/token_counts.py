"""Token counts of a public byte-level BPE vocabulary by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbol ids. In every round each sequence finds its
lowest-rank adjacent pair and all its occurrences are merged at once, left to right; rounds go on until no sequence has
a pair with a rank. The symbols left over are the tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ._text import slices, strings

#: Pre-token counts kept by a worker; the table is emptied when full, which changes speed and never counts.
CACHE_ENTRIES = 150_000
#: The word split of the byte-level vocabulary, white space spelled out as Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


class RankMerger:
    """Vocabulary tables and the merging rounds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        keys = (left << 20) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters, spare = {b: chr(b) for b in shown}, 0
        for b in range(256):
            if b not in letters:
                letters[b], spare = chr(256 + spare), spare + 1
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.split = regex.compile(_SPLIT)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of ranks stands for none."""
        keys = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        result = lengths.copy()
        owner = np.repeat(np.arange(len(pieces)), lengths)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        none = len(self.keys)
        while len(symbols) > 1:
            joined = owner[:-1] == owner[1:]
            ranks = np.where(joined, self.pair_ranks(symbols[:-1], symbols[1:]), none)
            starts = np.flatnonzero(np.r_[True, ~joined])
            lowest = np.minimum.reduceat(np.r_[ranks, none], starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            alive = lowest < none
            if not alive.any():
                break
            mine = np.repeat(lowest, sizes)
            hit = np.r_[ranks == mine[:-1], False] & (mine < none)
            # of overlapping hits (a run of one symbol) every second is merged, from the left
            at = np.flatnonzero(hit)
            run_start = np.r_[True, np.diff(at) != 1]
            first = at[run_start][np.cumsum(run_start) - 1]
            at = at[(at - first) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            keep = np.repeat(alive, sizes)
            keep[at + 1] = False
            # sequences without a ranked pair are done: their count is what they hold now
            result[owner[starts[~alive]]] = sizes[~alive]
            symbols, owner = symbols[keep], owner[keep]
        if len(owner):
            held, sizes = np.unique(owner, return_counts=True)
            result[held] = sizes
        return result

    def text_counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings counting one each."""
        out = []
        split, known = self.split.findall, self.known
        tokens, extra = [], []
        for t in texts:
            parts = self.cut.split(t) if self.cut else [t]
            tokens.append([x for p in parts for x in split(p)] if len(parts) > 1 else split(t))
            extra.append(len(parts) - 1)
        unseen = list({x for ts in tokens for x in ts if x not in known})
        if unseen:
            if len(known) + len(unseen) > CACHE_ENTRIES:
                known.clear()
                unseen = list({x for ts in tokens for x in ts})
            known.update(zip(unseen, self.counts([x.encode("utf-8", "surrogatepass") for x in unseen]).tolist(), strict=True))
        for ts, more in zip(tokens, extra, strict=True):
            out.append(sum(map(known.__getitem__, ts)) + more)
        return out


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    `vocabulary` is the path of a byte-level BPE .json file that every executor can open. Null text counts as empty: 0
    bytes, 0 tokens. Repeated rows give repeated rows; other columns are ignored; whole texts of any length count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = strings(part, "text")
                n_tokens = model.text_counts(texts)
                n_bytes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), n_bytes, pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
