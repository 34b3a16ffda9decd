"""Token-ID files in directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level k the k-th chunk of those
ids that have one; a bitmap a level says which ids go on, a rank directory counts its bits by block. Any id is read by one
rank a level, nothing else is decoded. A file is a table of segments (shard, segment, directory of documents, code), so
Spark's own commit makes it whole whatever executors are lost.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import BLANK, pieces
from ._text import slices

#: Ids of a segment.
SEGMENT = 1 << 18
#: Bits of a rank directory's block.
RANK_BITS = 512
#: Words whose ids a worker keeps; the table is emptied when full, which changes speed and never ids.
CACHE_WORDS = 600_000
#: Unseen words that the library gets as one text.
_JOINED = 1000

_MAGIC = b"DAC1"
_ONES = 0xFFFFFFFF
#: The reflected CRC-32 polynomial.
_POLYNOMIAL = 0xEDB88320


def encode_dac(ids: np.ndarray) -> bytes:
    """Ids below 2^32 as one code: magic, number of levels, chunks a level, then of each level chunks, bitmap, directory."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> np.uint32(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append((len(chunks), chunks.tobytes(), bits.tobytes(), directory.tobytes()))
        if not more.any():
            break
        rest = rest[more]
    head = _MAGIC + struct.pack(f"<I{len(levels)}Q", len(levels), *(n for n, *_ in levels))
    return head + b"".join(part for _, *parts in levels for part in parts)


class DacReader:
    """Random access to a code: `reader[i]` walks the levels by rank, `reader.read(low, high)` a range."""

    def __init__(self, code: bytes):
        if code[:4] != _MAGIC:
            raise ValueError("not a token code")
        (n_levels,) = struct.unpack_from("<I", code, 4)
        sizes = struct.unpack_from(f"<{n_levels}Q", code, 8)
        at, self.levels = 8 + 8 * n_levels, []
        for n in sizes:
            blocks = -(-n // RANK_BITS) + 1
            arrays = []
            for kind, count in (("u1", n), ("u1", -(-n // 8)), ("<u4", blocks)):
                arrays.append(np.frombuffer(code, kind, count, at))
                at += arrays[-1].nbytes
            self.levels.append(arrays)
        if at != len(code):
            raise ValueError("token code of a wrong length")
        self.size = sizes[0]

    def __len__(self) -> int:
        return self.size

    def _rank(self, level: int, i: int) -> int:
        """Set bits of a level before position i."""
        _, bits, directory = self.levels[level]
        block = i // RANK_BITS
        low = block * RANK_BITS // 8
        inside = int.from_bytes(bits[low : i // 8 + 1].tobytes(), "little") & ((1 << i - block * RANK_BITS) - 1)
        return int(directory[block]) + inside.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def read(self, low: int, high: int) -> np.ndarray:
        """Ids low to high; a range is a range on every level."""
        out = np.zeros(high - low, np.uint32)
        held = np.arange(high - low)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if high <= low:
                break
            out[held] |= chunks[low:high].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[low // 8 : -(-high // 8)], bitorder="little")[low % 8 :][: high - low].astype(bool)
            held = held[more]
            low = self._rank(level, low)
            high = low + len(held)
        return out


#: The letters of ASCII and Latin-1, which normalise to letters and to themselves alone.
_LATIN = rb"[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: Punctuation at a word's end, after such a letter or an ASCII digit. The vocabulary's split always parts the two; the
#: marks of contractions and special strings are not among it.
_MARK = rb"[!-&(-;=?-@\[-`{}~]"
_TAIL = re.compile(_MARK + rb"(?:(?<=[A-Za-z0-9]" + _MARK + rb")|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]" + _MARK + rb"))" + _MARK + rb"*(?=[\x20\x09-\x0D]|\Z)")
#: Words that the vocabulary's split leaves whole.
_LETTERS = re.compile(rb"(?:" + _LATIN + rb")+")


class _Numbers(dict):
    """Word -> number; an unseen word gets the next one and is noted."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordEncoder:
    """The library's ids of texts, word by word.

    The vocabulary's normaliser and split never join characters across ASCII white space, and its special strings hold
    none, so a text's ids are those of its words in order; a word that was seen before is looked up. Words of letters
    alone go to the library many at once: the end-of-word mark of its pieces tells them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        mark = model["end_of_word_suffix"]
        self.closes = np.zeros(1 + max(model["vocab"].values()), bool)
        self.closes[[i for piece, i in model["vocab"].items() if piece.endswith(mark)]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """The ids of the words noted since the last time."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        plain = [k for k, w in enumerate(fresh) if _LETTERS.fullmatch(w)]
        rest = sorted(set(range(len(fresh))) - set(plain))
        found: list[np.ndarray] = [None] * len(fresh)
        groups = [plain[low : low + _JOINED] for low in range(0, len(plain), _JOINED)]
        asked = [b" ".join(fresh[k] for k in g).decode() for g in groups] + [fresh[k].decode("utf-8", "replace") for k in rest]
        answers = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(asked, add_special_tokens=False)]
        for group, ids in zip(groups, answers, strict=False):
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group):
                raise ValueError("the vocabulary does not end every word with its mark")
            for k, piece in zip(group, np.split(ids, ends[:-1]), strict=True):
                found[k] = piece
        for k, ids in zip(rest, answers[len(groups) :], strict=True):
            found[k] = ids
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in found])])
        self.ids = np.concatenate([self.ids, *found])

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts; works through long ones piece by piece."""
        if len(self.numbers) > CACHE_WORDS:
            self._forget()
        placed = []
        for text in texts:
            for piece in pieces(text, BLANK):
                words = _TAIL.sub(rb" \g<0>", piece).split()
                placed.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
            placed.append(None)
        if self.numbers.fresh:
            self._learn()
        out, parts = [], []
        for at in placed:
            if at is None:
                out.append(np.concatenate(parts) if len(parts) > 1 else parts[0])
                parts = []
                continue
            sizes = self.starts[at + 1] - self.starts[at]
            first = np.cumsum(sizes) - sizes
            parts.append(self.ids[np.repeat(self.starts[at] - first, sizes) + np.arange(int(sizes.sum()))])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _directory(kind: pa.DataType) -> pa.StructType:
    """A document's entry: its number in the shard, its ids, those before this segment, where they begin here, those here."""
    return pa.struct([("ordinal", pa.int64()), ("doc_id", kind), ("size", pa.int64()), ("before", pa.int64()), ("at", pa.int64()), ("here", pa.int64())])


def _writer(vocabulary: str, end_id: int, segment: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        shard = TaskContext.get().partitionId()
        held: list[np.ndarray] = []  # ids of the open segment
        docs: list[dict] = []
        n_held = n_closed = ordinal = 0
        kind = pa.null()

        def close() -> pa.RecordBatch:
            nonlocal n_held, n_closed
            row = {"shard": pa.array([shard], pa.int32()), "segment": pa.array([n_closed // segment], pa.int64()), "first": pa.array([n_closed], pa.int64()), "n_ids": pa.array([n_held], pa.int64())}
            row |= {"docs": pa.array([docs], pa.list_(_directory(kind))), "code": pa.array([encode_dac(np.concatenate(held))], pa.binary())}
            n_closed, n_held = n_closed + n_held, 0
            held.clear()
            docs.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                for doc_id, found in zip(part.column("doc_id").to_pylist(), words.encode_all(part.column("text").to_pylist()), strict=True):
                    ids = np.append(found, np.uint32(end_id))
                    done = 0
                    while done < len(ids):
                        some = min(len(ids) - done, segment - n_held)
                        held.append(ids[done : done + some])
                        docs.append({"ordinal": ordinal, "doc_id": doc_id, "size": len(ids), "before": done, "at": n_held, "here": some})
                        done, n_held = done + some, n_held + some
                        if n_held == segment:
                            yield close()
                    ordinal += 1
        if n_held:
            yield close()

    return write


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, segment: int = SEGMENT, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of all documents, each closed by `end_id`, in ascending doc_id order to token files at `path`.

    Null text is empty: its ids are the end id alone. A null doc_id comes before all others; rows of one doc_id follow
    each other by the hash of their text, and equal rows are interchangeable. Documents are dealt by range, so no
    machine holds more than a share; a document may run over several segments. Other columns are ignored. An empty table
    gives a file without segments.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), F.asc("_hash"), F.asc("_row")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"shard int, segment long, first long, n_ids long, docs array<struct<ordinal:long,doc_id:{kind},size:long,before:long,at:long,here:long>>, code binary"
    placed.mapInArrow(_writer(vocabulary, end_id, segment), schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments of token files, each with `start`: the ids of all segments before it.

    Only the sizes of shards pass the driver, one number a task of the writer.
    """
    files = spark.read.parquet(path)
    sizes = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = [], 0
    for shard in sorted(sizes):
        starts.append((shard, total))
        total += sizes[shard]
    return files.join(spark.createDataFrame(starts, "shard int, shard_start long"), "shard").withColumn("start", F.col("shard_start") + F.col("first")).drop("shard_start")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC's, reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=64)
def _square(k: int) -> int:
    """x^(8 * 2^k)."""
    return 1 << 23 if k == 0 else _times(_square(k - 1), _square(k - 1))


def crc_after(state: int, n_bytes: int) -> int:
    """The CRC register after `n_bytes` zero bytes."""
    k = 0
    while n_bytes:
        if n_bytes & 1:
            state = _times(_square(k), state)
        n_bytes, k = n_bytes >> 1, k + 1
    return state


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start, n_ids, docs, code in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "n_ids", "docs", "code")), strict=True):
            data = DacReader(code).read(0, n_ids).astype("<u4").tobytes()
            starts, crcs = [], []
            for d in docs:
                piece = data[4 * d["at"] : 4 * (d["at"] + d["here"])]
                if d["here"] == d["size"]:
                    crc = zlib.crc32(piece)
                else:  # a document over several segments: shares that add up by exclusive or
                    crc = crc_after(zlib.crc32(piece, _ONES) ^ _ONES, 4 * (d["size"] - d["before"] - d["here"]))
                    if not d["before"]:
                        crc ^= crc_after(_ONES, 4 * d["size"]) ^ _ONES
                starts.append(None if d["before"] else start + d["at"])
                crcs.append(crc)
            kind = batch.schema.field("docs").type.value_type.field("doc_id").type
            columns = [pa.array([shard] * len(docs), pa.int32()), pa.array([d["ordinal"] for d in docs], pa.int64()), pa.array([d["doc_id"] for d in docs], kind), pa.array(starts, pa.int64()), pa.array([d["size"] for d in docs], pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "ordinal", "doc_id", "start", "n_tokens", "crc"])


def _id_kind(files: DataFrame) -> str:
    return files.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()


def token_digest(files: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids_crc32 (of its ids as little-endian 32-bit words), from the files."""
    parts = files.mapInArrow(_digests, f"shard int, ordinal long, doc_id {_id_kind(files)}, start long, n_tokens long, crc long")
    said = parts.groupBy("shard", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.max("start").alias("start"), F.max("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return said.drop("shard", "ordinal")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.schema.field("wanted").type.value_type.field("doc_id").type
        for code, wanted in zip(batch.column("code").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            reader = DacReader(code)
            columns = [pa.array([w["doc_id"] for w in wanted], kind), pa.array([w["position"] for w in wanted], pa.int64()), pa.array([reader[w["at"]] for w in wanted], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "token"])


def tokens_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, position, token: single ids of documents, read by random access.

    `wanted` has doc_id and position (long, from 0). Positions beyond a document, and null ones, give no row; of a
    repeated doc_id every document answers.
    """
    held = files.select("shard", "segment", F.explode("docs").alias("d")).select("shard", "segment", "d.*")
    found = held.join(wanted.select("doc_id", "position"), "doc_id").where("position >= before AND position < before + here")
    asked = found.groupBy("shard", "segment").agg(F.collect_list(F.struct("doc_id", "position", F.expr("at + position - before").alias("at"))).alias("wanted"))
    codes = files.select("shard", "segment", "code").join(asked, ["shard", "segment"]).select("code", "wanted")
    return codes.mapInArrow(_pick, f"doc_id {_id_kind(files)}, position long, token long")
