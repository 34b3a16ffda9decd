"""Media columns: texts stored losslessly as 8-bit greyscale PNG, read back and hashed.

The writer lays a payload out in rows of 64 samples and emits the signature and IHDR, IDAT and IEND chunks with their
CRCs. The reader walks the chunks, tests every checksum, inflates, and reverses the row filters with numpy. Features
are the signs of low-frequency cosine-transform coefficients of a 32 x 32 reduction, kept in a binary column.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row; a payload is padded with zero bytes to a positive multiple of this.
WIDTH = 64
#: Side of the reduced image and of the low-frequency block of its transform.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes, width: int = WIDTH) -> bytes:
    return data + bytes(max(width, -(-len(data) // width) * width) - len(data))


def png_encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A payload (a positive multiple of `width` bytes) as greyscale PNG; the cheaper of filters None and Up per image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    kind = 2 if np.abs(up.view(np.int8).astype(np.int16)).sum() < np.abs(rows.view(np.int8).astype(np.int16)).sum() else 0
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = up if kind else rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """Samples (rows x width) of an 8-bit greyscale PNG; a broken signature, chunk, checksum or length raises."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, header, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + size]
        if len(content) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + content):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended or header[2:4] != (8, 0) or header[6]:
        raise ValueError("not a whole 8-bit greyscale PNG without interlacing")
    width, height = header[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("sample count")
    lines = lines.reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Reverse the row filters 0 to 4, a run of rows of one kind at a time."""
    out = np.zeros(lines.shape, np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(kinds)], strict=True):
        kind, run = int(kinds[a]), lines[a:b]
        above = out[a - 1] if a else np.zeros(lines.shape[1], np.uint8)
        if kind == 0:
            out[a:b] = run
        elif kind == 1:
            out[a:b] = np.cumsum(run, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(run, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(a, b):
                prior = out[y - 1].astype(int) if y else np.zeros(lines.shape[1], int)
                line, left, corner = out[y], 0, 0
                for x, value in enumerate(lines[y].tolist()):
                    if kind == 3:
                        guess = (left + int(prior[x])) // 2
                    else:  # nearest of left, above and corner to left + above - corner; that order on ties
                        p = left + int(prior[x]) - corner
                        guess = min((left, int(prior[x]), corner), key=lambda v, p=p: abs(p - v))
                    left, corner = (value + guess) & 255, int(prior[x])
                    line[x] = left
        else:
            raise ValueError(f"row filter {kind}")
    return out


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE)).astype(np.float64)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients (the constant one aside) exceed their median."""
    height, width = samples.shape
    side = samples.reshape(height, SIDE, width // SIDE).mean(axis=2) if width % SIDE == 0 else samples[:, np.arange(SIDE) * width // SIDE].astype(float)
    if height >= SIDE:
        edges = np.arange(SIDE + 1) * height // SIDE
        small = np.add.reduceat(side, edges[:-1], axis=0) / np.diff(edges)[:, None]
    else:
        small = side[np.arange(SIDE) * height // SIDE]
    c = _cosines()
    low = (c @ small @ c.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def encode_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media (binary PNG) per document. Null text is stored as the empty text: one row of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([png_encode(pad(t)) for t in raw], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media plus payload (binary, read back) and feature (8-byte binary). A damaged file fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                images = [png_decode(m) for m in part.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([i.tobytes() for i in images], pa.binary()), pa.array(map(cosine_hash, images), pa.binary())],
                    ["doc_id", "n_bytes", "media", "payload", "feature"],
                )

    rows = stored.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, feature binary")


def media_digest(decoded: DataFrame) -> DataFrame:
    """Lengths and checksums of the stored and the read-back bytes, in SQL functions."""
    return decoded.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )
