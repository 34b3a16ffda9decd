"""Cutting long UTF-8 texts into pieces that can be handled one after the other (used inside Spark tasks)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ._text import SLICE_BYTES

#: ASCII white space, which no word of the byte-wise operators holds.
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, gap: re.Pattern, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """`data` cut before the first `gap` at or after every `limit` bytes; nothing between two gaps is ever parted."""
    low = 0
    while len(data) - low > limit:
        at = gap.search(data, low + limit)
        if at is None:
            break
        yield data[low : at.start()]
        low = at.start()
    yield data[low:] if low else data
