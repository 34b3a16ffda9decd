"""Filter interaction audit by wide packed counters.

Which of five filters a document fails is a mask of five bits. A mask maps to one big integer whose fields hold what
becomes of such a document at each of the 600 steps (120 orders of five filters); documents are counted by part, mask and
labels first, the integers are added up as often, and the sums are unpacked into rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._bytes import BLANK, pieces
from ._text import slices

FILTERS = "ABCDE"
#: All orders of the filters.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
#: Counters of a step, in the order of the packed fields.
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Bytes of a field. A field is at most 120 times the number of documents, so 2^56 documents cannot carry into the next.
FIELD_BYTES = 8
#: The bit of filter E, the only one that needs other documents.
COPY = 1 << FILTERS.index("E")

_UPPER = bytes(range(0x41, 0x5B))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def text_mask(data: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    n_words, distinct = 0, set()
    for piece in pieces(data, BLANK):
        words = piece.split()  # of bytes: at \x20 and \x09-\x0D only
        n_words += len(words)
        distinct.update(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    points = len(data.translate(None, _CONTINUED))
    fails = (n_words < 50, 100 * len(distinct) < 65 * n_words, 100 * upper > 5 * points, any(m in data for m in _MARKS))
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").to_pylist()
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            masks = pa.array([text_mask(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), digests, masks], ["doc_id", "part", "digest", "mask"])


@lru_cache(maxsize=256)
def packed(mask: int, good: bool, toxic: bool) -> int:
    """The outcomes of one document with this mask at all steps, one field each."""
    fields = np.zeros((len(COUNTERS), STEPS), f"<u{FIELD_BYTES}")
    failed = {f for k, f in enumerate(FILTERS) if mask >> k & 1}
    for i, order in enumerate(ORDERS):
        gone = False
        for j, name in enumerate(order):
            removed = name in failed and not gone
            redundant = name in failed and gone
            gone = gone or removed
            shapley = len(ORDERS) // len(failed) if name in failed else 0  # first of its mask in so many orders
            fields[:, i * len(FILTERS) + j] = (not gone, removed, redundant, failed == {name}, removed and good, removed and toxic, shapley)
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counters by step of a sum of packed integers."""
    return np.frombuffer(total.to_bytes(len(COUNTERS) * STEPS * FIELD_BYTES, "little"), f"<i{FIELD_BYTES}").reshape(len(COUNTERS), STEPS)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = pa.array([o for o in ORDERS for _ in FILTERS], pa.string())
    steps = pa.array([k + 1 for _ in ORDERS for k in range(len(FILTERS))], pa.int32())
    names = ["part", "filter_order", "step", *COUNTERS]
    for batch in batches:
        for part, kinds in zip(batch.column("part").to_pylist(), batch.column("kinds").to_pylist(), strict=True):
            total = sum(k["n"] * packed(k["mask"], k["good"], k["toxic"]) for k in kinds)
            yield pa.RecordBatch.from_arrays([pa.array([part] * STEPS, pa.string()), orders, steps, *map(pa.array, unpacked(total))], names)


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """part, mask, good, toxic, n: documents of every part by what they fail and how they are labelled.

    A document fails E if a smaller doc_id has the same text, wherever it stands; a null doc_id is neither smaller nor
    larger than any other, and rows that repeat a doc_id with its text stand and fall together. Several labels of a
    doc_id are joined by or. Copies are counted by text and part before anything is joined, so a text with very many
    copies is a few rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    facts = materialize(rows.mapInArrow(_facts, f"doc_id {kind}, part string, digest binary, mask int").groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("c")))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    labelled = facts.where("doc_id IS NOT NULL").join(said, "doc_id", "left").fillna(False, ["good", "toxic"])
    nameless = facts.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    flags = ["part", "mask", "good", "toxic"]
    kinds = labelled.groupBy("digest", *flags).agg(F.sum("c").alias("n"), F.min("doc_id").alias("first"), F.min_by("c", "doc_id").alias("n_first"))
    least = labelled.groupBy("digest").agg(F.min("doc_id").alias("least"))
    spared = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = kinds.join(least, "digest").select("part", "good", "toxic", F.explode(F.array(F.struct("mask", spared.alias("n")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (F.col("n") - spared).alias("n")))).alias("kind"))
    counted = split.select("part", "kind.mask", "good", "toxic", "kind.n").where("n > 0")
    return counted.unionByName(nameless.select(*flags, F.col("c").alias("n"))).groupBy(*flags).agg(F.sum("n").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step and the counters of every step of every order of the five filters.

    Filters (a document fails them): A under 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code
    points; D holds any of #$%&*|; E equal to a text of a smaller doc_id. `kept` documents are left after the step,
    `removed` go at it, `redundant` fail its filter but went before, `unique_fails` fail no other, `good_lost` and
    `toxic_lost` are removed with that label, `shapley` is what the step's filter removes summed over all orders. A part
    is a source, null reads as ''; every part has all 600 rows. Null text is empty; an empty table gives no row; other
    columns are ignored.
    """
    parts = mask_counts(docs, labels, **columns).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("kinds"))  # at most 128 a part
    return parts.mapInArrow(_audit, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTERS))
