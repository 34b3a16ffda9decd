"""Deterministic identities: normalised logical ids and their 53-bit numbers, as column expressions."""

from __future__ import annotations

import unicodedata
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The prefix every logical id has, and the largest id.
LOGICAL_ID = r"^[a-z][a-z0-9-]*:"
MAX_ID = (1 << 53) - 1


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _quoted(values: pd.Series) -> pd.Series:
    return values.map(lambda v: quote(v, safe="!'()*-._~"), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC; only texts with non-ASCII characters leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(text)).otherwise(text)


def uri_component(text: Column) -> Column:
    """Percent-encoding of a URI component; only texts with other than unreserved characters leave the JVM."""
    return F.when(text.rlike(r"[^A-Za-z0-9!'()*._~-]"), _quoted(text)).otherwise(text)


def valid_logical_id(text: Column) -> Column:
    """A logical id is non-empty, has no surrounding white space and starts with a lower-case scheme."""
    return F.coalesce((F.length(text) > 0) & (text == F.trim(text)) & text.rlike(LOGICAL_ID), F.lit(False))


def numeric_id(logical_id: Column) -> Column:
    """The low 53 bits of the first eight bytes of the SHA-256 of the logical id, as long."""
    low = F.substring(F.sha2(logical_id, 256), 3, 14)
    return F.conv(low, 16, 10).cast("long").bitwiseAND(F.lit(MAX_ID))


def edge_logical_id(kind: Column, source: Column, target: Column, discriminator: Column | None = None) -> Column:
    """Tuple-encoded edge identity, so that no separator inside an id can make two edges one."""
    parts = F.array(F.lit("edge"), kind, source, target, F.lit("default") if discriminator is None else F.coalesce(discriminator, F.lit("default")))
    return F.concat(F.lit("rel:"), F.to_json(parts))


def reverse_edge_logical_id(canonical: Column) -> Column:
    return F.concat(F.lit("rel-derived:"), F.to_json(F.array(F.lit("derived-edge"), F.lit("USED_BY"), canonical)))


def half_up(value: Column, scale: int) -> Column:
    """Rounds halves up at 1 / scale, as the result tables of this engine do."""
    return F.floor(value * scale + 0.5) / scale
