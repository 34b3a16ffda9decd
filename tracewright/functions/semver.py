"""Semantic versions and ranges, as an Arrow-batched function over distinct (version, range) pairs."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_NUMBER = r"(?:0|[1-9]\d*)"
_TAG = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
_VERSION = re.compile(rf"^[v=\s]*({_NUMBER})\.({_NUMBER})\.({_NUMBER})(?:-({_TAG}(?:\.{_TAG})*))?(?:\+[0-9A-Za-z.-]+)?\s*$", re.ASCII)
_PART = r"(?:x|X|\*|0|[1-9]\d*)"
_PARTIAL = re.compile(rf"^[v=\s]*({_PART})(?:\.({_PART})(?:\.({_PART})(?:-({_TAG}(?:\.{_TAG})*))?(?:\+[0-9A-Za-z.-]+)?)?)?$", re.ASCII)
_COMPARATOR = re.compile(r"^(<=|>=|<|>|=|\^|~>?|)\s*(.*)$")


def parse_version(text: str):
    """(major, minor, patch, prerelease tags or ()) or None."""
    m = _VERSION.match(text.strip())
    if not m or len(text) > 256:
        return None
    tags = tuple(int(t) if t.isdigit() else t for t in m[4].split(".")) if m[4] else ()
    return int(m[1]), int(m[2]), int(m[3]), tags


def order_key(version):
    """Sort key of a version: a release is above its prereleases, numbers are below words."""
    *core, tags = version
    return tuple(core), not tags, tuple((isinstance(t, str), t if isinstance(t, str) else "", t if isinstance(t, int) else 0) for t in tags)


def _bounds(op: str, body: str):
    """A comparator as list of (operator, version), or None if it is invalid."""
    m = _PARTIAL.match(body) if body else None
    if body in ("", "*", "x", "X"):
        return [] if op not in ("<", ">") else [("<", (0, 0, 0, (0,)))]
    if not m:
        return None
    parts = [None if p is None or p in "xX*" else int(p) for p in m.groups()[:3]]
    if parts[0] is None:
        return [] if op not in ("<", ">") else [("<", (0, 0, 0, (0,)))]
    if parts[1] is None:
        parts[2] = None
    known = sum(p is not None for p in parts)
    tags = tuple(int(t) if t.isdigit() else t for t in m[4].split(".")) if m[4] and known == 3 else ()
    low = (*[p or 0 for p in parts], tags)
    major, minor, patch = low[:3]
    above = {1: (major + 1, 0, 0, (0,)), 2: (major, minor + 1, 0, (0,))}
    if op == "^":
        if major or known == 1:
            top = (major + 1, 0, 0, (0,))
        elif minor or known == 2:
            top = (0, minor + 1, 0, (0,))
        else:
            top = (0, 0, patch + 1, (0,))
        return [(">=", low), ("<", top)]
    if op in ("~", "~>"):
        return [(">=", low), ("<", above[1] if known == 1 else (major, minor + 1, 0, (0,)))]
    if known == 3:
        return [(op or "=", low)]
    if op in ("", "="):
        return [(">=", low), ("<", above[known])]
    return {"<": [("<", (*low[:3], (0,)))], ">=": [(">=", low)], ">": [(">=", (*above[known][:3], ()))], "<=": [("<", above[known])]}[op]


@lru_cache(maxsize=20_000)
def parse_range(text: str):
    """Alternatives of comparators, or None if the range is invalid."""
    alternatives = []
    for part in text.split("||"):
        part = part.strip()
        hyphen = re.match(r"^(\S+)\s+-\s+(\S+)$", part)
        if hyphen:
            low, high = _bounds(">=", hyphen[1]), _bounds("<=", hyphen[2])
            if low is None or high is None:
                return None
            alternatives.append(low + high)
            continue
        part = re.sub(r"(<=|>=|<|>|=|\^|~>?)\s+", r"\1", part)
        comparators = []
        for piece in part.split():
            m = _COMPARATOR.match(piece)
            found = _bounds(m[1], m[2])
            if found is None:
                return None
            comparators += found
        alternatives.append(comparators)
    return alternatives


def satisfies(version: str, text: str) -> bool:
    """Is a valid version inside the range? A prerelease counts only beside a comparator of the same numbers with one."""
    parsed, alternatives = parse_version(version), parse_range(text)
    if parsed is None or alternatives is None:
        return False
    key = order_key(parsed)
    tests = {"<": lambda o: key < o, "<=": lambda o: key <= o, ">": lambda o: key > o, ">=": lambda o: key >= o, "=": lambda o: key == o}
    for comparators in alternatives:
        if all(tests[op](order_key(v)) for op, v in comparators):
            if not parsed[3] or any(v[3] and v[:3] == parsed[:3] and v[3] != (0,) for _, v in comparators):
                return True
    return False


@F.pandas_udf(BooleanType())
def in_range(version: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([v is not None and r is not None and satisfies(v, r) for v, r in zip(version, text, strict=True)])


@F.pandas_udf(BooleanType())
def valid_range(text: pd.Series) -> pd.Series:
    return pd.Series([r is not None and parse_range(r) is not None for r in text])
