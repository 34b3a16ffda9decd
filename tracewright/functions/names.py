"""Package names: validation, comparable forms, look-alike skeletons, deletion variants, edit distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .identity import nfc

#: Longest name in UTF-8 bytes, and the characters that a component may consist of.
MAX_BYTES = 214
COMPONENT = r"^[\p{L}\p{N}\p{M}._~!'()*-]+$"
#: Characters that look like a Latin letter, by letter.
LOOKALIKES = {
    "a": "аɑα",
    "c": "сϲ",
    "e": "3еε",
    "i": "іıι",
    "j": "ј",
    "k": "κ",
    "l": "1ⅼ",
    "m": "м",
    "n": "ո",
    "o": "0оο",
    "p": "рρ",
    "s": "5ѕ",
    "t": "7тτ",
    "u": "υ",
    "v": "ν",
    "x": "хχ",
    "y": "уγ",
}
CONFUSABLE_FROM = "".join(LOOKALIKES.values())
CONFUSABLE_TO = "".join(letter * len(like) for letter, like in LOOKALIKES.items())
#: Edit costs.
TRANSPOSITION, EDIT = 75, 100


def normalized(name: Column) -> Column:
    return F.lower(nfc(name))


def name_error(name: Column, n: Column) -> Column:
    """Why a name (with its normalised form) is invalid, or null.

    One of empty, control-character, too-long, invalid-scope, invalid-basename, invalid-character.
    """
    scoped = n.startswith("@")
    slashes = F.length(n) - F.length(F.replace(n, F.lit("/"), F.lit("")))
    scope, base = F.regexp_extract(n, r"^@([^/]+)/(.*)$", 1), F.when(scoped, F.regexp_extract(n, r"^@[^/]+/(.*)$", 1)).otherwise(n)
    dots = lambda c: c.isin("", ".", "..")
    return (
        F.when(name.isNull() | (F.length(name) == 0), "empty")
        .when(name.rlike(r"[\p{Cc}\p{Cf}]"), "control-character")
        .when(F.octet_length(name) > MAX_BYTES, "too-long")
        .when(scoped & ((slashes != 1) | (F.instr(n, "/") <= 2)), "invalid-scope")
        .when(~scoped & ((slashes > 0) | n.startswith(".")), "invalid-basename")
        .when(scoped & dots(scope), "invalid-scope")
        .when(scoped & ~scope.rlike(COMPONENT), "invalid-character")
        .when(dots(base), "invalid-basename")
        .when(~base.rlike(COMPONENT), "invalid-character")
        .when(F.length(compact(base)) == 0, "invalid-basename")
    )


def scope_of(n: Column) -> Column:
    """Scope of a normalised name, null if none."""
    return F.when(n.startswith("@"), F.regexp_extract(n, r"^@([^/]*)/", 1))


def basename(n: Column) -> Column:
    return F.when(n.startswith("@"), F.regexp_extract(n, r"^@[^/]*/(.*)$", 1)).otherwise(n)


def tokens(component: Column) -> Column:
    """Runs of letters and runs of numbers."""
    return F.regexp_extract_all(component, F.lit(r"\p{L}+|\p{N}+"), F.lit(0))


def compact(base: Column) -> Column:
    """Letters and numbers of a base name."""
    return F.regexp_replace(base, r"[^\p{L}\p{N}]", "")


def skeleton(n: Column) -> Column:
    return F.translate(n, CONFUSABLE_FROM, CONFUSABLE_TO)


def _drop_one(word: Column) -> Column:
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))).otherwise(F.array().cast("array<string>"))


def deletion_variants(word: Column, depth: int = 2) -> Column:
    """The word and what is left of it after up to `depth` deletions, distinct."""
    found = frontier = F.array(word)
    for _ in range(depth):
        frontier = F.array_distinct(F.flatten(F.transform(frontier, _drop_one)))
        found = F.concat(found, frontier)
    return F.array_distinct(found)


def edit_script(source: str, target: str) -> tuple[int, list[str]]:
    """Least cost of restricted Damerau-Levenshtein edits and the kinds of edits from left to right.

    Among equal costs a match goes before a transposition, substitution, deletion and insertion, from the end back.
    """
    a, b = list(source), list(target)
    cost = np.zeros((len(a) + 1, len(b) + 1), int)
    cost[:, 0], cost[0, :] = np.arange(len(a) + 1) * EDIT, np.arange(len(b) + 1) * EDIT

    def moves(i: int, j: int):
        if i and j and a[i - 1] == b[j - 1]:
            yield cost[i - 1, j - 1], "match", 1, 1
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
            yield cost[i - 2, j - 2] + TRANSPOSITION, "adjacent-transposition", 2, 2
        if i and j and a[i - 1] != b[j - 1]:
            yield cost[i - 1, j - 1] + EDIT, "substitution", 1, 1
        if i:
            yield cost[i - 1, j] + EDIT, "deletion", 1, 0
        if j:
            yield cost[i, j - 1] + EDIT, "insertion", 0, 1

    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i, j] = min(m[0] for m in moves(i, j))
    i, j, script = len(a), len(b), []
    while i or j:
        _, kind, di, dj = min(moves(i, j), key=lambda m: m[0])
        script.append(kind)
        i, j = i - di, j - dj
    return int(cost[-1, -1]), script[::-1]


EDITS = StructType([StructField("cost", IntegerType()), StructField("normalized", DoubleType()), StructField("kinds", ArrayType(StringType()))])


@F.pandas_udf(EDITS)
def weighted_distance(source: pd.Series, target: pd.Series) -> pd.DataFrame:
    """cost, cost per longest length, kinds of edits other than matches (for candidate pairs only, never for all pairs)."""
    rows = []
    for a, b in zip(source, target, strict=True):
        total, script = edit_script(a or "", b or "")
        rows.append((total, total / (max(len(a or ""), len(b or ""), 1) * 100), [k for k in script if k != "match"]))
    return pd.DataFrame(rows, columns=["cost", "normalized", "kinds"])
