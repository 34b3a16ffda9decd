"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length per source (an aggregate of bounded width), a bounded-knapsack dynamic
programme chooses how many documents of each length fill the source's remaining budget, and seeded documents are then
selected by length count. Only counts reach a single task; documents never do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A maximal run of anything but ASCII white space is one token.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Cells of the knapsack table; what is above it is filled length by length beforehand.
DP_CELLS = 1 << 17
#: Range buckets of the seeded order within a length: at least so many, and so many that a bucket holds about BUCKET_ROWS
#: rows at most, even if all documents had one length. The result does not depend on their number.
BUCKETS, BUCKET_ROWS = 64, 1 << 18
#: No document is used more often than this.
MAX_REPEATS = 3


def token_count(text: Column) -> Column:
    """Tokens of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> plus target: water-filling of the total by weight under `cap` x source_size.

    Sources in code-point order, null last, take the weights in turn. With the sources sorted by size / weight, those
    that stop at their cap are a prefix; each row tests whether it and its predecessors stop. One row per source.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("rank"))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    # the level that holds if exactly the rows before this one stop at their caps
    level = (F.col("total") - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    )
    rows = (
        sizes.withColumn("rank", F.row_number().over(ordered) - 1)
        .withColumn("weight", turn)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("stops", F.col("weight") * F.col("level") > cap * F.col("source_size"))
    )
    # the first row that does not stop fixes the level of all later ones
    fixed = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(everything)
    return rows.withColumn("fixed", fixed["level"]).select(
        "source",
        "source_size",
        F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(F.col("weight") * F.col("fixed"), F.lit(float("inf")))).alias("target"),
    )


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, cells: int = DP_CELLS) -> np.ndarray:
    """How many items of each length to take so that their total is as near below `budget` as the programme can.

    Where the budget exceeds the table, a proportional share of every length is taken first, then whole long lengths
    from the longest down while the rest is still larger than the table; the table then fits the remainder exactly.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    taken = np.zeros_like(counts)
    total = int((lengths * counts).sum())
    budget = min(int(budget), total)
    if budget <= 0 or total == 0:
        return taken
    if budget > cells:
        taken = np.minimum(counts, np.floor(counts * ((budget - cells // 2) / total)).astype(np.int64))
        rest = budget - int((taken * lengths).sum())
        for k in np.argsort(-lengths, kind="stable"):
            if rest <= cells:
                break
            if lengths[k] > 0:
                more = min(int(counts[k] - taken[k]), (rest - cells // 2) // int(lengths[k]))
                if more > 0:
                    taken[k] += more
                    rest -= more * int(lengths[k])
    else:
        rest = budget
    left = counts - taken
    return taken + _knapsack(lengths, left, rest)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: best reachable total <= budget, items by binary splitting, one layer index per cell."""
    budget = int(min(budget, (lengths * counts).sum()))
    chosen = np.zeros_like(counts)
    if budget <= 0:
        return chosen
    first = np.full(budget + 1, -1, np.int32)  # the part that first reached a total
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    parts: list[tuple[int, int, int]] = []
    for k in np.argsort(-lengths, kind="stable"):
        length, left = int(lengths[k]), int(counts[k])
        if length <= 0 or length > budget:
            continue
        left, piece = min(left, budget // length), 1
        while left > 0 and not reached[budget]:
            use = min(piece, left)
            step = use * length
            fresh = np.zeros_like(reached)
            fresh[step:] = reached[:-step]
            fresh &= ~reached
            first[fresh] = len(parts)
            reached |= fresh
            parts.append((int(k), use, step))
            left -= use
            piece *= 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, use, step = parts[first[at]]
        chosen[k] += use
        at -= step
    return chosen


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = MAX_REPEATS,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    A source's taken words are whole passes over it plus a fitted rest. Of the rest, what exceeds the programme's table
    (DP_CELLS words) is first taken as the same share of every length, rounded down, and from the longest lengths; the
    programme then fits the last 65,536 to 131,072 words as near below the target as the remaining documents allow. What
    it leaves is the least gap that subsets of these documents can leave: 0 wherever short documents remain.

    Null or blank text has size 0 and is never taken; a null source is a source of its own, last in the order. An empty
    table gives no rows. Repeated ids are separate documents. Other columns of `docs` are ignored. Equal sizes are told
    apart by the seeded hash of the id, so reruns agree.
    """
    seeded = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), token_count(F.col(text)).alias("size")).withColumn("_order", seeded)
    rows = materialize(rows)  # narrow: texts are read and split once
    buckets = max(BUCKETS, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.least(F.floor((F.col("_order") / 2.0**63 + 1) * (buckets / 2)).cast("int"), F.lit(buckets - 1)))
    cells = rows.groupBy("source", "size", "_bucket").agg(F.count("*").alias("n"))
    per_length = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = per_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, cap)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's length histogram: whole passes over the source, then the fitted remainder."""
        pdf = pdf.sort_values("size")
        whole, target = int(pdf["source_size"].iloc[0]), int(round(float(pdf["target"].iloc[0])))
        passes = min(cap, target // whole) if whole else 0
        extra = np.zeros(len(pdf), np.int64)
        if whole and passes < cap:
            extra = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), target - passes * whole)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "source_size": pdf["source_size"], "target": pdf["target"], "passes": passes, "extra": extra})

    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    plan = (
        per_length.alias("a")
        .join(targets.alias("b"), same)
        .select("a.source", "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(fit, "source string, size long, source_size long, target double, passes long, extra long")
    )
    # documents of a length that lie in earlier buckets of the seeded order
    earlier = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    quota = (
        offsets.alias("a")
        .join(plan.alias("b"), same & (F.col("a.size") == F.col("b.size")))
        .select("a.source", "a.size", "a._bucket", "before", "source_size", "target", "passes", "extra")
    )
    within = Window.partitionBy("source", "size", "_bucket").orderBy("_order", "doc_id")
    ranked = rows.withColumn("_nth", F.row_number().over(within))
    copies = F.when(F.col("a.size") == 0, F.lit(0)).otherwise(F.col("passes") + (F.col("before") + F.col("_nth") <= F.col("extra")).cast("long"))
    return (
        ranked.alias("a")
        .join(quota.alias("b"), same & (F.col("a.size") == F.col("b.size")) & (F.col("a._bucket") == F.col("b._bucket")))
        .select("a.doc_id", "a.source", "a.size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
