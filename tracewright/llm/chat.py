"""Chat formatting after cumulative-snapshot collapse, in DataFrame and SQL functions only.

A log may hold the same conversation several times, each snapshot longer than the one before. Rolling hashes of every
turn prefix are compared with whole-conversation hashes; an anti-join keeps only conversations that are no proper
prefix of another and, of equal ones, the smallest id. The kept ones are rendered in bounded segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Turns in a block of the running hashes: no task sorts more of one conversation than this.
BLOCK = 256
#: Turns in a rendered segment.
SEGMENT = 512


def _running(rows: DataFrame, totals: dict[str, tuple]) -> DataFrame:
    """Adds running totals over each conversation in (turn, h) order, two-level so that no conversation is one task.

    totals: name -> (aggregate of a column, column, combine of two partial values, neutral value).
    """
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "h1", "h2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(*[agg(col).alias(f"_{name}") for name, (agg, col, _, _) in totals.items()])
    blocks = blocks.select("conv_id", "block", *[F.coalesce(agg(f"_{name}").over(before), F.lit(zero)).alias(f"_{name}") for name, (agg, _, _, zero) in totals.items()])
    inner = rows.select("*", *[agg(col).over(within).alias(name) for name, (agg, col, _, _) in totals.items()])
    joined = inner.join(blocks, ["conv_id", "block"])
    return joined.select(*[c for c in rows.columns], *[combine(F.col(f"_{name}"), F.col(name)).alias(name) for name, (_, _, combine, _) in totals.items()])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, h1, h2, pos (1-based), p1, p2: a 128-bit hash of the first `pos` turns, order included.

    Turns go by their number; exact repeats of a turn count once, different turns of one number go by content hash.
    Rows without conv_id or turn belong to no conversation and are left out. Null role or text reads as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keyed = (
        conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .select("conv_id", "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), text, role).alias("h2"))
        .distinct()
        .withColumn("block", F.floor(F.col("turn") / BLOCK))
    )
    placed = _running(keyed.withColumn("one", F.lit(1)), {"pos": (F.sum, "one", lambda a, b: a + b, 0)})
    placed = placed.withColumn("e1", F.xxhash64("pos", "h1", "h2")).withColumn("e2", F.xxhash64("h2", "pos", "h1", F.lit(11)))
    rolled = _running(placed, {"p1": (F.bit_xor, "e1", _xor, 0), "p2": (F.bit_xor, "e2", _xor, 0)})
    return rolled.select("conv_id", "turn", "h1", "h2", F.col("pos").cast("long").alias("pos"), "p1", "p2")


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: conversations that no longer one begins with; of equal ones the smallest id stays."""
    # written, so that the join below has plain tables on both sides and a very long conversation can be split
    whole = materialize(prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("w")).select("conv_id", F.col("w.pos").alias("n_turns"), "w.p1", "w.p2"))
    kinds = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    # a prefix is proper where its conversation goes on; hot prefixes are one row each after this
    proper = (
        prefixes.join(whole.select("conv_id", "n_turns"), "conv_id")
        .where(F.col("pos") < F.col("n_turns"))
        .select(F.col("pos").alias("n_turns"), "p1", "p2")
        .distinct()
    )
    return kinds.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "copies")


def render(conversations: DataFrame, prefixes: DataFrame, kept: DataFrame, template: str = "<|{role}|>\n{text}\n", segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment, n_turns, copies, text: the kept conversations in turn order, `segment` turns to a row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts, rest = [], template
    while rest:
        at = min((i for i in (rest.find("{role}"), rest.find("{text}")) if i >= 0), default=len(rest))
        if at:
            parts.append(F.lit(rest[:at]))
        if rest[at:]:
            parts.append(role if rest[at : at + 6] == "{role}" else text)
        rest = rest[at + 6 :]
    turns = conversations.select("conv_id", "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), text, role).alias("h2"), F.concat(*parts).alias("shown"))
    places = prefixes.join(kept, "conv_id").select("conv_id", "turn", "h1", "h2", "pos", "n_turns", "copies", F.floor((F.col("pos") - 1) / segment).alias("segment"))
    one_each = turns.groupBy("conv_id", "turn", "h1", "h2").agg(F.first("shown").alias("shown"))
    return (
        places.join(one_each, ["conv_id", "turn", "h1", "h2"])
        .groupBy("conv_id", "segment", "n_turns", "copies")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), "").alias("text"))
        .select("conv_id", "segment", "n_turns", "copies", "text")
    )


def format_chats(conversations: DataFrame, template: str = "<|{role}|>\n{text}\n") -> DataFrame:
    """Collapse snapshots and render what stays; see the functions above for nulls, ties and repeats.

    An empty table gives no rows; columns besides conv_id, turn, role and text are ignored.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    prefixes = materialize(turn_prefixes(conversations))
    return render(conversations, prefixes, materialize(maximal_conversations(prefixes)), template)
