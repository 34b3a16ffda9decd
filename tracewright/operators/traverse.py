"""Bounded simple-path traversals of many runs side by side, one level per Spark job, and their caps in closed form.

A run is one call of the traversal with bounds of its own: an incident, or a release. Every simple path is a state (path
arrays of node and edge ids). The number of a state within its run follows from counts, so a level is written once, holds
what can still be admitted and nothing else, and no window spans more than a run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


@dataclass(frozen=True)
class Limits:
    """Bounds of one run; every cut is reported as a warning."""

    depth: int = 12
    fan_out: int = 1000
    states: int = 10_000
    ends: int = 100
    paths_per_end: int = 10
    paths: int = 1000
    warnings: int = 100


def bounded_adjacency(edges: DataFrame, at: str, limit: int, order: tuple[str, ...]) -> DataFrame:
    """The first `limit` edges of every node `at` by `order`; the rest is cut (see `cut_nodes`)."""
    return edges.withColumn("_nth", F.row_number().over(Window.partitionBy(at).orderBy(*order))).where(F.col("_nth") <= limit).drop("_nth")


def cut_nodes(edges: DataFrame, at: str, limit: int) -> DataFrame:
    """Nodes that have more edges than `limit`."""
    return edges.groupBy(at).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col(at).alias("node_id"))


def simple_paths(starts: DataFrame, edges: DataFrame, depth: int, here: str, there: str, stop: Column | None = None) -> DataFrame:
    """All simple paths from `starts` (start_id, carried columns) along `edges` from column `here` to column `there`.

    Returns start columns plus cur, depth, node_ids, edge_ids, terminal. `stop` is a condition on edge columns whose
    end is not expanded (terminal). Depth 0 is the start itself. Nothing bounds the number of paths but `depth`.
    """
    adjacency = edges.select(F.col(here).alias("_here"), F.col(there).alias("_there"), F.col("id").alias("_edge"), (F.lit(False) if stop is None else stop).alias("_stop"))
    level = (
        starts.withColumn("cur", F.col("start_id"))
        .withColumn("depth", F.lit(0))
        .withColumn("node_ids", F.array("start_id"))
        .withColumn("edge_ids", F.array().cast("array<bigint>"))
        .withColumn("_stop", F.lit(False))
    )
    level = materialize(level)
    out = level
    for d in range(1, depth + 1):
        step = (
            level.where(~F.col("_stop"))
            .drop("_stop")
            .join(adjacency, F.col("cur") == F.col("_here"))
            .where(~F.array_contains("node_ids", F.col("_there")))
            .select(*starts.columns, F.col("_there").alias("cur"), F.lit(d).alias("depth"), F.concat("node_ids", F.array("_there")).alias("node_ids"), F.concat("edge_ids", F.array("_edge")).alias("edge_ids"), "_stop")
        )
        level = materialize(step)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.withColumnRenamed("_stop", "terminal")


def canonical(edges: DataFrame) -> Column:
    """An edge that a dependency traversal may follow: DEPENDS_ON and not derived, where the edges tell."""
    kind = F.col("kind") == "DEPENDS_ON" if "kind" in edges.columns else F.lit(True)
    return kind & (~F.col("derived") if "derived" in edges.columns else F.lit(True))


def hop_page(edges: DataFrame, here: str, there: str, fan_out: int, follow: Column | None = None, stop: Column | None = None) -> DataFrame:
    """The hops of every node within the fan-out bound, in order, written once: cur, there, edge, hop (from 1), canonical, stop, kind."""
    return materialize(_page(edges, here, there, fan_out, follow, stop))


def _page(edges: DataFrame, here: str, there: str, fan_out: int, follow: Column | None, stop: Column | None) -> DataFrame:
    page = edges.withColumn("_hop", F.row_number().over(Window.partitionBy(here).orderBy("id", there))).where(F.col("_hop") <= fan_out)
    kind = F.col("kind") if "kind" in edges.columns else F.lit(None).cast("string")
    true, false = F.lit(True), F.lit(False)
    return page.select(F.col(here).alias("cur"), F.col(there).alias("there"), F.col("id").alias("edge"), F.col("_hop").alias("hop"), (true if follow is None else follow).alias("canonical"), (false if stop is None else stop).alias("stop"), kind.alias("kind"))


@dataclass(frozen=True)
class Hops:
    """The hops of the nodes that a walk meets, looked up when it meets them: its states are bounded, so that the table of
    edges is scanned for a few nodes and never dealt anew. `left` takes hops out after the fan-out page is cut, node by node."""

    edges: DataFrame
    here: str
    there: str
    fan_out: int
    follow: Column | None = None
    stop: Column | None = None
    left: Callable[[DataFrame], DataFrame] | None = None

    def near(self, nodes: DataFrame) -> DataFrame:
        """The edges of the nodes (cur)."""
        own = self.edges.join(nodes.select(F.col("cur").alias(self.here)), self.here, "left_semi")
        return own if self.left is None else self.left(bounded_adjacency(own, self.here, self.fan_out, ("id", self.there)))

    def of(self, nodes: DataFrame) -> DataFrame:
        """As `hop_page`, of the nodes (cur) alone and not written."""
        return _page(self.near(nodes), self.here, self.there, self.fan_out, self.follow, self.stop)


def _nodes(states: DataFrame) -> DataFrame:
    """The nodes of states; written, so that their number is known where they are joined."""
    return materialize(states.select("cur").distinct())


def admitted_states(starts: DataFrame, page: DataFrame | Hops, limits: Limits) -> DataFrame:
    """The first `limits.states` + 1 states of every run, numbered by `ord` in the order (start, depth, edge ids).

    starts: run, start_id. Returns run, start_id, cur, depth, node_ids, edge_ids, last_kind, terminal, ord, parent (the
    number of the state it comes from) and hop (of that state). Children of a level are counted before they are made: of
    a start only as many as its run has room for, given all states of smaller starts up to this level and of its own
    smaller depths, so that a level has no more states than the bound. A start that is given twice in a run counts once; a null start is left out. Hops are looked up for the nodes of a level.
    """
    of = page.of if isinstance(page, Hops) else lambda nodes: page.join(nodes, "cur", "left_semi")
    over = limits.states + 1
    follow = F.struct(F.col("hop"), F.col("there"), F.col("edge"), F.col("kind"), F.col("stop"))
    by_start = Window.partitionBy("run").orderBy("start_id")
    level = materialize(
        starts.where(F.col("start_id").isNotNull())
        .select("run", "start_id")
        .distinct()
        .withColumn("_n", F.row_number().over(by_start))
        .where(F.col("_n") <= over)
        .select("run", "start_id", F.col("start_id").alias("cur"), F.lit(0).alias("depth"), F.array("start_id").alias("node_ids"), F.array().cast("array<bigint>").alias("edge_ids"), F.lit(None).cast("string").alias("last_kind"), F.lit(False).alias("terminal"), F.lit(1).cast("long").alias("k"), F.lit(None).cast("long").alias("parent_k"), F.lit(0).alias("hop"))
    )
    levels = level
    running = by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for d in range(1, limits.depth + 1):
        room = levels.groupBy("run", "start_id").agg(F.count("*").alias("n")).select("run", "start_id", (F.lit(over) - F.sum("n").over(running)).alias("room")).where("room > 0")
        ahead = materialize(level.where(~F.col("terminal")).join(room, ["run", "start_id"]))
        hops = of(_nodes(ahead)).where("canonical").groupBy("cur").agg(F.array_sort(F.collect_list(follow)).alias("hops"))  # at most the fan-out bound
        earlier = Window.partitionBy("run", "start_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        in_run = Window.partitionBy("run").orderBy("start_id", "k").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.filter("hops", lambda h: ~F.array_contains("node_ids", h["there"]))
        step = (
            ahead.join(hops, "cur")
            .withColumn("hops", fresh)
            .withColumn("_taken", F.coalesce(F.sum(F.size("hops")).over(in_run), F.lit(0)))
            .withColumn("_before", F.coalesce(F.sum(F.size("hops")).over(earlier), F.lit(0)))
            .where(F.col("_taken") < F.col("room"))
            .select("run", "start_id", "node_ids", "edge_ids", "k", "_before", F.posexplode(F.slice("hops", F.lit(1), F.least(F.size("hops"), F.col("room") - F.col("_taken")).cast("int"))).alias("_at", "h"))
        )
        level = materialize(
            step.select(
                "run", "start_id", F.col("h.there").alias("cur"), F.lit(d).alias("depth"), F.concat("node_ids", F.array("h.there")).alias("node_ids"), F.concat("edge_ids", F.array("h.edge")).alias("edge_ids"),
                F.col("h.kind").alias("last_kind"), F.col("h.stop").alias("terminal"), (F.col("_before") + F.col("_at") + 1).alias("k"), F.col("k").alias("parent_k"), F.col("h.hop").alias("hop"),
            )
        )
        if level.isEmpty():
            break
        levels = levels.unionByName(level)
    in_order = Window.partitionBy("run").orderBy("start_id", "depth").rowsBetween(Window.unboundedPreceding, -1)
    base = levels.groupBy("run", "start_id", "depth").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
    base = materialize(base.withColumn("above", F.lag("base").over(Window.partitionBy("run", "start_id").orderBy("depth"))).drop("n"))
    numbered = levels.join(base, ["run", "start_id", "depth"]).withColumns({"ord": F.col("base") + F.col("k"), "parent": F.col("above") + F.col("parent_k")})
    return materialize(numbered.where(F.col("ord") <= over).drop("base", "above", "k", "parent_k"))


def hop_lists(page: DataFrame, *carried: str) -> DataFrame:
    """cur, hops: the hops of every node in order as structs (hop, there, edge, carried columns), dealt by node and kept by
    the executors, so that no level of a walk deals them anew. The caller unpersists it."""
    parts = int(page.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    follow = F.struct("hop", "there", "edge", *carried)
    return page.repartition(parts, "cur").groupBy("cur").agg(F.array_sort(F.collect_list(follow)).alias("hops")).persist()


def single_start_states(starts: DataFrame, hops: DataFrame, limits: Limits, *carried: str) -> DataFrame:
    """As `admitted_states` for runs of one start each (run, start_id) over `hop_lists`, of which `carried` columns stay.

    The number of a state and of the states up to its level are carried by the rows, so that a level takes one join and one
    window, and no earlier level is read again.
    """
    over = limits.states + 1
    absent = [F.lit(None).cast(hops.schema["hops"].dataType.elementType[c].dataType).alias(c) for c in carried]
    level = materialize(
        starts.where(F.col("start_id").isNotNull())
        .distinct()
        .select("run", F.col("start_id").alias("cur"), F.lit(0).alias("depth"), F.array("start_id").alias("node_ids"), F.array().cast("array<bigint>").alias("edge_ids"), *absent, F.lit(1).cast("long").alias("ord"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("hop"), F.lit(1).cast("long").alias("_upto"))
    )
    levels = level
    by_run = Window.partitionBy("run")
    earlier = by_run.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    for d in range(1, limits.depth + 1):
        fresh = F.filter("hops", lambda h: ~F.array_contains("node_ids", h["there"]))
        step = level.where(F.col("_upto") < over).select("run", "cur", "node_ids", "edge_ids", "ord", "_upto").join(hops, "cur").withColumn("hops", fresh)
        step = step.withColumns({"_before": F.coalesce(F.sum(F.size("hops")).over(earlier), F.lit(0)), "_made": F.sum(F.size("hops")).over(by_run), "_room": F.lit(over) - F.col("_upto")})
        taken = F.slice("hops", F.lit(1), F.least(F.size("hops"), F.col("_room") - F.col("_before")).cast("int"))
        step = step.where(F.col("_before") < F.col("_room")).select("run", "node_ids", "edge_ids", F.col("ord").alias("parent"), "_upto", "_before", F.least("_made", "_room").alias("_made"), F.posexplode(taken).alias("_at", "h"))
        level = materialize(
            step.select(
                "run", F.col("h.there").alias("cur"), F.lit(d).alias("depth"), F.concat("node_ids", F.array("h.there")).alias("node_ids"), F.concat("edge_ids", F.array("h.edge")).alias("edge_ids"),
                *[F.col(f"h.{c}").alias(c) for c in carried], (F.col("_upto") + F.col("_before") + F.col("_at") + 1).alias("ord"), "parent", F.col("h.hop").alias("hop"), (F.col("_upto") + F.col("_made")).alias("_upto"),
            )
        )
        if level.isEmpty():
            break
        levels = levels.unionByName(level)
    return levels.drop("_upto")


def _runs(roots: DataFrame) -> DataFrame:
    """incident_id, root_id; roots without an incident are one."""
    return roots if "incident_id" in roots.columns else roots.withColumn("incident_id", F.lit(0).cast("long"))


#: Roots of a group of merged paths: so many 64-bit words hold a bit for each of them.
WORDS = 8


def _bits(prefix: str = "w") -> list[str]:
    return [f"{prefix}{k}" for k in range(WORDS)]


def numbered_roots(roots: DataFrame) -> DataFrame:
    """root_id, chunk, word, mask: the bit of every root, neighbours of the key in one chunk; written once, so that it is fixed."""
    keys = materialize(roots.select("root_id").where("root_id IS NOT NULL").distinct().repartitionByRange("root_id").sortWithinPartitions("root_id").withColumn("_n", F.monotonically_increasing_id()))
    return keys.select("root_id", F.floor(F.col("_n") / (64 * WORDS)).alias("chunk"), F.floor(F.col("_n") / 64 % WORDS).cast("int").alias("word"), F.expr("shiftleft(1L, int(_n % 64))").alias("mask"))


def _by_range(rows: DataFrame, column: str, parts: int) -> Callable[[Column], Column]:
    """Which of `parts` ranges of about as many rows a value of the column lies in, so that neighbours stay together."""
    cuts = [k / parts for k in range(1, parts)]
    bounds = sorted(set(rows.approxQuantile(column, cuts, 1 / (4 * parts)))) if cuts else []

    def place(c: Column, low: int, high: int) -> Column:
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(c < bounds[mid], place(c, low, mid)).otherwise(place(c, mid + 1, high))

    return lambda c: place(c, 0, len(bounds))


def _union_bits(old: list[str], new: list[str]) -> list[Column]:
    return [F.bit_or(o).alias(n) for o, n in zip(old, new, strict=True)]


@dataclass(frozen=True)
class Reach:
    """Merged paths of many roots: which of them meet a node first at a depth, as bits (see `numbered_roots`)."""

    named: DataFrame
    nodes: DataFrame  #: cur, chunk, depth, words: nodes that a path goes through, written level by level
    stops: DataFrame  #: _range, _here, _there: hops to nodes where a path ends
    depth: int
    ranged: Callable[[DataFrame], DataFrame]

    def ends(self) -> DataFrame:
        """cur, chunk, word, depth, bits of the nodes where paths end, a row for each hop to them."""
        words = F.explode(F.array(*[F.struct(F.lit(k).alias("word"), F.col(w).alias("bits")) for k, w in enumerate(_bits())])).alias("w")
        met = self.ranged(self.nodes.where(F.col("depth") < self.depth)).join(self.stops, [F.col("_at") == F.col("_range"), F.col("cur") == F.col("_here")])
        return met.select(F.col("_there").alias("cur"), "chunk", (F.col("depth") + 1).alias("depth"), words).select("cur", "chunk", "w.word", "depth", "w.bits").where("bits <> 0")

    def rooted(self, rows: DataFrame) -> DataFrame:
        """`rows` (chunk, word and more) with root_id and mask of every root of the word."""
        return rows.join(self.named, ["chunk", "word"])


def reach_page(edges: DataFrame, fan_out: int, *carried: str) -> DataFrame:
    """The edges within the fan-out bound of their target, written once: source_id, source_kind, target_id and `carried` columns."""
    return materialize(bounded_adjacency(edges, "target_id", fan_out, ("id", "source_id")).select("source_id", "source_kind", "target_id", *carried))


def merged_reach(named: DataFrame, roots: DataFrame, page: DataFrame, depth: int) -> Reach:
    """The walk of the roots (root_id, numbered in `named`) over a page of edges: paths to a node are merged level by level
    (its shortest path is a simple one), and so are the roots.

    A level holds a row for a node and a chunk of 64 * WORDS roots, with a bit for each root that reaches it first there.
    Nodes where paths end are no part of a level: they follow from the levels at last. Hops are dealt once, by ranges of the
    node id, and kept by the executors; what the nodes of a range send to one node is united before it is dealt.
    """
    parts = int(page.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hops = page.select(F.col("target_id").alias("_here"), F.col("source_id").alias("_there"), (F.col("source_kind") == "Service").alias("_stop")).distinct()
    place = _by_range(page, "target_id", parts)
    hops = hops.withColumn("_range", place(F.col("_here")))
    ranged = lambda rows: rows.withColumn("_at", place(F.col("cur"))).repartition(parts, "_at")
    onward = hops.where(~F.col("_stop")).drop("_stop").repartition(parts, "_range").sortWithinPartitions("_range", "_here").persist()
    own = [F.bit_or(F.when(F.col("word") == k, F.col("mask")).otherwise(0)).alias(w) for k, w in enumerate(_bits())]
    level = materialize(named.join(roots.select("root_id").distinct(), "root_id", "left_semi").groupBy(F.col("root_id").alias("cur"), "chunk").agg(*own).select("cur", "chunk", F.lit(0).alias("depth"), *_bits()))
    found, none = level, [F.lit(0).cast("long").alias(w) for w in _bits()]
    for d in range(1, depth + 1):
        sent = ranged(level).join(onward, [F.col("_at") == F.col("_range"), F.col("cur") == F.col("_here")]).select(F.col("_there").alias("cur"), "chunk", *_bits(), *[F.lit(0).cast("long").alias(k) for k in _bits("k")])
        known = found.select("cur", "chunk", *none, *[F.col(w).alias(k) for w, k in zip(_bits(), _bits("k"), strict=True)])
        step = sent.unionByName(known).groupBy("cur", "chunk").agg(*_union_bits(_bits(), _bits()), *_union_bits(_bits("k"), _bits("k")))
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(k)).alias(w) for w, k in zip(_bits(), _bits("k"), strict=True)]
        level = materialize(step.select("cur", "chunk", F.lit(d).alias("depth"), *fresh).where(" OR ".join(f"{w} <> 0" for w in _bits())))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    onward.unpersist()
    return Reach(named, found, hops.where("_stop").drop("_stop"), depth, ranged)


def reached(roots: DataFrame, edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Nodes within the depth and fan-out bounds with their fewest hops: root_id, cur, depth, terminal. Only the result has a
    row for a root and a node (see `merged_reach`)."""
    found = merged_reach(materialize(numbered_roots(roots)), roots, reach_page(edges, limits.fan_out), limits.depth)
    words = F.explode(F.array(*[F.struct(F.lit(k).alias("word"), F.col(w).alias("bits")) for k, w in enumerate(_bits())])).alias("w")
    through = found.nodes.select("cur", "chunk", "depth", words).select("cur", "chunk", "depth", "w.word", "w.bits").where("bits <> 0")
    through = found.rooted(through).where(F.col("bits").bitwiseAND(F.col("mask")) != 0).select("root_id", "cur", "depth", F.lit(False).alias("terminal"))
    at = range(1, limits.depth + 1)
    ends = found.ends().groupBy("cur", "chunk", "word").agg(*[F.bit_or(F.when(F.col("depth") == d, F.col("bits"))).alias(f"d{d}") for d in at])
    first = F.coalesce(*[F.when(F.col(f"d{d}").bitwiseAND(F.col("mask")) != 0, d) for d in at])
    ends = found.rooted(ends).select("root_id", "cur", first.alias("depth"), F.lit(True).alias("terminal")).where("depth IS NOT NULL")
    return through.unionByName(ends)


def all_paths(roots: DataFrame, edges: DataFrame, depth: int, fan_out: int) -> DataFrame:
    """Every simple path of at most `depth` hops from every root, without a bound on their number: root_id, cur, depth, node_ids, edge_ids, terminal."""
    page = bounded_adjacency(edges, "target_id", fan_out, ("id", "source_id")).where(canonical(edges))
    return simple_paths(roots.select(F.col("root_id").alias("start_id")).distinct(), page, depth, "target_id", "source_id", F.col("source_kind") == "Service").withColumnRenamed("start_id", "root_id")


def path_cuts(states: DataFrame, roots: DataFrame, edges: DataFrame, depth: int, fan_out: int) -> DataFrame:
    """What the bounds cut of every root's paths: root_id, cut_paths (stop at the depth bound and would go on), cut_nodes (have more dependents than the fan-out bound), truncated."""
    page = bounded_adjacency(edges, "target_id", fan_out, ("id", "source_id")).select(F.col("target_id").alias("cur"), "source_id")
    open_ends = states.where((F.col("depth") == depth) & ~F.col("terminal")).join(page, "cur").where(~F.array_contains("node_ids", F.col("source_id")))
    paths = open_ends.select("root_id", "edge_ids").distinct().groupBy("root_id").agg(F.count("*").alias("cut_paths"))
    wide = cut_nodes(edges, "target_id", fan_out).withColumnRenamed("node_id", "cur")
    nodes = states.where((F.col("depth") < depth) & ~F.col("terminal")).select("root_id", "cur").distinct().join(wide, "cur").groupBy("root_id").agg(F.count("*").alias("cut_nodes"))
    rows = roots.select("root_id").distinct().join(paths, "root_id", "left").join(nodes, "root_id", "left").na.fill(0, ["cut_paths", "cut_nodes"])
    return rows.withColumn("truncated", (F.col("cut_paths") > 0) | (F.col("cut_nodes") > 0))


def valid_at(moment: int) -> Column:
    """Validity unknown, or begun and not ended by `moment` (both ends inclusive, no end = open)."""
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= moment)
    return begun & (F.col("valid_from").isNull() | F.col("valid_until").isNull() | (F.col("valid_until") >= moment))


@dataclass(frozen=True)
class Traversal:
    """services: incident_id, root_id, cur, depth, node_ids, edge_ids, ord, terminal of the paths that all bounds let
    through; warnings: incident_id, code, node_id, path (node ids), place."""

    services: DataFrame
    warnings: DataFrame

    def cut(self) -> DataFrame:
        """incident_id of the runs of which a bound cut something."""
        return self.warnings.where(~F.col("code").isin(*HARMLESS)).select("incident_id").distinct()


#: Warnings that do not mean that something was cut.
HARMLESS = ("cycle-skipped", "missing-node", "unsupported-root-node", "invalid-canonical-hop", "missing-seed-evidence", "unsupported-seed-kind")
#: Codes of the bounds, and those after which the traversal ends.
SERVICE_CODES = {"fan_out": "dependents-per-node-limit-reached", "ends": "service-limit-reached", "paths_per_end": "paths-per-service-limit-reached", "ending": ["path-limit-reached", "traversal-state-limit-reached"]}
TARGET_CODES = {"fan_out": "outgoing-edge-limit-reached", "ends": "target-limit-reached", "paths_per_end": "paths-per-target-limit-reached", "ending": ["target-limit-reached", "traversal-state-limit-reached"]}


def bounded_traversal(roots: DataFrame, edges: DataFrame, limits: Limits = Limits(), as_of: int | None = None, nodes: DataFrame | None = None, left: Callable[[DataFrame], DataFrame] | None = None) -> Traversal:
    """What first-in-first-out traversals under all bounds return and warn of, one for every incident, in closed form.

    roots: root_id and incident_id (without it, all are one incident's). Admission order within an incident is (root,
    depth, edge ids). An event is placed by the state that is looked at and the hop of it. A traversal ends at the first
    event that ends it, or at the warning that exceeds the budget: services looked at later do not count. A service
    beyond its bound, or a path beyond its service's bound, is skipped. `nodes` (id, kind) tells missing roots and roots
    of another kind. `as_of` keeps edges whose validity is unknown or covers it, before the fan-out bound is applied.
    `left` takes edges away after it (see `Hops`).
    """
    if as_of is not None:
        edges = edges.where(valid_at(as_of))
    roots = _runs(roots).select("incident_id", "root_id").distinct()
    refused = None
    if nodes is not None:
        kinds = roots.join(nodes.select(F.col("id").alias("root_id"), F.col("kind").alias("root_kind")), "root_id", "left")
        code = F.when(F.col("root_kind").isNull(), "missing-node").when(F.col("root_kind") != "PackageVersion", "unsupported-root-node")
        kinds = materialize(kinds.withColumn("code", code))
        refused = kinds.where("code IS NOT NULL").select(F.col("incident_id").alias("run"), F.col("root_id").alias("start_id"), "code")
        roots = kinds.where("code IS NULL")
    hops = Hops(edges, "target_id", "source_id", limits.fan_out, canonical(edges), F.col("source_kind") == "Service", left)
    states = admitted_states(roots.select(F.col("incident_id").alias("run"), F.col("root_id").alias("start_id")), hops, limits)
    return _bounded(states, hops, limits, F.col("terminal"), SERVICE_CODES, refused)


def _bounded(states: DataFrame, hops: Hops, limits: Limits, end: Column, codes: dict, refused: DataFrame | None) -> Traversal:
    """The ends (states with `end`) and warnings of every run's states; see `bounded_traversal`."""
    served = states.where(F.col("ord") <= limits.states)
    # the state beyond the bound ends its run where it would have been made; a start has no parent: all before it were looked at
    beyond = materialize(states.where(F.col("ord") > limits.states).select("run", "cur", "node_ids", F.coalesce("parent", F.lit(limits.states + 1)).alias("ord"), "hop"))
    looked = served.where(~F.col("terminal")).join(beyond.select("run", F.col("ord").alias("_last")), "run", "left").where("_last IS NULL OR ord <= _last").drop("_last", "hop")
    met = _nodes(looked)
    page, wide = hops.of(met), cut_nodes(hops.near(met), hops.here, limits.fan_out)
    onward = F.concat("node_ids", F.array("there"))
    event = lambda code, node, path, hop: F.struct(F.lit(code).alias("code"), node.alias("node_id"), path.alias("path"), hop.cast("long").alias("hop"))
    at_hop = [
        F.when(~F.col("canonical"), event("invalid-canonical-hop", F.col("there"), F.col("node_ids"), F.col("hop"))),
        F.when(F.col("canonical") & F.col("seen"), event("cycle-skipped", F.col("there"), onward, F.col("hop"))),
        F.when(F.col("canonical") & ~F.col("seen") & (F.col("depth") == limits.depth), event("depth-limit-reached", F.col("cur"), onward, F.col("hop"))),
    ]
    stepped = looked.join(page.drop("kind", "stop"), "cur").withColumn("seen", F.array_contains("node_ids", F.col("there"))).where(~F.col("canonical") | F.col("seen") | (F.col("depth") == limits.depth))
    told = stepped.select("run", "ord", F.explode(F.array_compact(F.array(*at_hop))).alias("e")).select("run", "ord", "e.*")
    deep = told.where("code = 'depth-limit-reached'").groupBy("run", "ord").agg(F.min_by(F.struct("code", "node_id", "path", "hop"), "hop").alias("e")).select("run", "ord", "e.*")
    told = told.where("code <> 'depth-limit-reached'").unionByName(deep)
    say = lambda df, code: df.select("run", F.col("ord").cast("long").alias("ord"), F.lit(code).alias("code"), F.col("cur").alias("node_id"), F.col("node_ids").alias("path"), F.lit(0).cast("long").alias("hop"))
    by_run, by_end = Window.partitionBy("run"), Window.partitionBy("run", "cur")
    placed = served.where(end).withColumn("_first", F.min("ord").over(by_end)).withColumn("_path", F.row_number().over(by_end.orderBy("ord")))
    placed = materialize(placed.withColumn("_rank", F.dense_rank().over(by_run.orderBy("_first"))).drop("_first"))
    taken = placed.where((F.col("_rank") <= limits.ends) & (F.col("_path") <= limits.paths_per_end)).withColumn("_total", F.row_number().over(by_run.orderBy("ord")))
    events = [
        told,
        say(looked.join(wide.withColumnRenamed("node_id", "cur"), "cur", "left_semi"), codes["fan_out"]),
        say(placed.where(F.col("_rank") > limits.ends), codes["ends"]),
        say(placed.where((F.col("_rank") <= limits.ends) & (F.col("_path") > limits.paths_per_end)), codes["paths_per_end"]),
        say(taken.where(F.col("_total") == limits.paths + 1), "path-limit-reached"),
        beyond.select("run", "ord", F.lit("traversal-state-limit-reached").alias("code"), F.col("cur").alias("node_id"), F.col("node_ids").alias("path"), F.col("hop").cast("long").alias("hop")),
    ]
    if refused is not None:
        # at its turn: after the states of all smaller roots of its run
        sofar = Window.partitionBy("run").orderBy("start_id").rowsBetween(Window.unboundedPreceding, -1)
        lasts = states.groupBy("run", "start_id").agg(F.max("ord").alias("last")).withColumn("code", F.lit(None).cast("string"))
        turns = lasts.unionByName(refused.withColumn("last", F.lit(None).cast("long"))).withColumn("ord", F.coalesce(F.max("last").over(sofar), F.lit(0))).where("code IS NOT NULL")
        events.append(turns.select("run", "ord", "code", F.col("start_id").alias("node_id"), F.array().cast("array<bigint>").alias("path"), (F.col("start_id") + (1 << 40)).alias("hop")))
    said = events[0]
    for more in events[1:]:
        said = said.unionByName(more)
    once = said.groupBy("run", "code", "node_id", "path").agg(F.min(F.struct("ord", "hop")).alias("at"))
    numbered = materialize(once.withColumn("place", F.row_number().over(by_run.orderBy("at", "code", "node_id", "path"))).where(F.col("place") <= limits.warnings))
    stops = numbered.where(F.col("code").isin(codes["ending"]) | (F.col("place") >= limits.warnings)).groupBy("run").agg(F.min(F.struct("place", F.col("at.ord").alias("ord"))).alias("stop"))
    ends_at = materialize(stops.select("run", F.col("stop.place").alias("stop_place"), F.col("stop.ord").alias("stop_ord")))
    kept = numbered.join(ends_at, "run", "left").where((F.col("place") < limits.warnings) & (F.col("stop_place").isNull() | (F.col("place") <= F.col("stop_place"))))
    budget = ends_at.where(F.col("stop_place") >= limits.warnings).select("run", F.lit("warning-limit-reached").alias("code"), F.lit(None).cast("long").alias("node_id"), F.array().cast("array<bigint>").alias("path"), F.lit(limits.warnings).alias("place"))
    warnings = kept.select("run", "code", "node_id", "path", "place").unionByName(budget)
    ends = taken.where(F.col("_total") <= limits.paths).join(ends_at, "run", "left").where("stop_ord IS NULL OR ord < stop_ord")
    ends = ends.select(F.col("run").alias("incident_id"), F.col("start_id").alias("root_id"), "cur", "depth", "node_ids", "edge_ids", "last_kind", "terminal", "ord")
    return Traversal(materialize(ends), materialize(warnings.select(F.col("run").alias("incident_id"), "code", "node_id", "path", F.col("place").cast("long").alias("place"))))


def capped_services(roots: DataFrame, edges: DataFrame, limits: Limits) -> DataFrame:
    """Service paths that a first-in-first-out traversal under all bounds returns: incident_id, root_id, cur, depth, edge_ids, ord."""
    return bounded_traversal(roots, edges, limits).services.select("incident_id", "root_id", "cur", "depth", "edge_ids", "ord")


#: The authority relations with their end kinds, and what the last one on a path enables.
AUTHORITY = (
    ("MAINTAINS", "Maintainer", "Package", "maintain"),
    ("MEMBER_OF", "Maintainer", "Organization", "belong"),
    ("OWNS", "Organization", "Package", "own"),
    ("OWNS", "Organization", "Repository", "own"),
    ("OWNS", "Organization", "Service", "own"),
    ("CONTROLS", "Maintainer", "Credential", "control"),
    ("CONTROLS", "Organization", "Credential", "control"),
    ("TRIGGERS", "Repository", "CIWorkflow", "trigger"),
    ("CAN_ACCESS", "CIWorkflow", "Credential", "access"),
    ("CAN_PUBLISH", "Credential", "Package", "publish"),
)
SEED_KINDS = ("Maintainer", "Organization", "Repository", "CIWorkflow", "Credential")


#: The bounds of the authority traversal; it has none on all paths together.
AUTHORITY_LIMITS = Limits(depth=8, fan_out=500, states=5000, ends=500, paths_per_end=10, paths=1 << 40)


def authority_paths(seeds: DataFrame, edges: DataFrame, limits: Limits = AUTHORITY_LIMITS) -> tuple[Traversal, DataFrame, DataFrame]:
    """The paths and warnings of `authority_traversal` before evidence is gathered (every path keeps its row there), the
    merged seeds that start, and the edges that count."""
    spark = edges.sparkSession
    rules = spark.createDataFrame(list(AUTHORITY), "kind string, source_kind string, target_kind string, capability string")
    allowed = materialize(edges.join(F.broadcast(rules.drop("capability")), ["kind", "source_kind", "target_kind"]).where(F.size("evidence_ids") > 0))
    cited = _runs(seeds).select("incident_id", "seed_id", "seed_kind", F.explode_outer("seed_evidence").alias("e")).distinct()
    merged = cited.groupBy("incident_id", "seed_id", "seed_kind").agg(F.sort_array(F.collect_list("e")).alias("seed_evidence"))
    code = F.when(F.size("seed_evidence") == 0, "missing-seed-evidence").when(~F.col("seed_kind").isin(*SEED_KINDS), "unsupported-seed-kind")
    merged = materialize(merged.withColumn("code", code))
    good = merged.where("code IS NULL")
    hops = Hops(allowed, "source_id", "target_id", limits.fan_out)
    states = admitted_states(good.select(F.col("incident_id").alias("run"), F.col("seed_id").alias("start_id")), hops, limits)
    refused = merged.where("code IS NOT NULL").select(F.col("incident_id").alias("run"), F.col("seed_id").alias("start_id"), "code")
    found = _bounded(states, hops, limits, F.col("depth") > 0, TARGET_CODES, refused)
    return Traversal(found.services.withColumnRenamed("root_id", "seed_id").withColumnRenamed("cur", "target_id"), found.warnings), good, allowed


def authority_traversal(seeds: DataFrame, edges: DataFrame, limits: Limits = AUTHORITY_LIMITS) -> Traversal:
    """Forward simple paths over the authority relations under all bounds, one run an incident: every node reached is a target.

    seeds (seed_id, seed_kind, seed_evidence, and incident_id; without it, all are one incident's) are merged by node
    with evidence united; a seed without evidence or of another kind is warned of. Edges count only with allowed end
    kinds and evidence. `services` has incident_id, seed_id, target_id, depth, capability, edge_ids, node_ids,
    evidence_ids (seed and edges).
    """
    found, good, allowed = authority_paths(seeds, edges, limits)
    enables = F.create_map(*[F.lit(x) for kind, _, _, word in {r[0]: r for r in AUTHORITY}.values() for x in (kind, word)])
    key = ["incident_id", "ord"]
    proof = found.services.select(*key, F.explode("edge_ids").alias("id")).join(allowed.select("id", F.explode("evidence_ids").alias("e")), "id").select(*key, "e").distinct()
    proof = proof.groupBy(*key).agg(F.collect_list("e").alias("of_edges"))
    targets = found.services.join(good.select("incident_id", "seed_id", "seed_evidence"), ["incident_id", "seed_id"]).join(proof, key)
    shown = targets.select(
        "incident_id",
        "seed_id",
        "target_id",
        "depth",
        enables[F.col("last_kind")].alias("capability"),
        "edge_ids",
        "node_ids",
        F.array_sort(F.array_union("seed_evidence", "of_edges")).alias("evidence_ids"),
    )
    return Traversal(shown, found.warnings)


def authority_reach(seeds: DataFrame, edges: DataFrame, limits: Limits = AUTHORITY_LIMITS) -> DataFrame:
    """The targets of `authority_traversal`."""
    return authority_traversal(seeds, edges, limits).services
