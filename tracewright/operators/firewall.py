"""Release-influence firewall: what reaches a release backwards, what is wrong with it, and the verdict.

Every release is a run of its own on the bounded frontier of `traverse`; all are evaluated side by side. A finding is
placed by the state that is looked at, the hop of it and the test; caps cut by place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .traverse import Limits, cut_nodes, hop_lists, single_start_states

#: Finding codes with their default severity.
DISPOSITIONS = {
    "missing-artifact-publication": "quarantine",
    "missing-edge-evidence": "quarantine",
    "untrusted-edge": "block",
    "unknown-edge": "quarantine",
    "cross-boundary-cache": "block",
    "unknown-cache-boundary": "quarantine",
    "missing-node-evidence": "quarantine",
    "untrusted-node": "block",
    "unknown-node": "quarantine",
    "cycle-skipped": "warning",
    "depth-limit-reached": "quarantine",
    "incoming-edge-limit-reached": "quarantine",
    "traversal-state-limit-reached": "quarantine",
    "risk-path-limit-reached": "quarantine",
    "finding-limit-reached": "quarantine",
}
#: Findings that say that the evaluation is not whole.
TRUNCATING = ("depth-limit-reached", "incoming-edge-limit-reached", "traversal-state-limit-reached", "risk-path-limit-reached", "finding-limit-reached")
CACHE_KINDS = ("writes-cache", "restores-cache")
TRUST = ("trusted", "untrusted", "unknown")
BOUNDARIES = ("same-trust-zone", "cross-trust-boundary", "unknown")
NODE_KINDS = ("source-change", "workflow-run", "cache-entry", "build", "credential", "attestation", "artifact", "release")
#: Source and target kinds that each release relation may connect.
_JOBS = ("workflow-run", "build")
RELATIONS = {
    "triggers": (("source-change",), ("workflow-run",)),
    "checks-out": (("source-change",), ("workflow-run",)),
    "writes-cache": (_JOBS, ("cache-entry",)),
    "restores-cache": (("cache-entry",), _JOBS),
    "starts-build": (("workflow-run",), ("build",)),
    "mints-credential": (_JOBS, ("credential",)),
    "uses-credential": (("credential",), _JOBS),
    "produces": (_JOBS, ("artifact",)),
    "attests": (("attestation",), ("artifact", "release")),
    "publishes": (("artifact",), ("release",)),
    "authorizes-publish": (("credential",), ("release",)),
    "influences": (tuple(k for k in NODE_KINDS if k != "release"), NODE_KINDS),
}


@dataclass(frozen=True)
class FirewallLimits:
    """Bounds of one release's evaluation."""

    depth: int = 16
    fan_in: int = 1000
    states: int = 10_000
    risk_paths: int = 100
    findings: int = 250


@dataclass(frozen=True)
class Evaluation:
    """findings: release_id, code, severity, node_id, edge_id, path_key, place; risk_paths: release_id, path_key, node_ids,
    edge_ids; decisions: release_id, verdict, blocking, quarantining, warnings, codes, inspected_nodes, inspected_edges,
    risk_paths, truncated."""

    findings: DataFrame
    risk_paths: DataFrame
    decisions: DataFrame


def _faults(tests: list[tuple[int, str, Column]]) -> Column:
    """The tests that a row fails (slot, code)."""
    return F.array_compact(F.array(*[F.when(test, F.struct(F.lit(slot).alias("slot"), F.lit(code).alias("code"))) for slot, code, test in tests]))


def evaluate(nodes: DataFrame, edges: DataFrame, releases: DataFrame | None = None, limits: FirewallLimits = FirewallLimits(), dispositions: dict[str, str] | None = None) -> Evaluation:
    """Findings, risk paths and verdicts of the releases (release_id; all release nodes by default).

    Influence edges point from cause to effect; the walk goes backwards, states in order of (depth, edge ids). A release
    ends at its state bound or at the finding that exceeds the finding bound; the last place then says so. Of the paths
    with a finding that is no warning the first `risk_paths` stay, the next one is told once. A verdict is block over
    quarantine (any such finding, or a bound that cut) over allow. The input must be free of `input_errors`.
    """
    severity = F.create_map(*[F.lit(x) for pair in (DISPOSITIONS | (dispositions or {})).items() for x in pair])
    if releases is None:
        releases = nodes.where("kind = 'release'").select(F.col("id").alias("release_id"))
    releases = materialize(releases.distinct())
    cache = F.col("kind").isin(*CACHE_KINDS)
    of_edges = _faults(
        [
            (1, "missing-edge-evidence", F.size("evidence_ids") == 0),
            (2, "untrusted-edge", F.col("trust") == "untrusted"),
            (2, "unknown-edge", F.col("trust") == "unknown"),
            (3, "cross-boundary-cache", cache & (F.col("boundary") == "cross-trust-boundary")),
            (3, "unknown-cache-boundary", cache & (F.col("boundary") == "unknown")),
        ]
    )
    of_nodes = _faults([(4, "missing-node-evidence", F.size("evidence_ids") == 0), (5, "untrusted-node", F.col("trust") == "untrusted"), (5, "unknown-node", F.col("trust") == "unknown")])
    # what is wrong with an edge and its source is told by the hop, so that no state is joined with it
    none = F.array().cast("array<struct<slot:int,code:string>>")
    page = edges.select(F.col("target_id").alias("cur"), F.col("source_id").alias("there"), F.col("id").alias("edge"), of_edges.alias("edge_faults"))
    page = page.withColumn("hop", F.row_number().over(Window.partitionBy("cur").orderBy("edge", "there"))).where(F.col("hop") <= limits.fan_in)
    faulty_nodes = nodes.select(F.col("id").alias("there"), of_nodes.alias("node_faults")).where(F.size("node_faults") > 0)
    page = page.join(faulty_nodes, "there", "left").withColumn("faults", F.concat("edge_faults", F.coalesce("node_faults", none)))
    hops = hop_lists(page, "faults")
    starts = releases.select(F.col("release_id").alias("run"), F.col("release_id").alias("start_id"))
    states = single_start_states(starts, hops, Limits(depth=limits.depth, fan_out=limits.fan_in, states=limits.states), "faults").withColumnRenamed("run", "release_id")
    beyond = materialize(states.where(F.col("ord") > limits.states).select("release_id", F.col("parent").alias("_last"), F.col("hop").alias("_last_hop")))
    looked = states.where(F.col("ord") <= limits.states).select("release_id", "cur", "depth", "node_ids", "ord").join(beyond, "release_id", "left").where("_last IS NULL OR ord <= _last")
    expanded = looked.where(F.col("depth") < limits.depth)
    listed = lambda c: F.array_join(F.transform(F.reverse(c), lambda x: x.cast("string")), ",")
    key = F.concat(F.lit("[["), listed("node_ids"), F.lit("],["), listed("edge_ids"), F.lit("]]"))
    heads = states.where("depth > 0").select("release_id", F.col("parent").alias("ord"), "hop", F.col("cur").alias("node_id"), F.element_at("edge_ids", -1).alias("edge_id"), "node_ids", "edge_ids", "faults")
    faulty = heads.where(F.size("faults") > 0)
    faulty = materialize(faulty.select("release_id", "ord", "hop", "node_id", "edge_id", "node_ids", "edge_ids", key.alias("path_key"), "faults"))
    by_release = Window.partitionBy("release_id")

    null, blank = F.lit(None).cast("long"), F.lit(None).cast("string")
    at = lambda o, h, s: F.struct(F.coalesce(o, F.lit(0)).cast("long").alias("ord"), h.cast("long").alias("hop"), s.cast("int").alias("slot")).alias("at")
    event = lambda df, code, node, edge, place: df.select("release_id", F.lit(code).alias("code"), node.alias("node_id"), edge.alias("edge_id"), blank.alias("path_key"), place)
    by_path = faulty.select("release_id", "ord", "hop", "node_id", "edge_id", "path_key", F.explode("faults").alias("f"))
    of_node = F.col("f.slot") >= 4
    on_paths = by_path.select("release_id", F.col("f.code").alias("code"), F.when(of_node, F.col("node_id")).alias("node_id"), F.when(~of_node, F.col("edge_id")).alias("edge_id"), "path_key", at(F.col("ord"), F.col("hop"), F.col("f.slot") * 2))
    # the path after the last that stays is told with the first of its findings that is no warning
    risky = by_path.where(severity[F.col("f.code")] != "warning").groupBy("release_id", "ord", "hop").agg(F.min("f.slot").alias("slot"))
    ranked = risky.withColumn("_n", F.row_number().over(by_release.orderBy("ord", "hop")))
    crowded = event(ranked.where(F.col("_n") == limits.risk_paths + 1), "risk-path-limit-reached", null, null, at(F.col("ord"), F.col("hop"), F.col("slot") * 2 + 1))
    closing = F.explode(F.filter("hops", lambda h: F.array_contains("node_ids", h["there"]))).alias("h")
    cycles = expanded.join(hops, "cur").select("release_id", "ord", "_last", "_last_hop", closing).where("_last IS NULL OR ord < _last OR h.hop < _last_hop")
    cycles = materialize(cycles.select("release_id", "ord", "h.hop", F.col("h.there").alias("node_id"), F.col("h.edge").alias("edge_id")))
    wide = cut_nodes(edges, "target_id", limits.fan_in).withColumnRenamed("node_id", "cur")
    deep = looked.where(F.col("depth") == limits.depth).join(hops.select("cur"), "cur", "left_semi")
    zero = F.lit(0)
    repeated = [
        event(cycles, "cycle-skipped", F.col("node_id"), F.col("edge_id"), at(F.col("ord"), F.col("hop"), zero)),
        event(deep, "depth-limit-reached", F.col("cur"), null, at(F.col("ord"), zero, zero)),
        event(expanded.join(wide, "cur", "left_semi"), "incoming-edge-limit-reached", F.col("cur"), null, at(F.col("ord"), zero, zero)),
    ]
    once = repeated[0].unionByName(repeated[1]).unionByName(repeated[2]).groupBy("release_id", "code", "node_id", "edge_id", "path_key").agg(F.min("at").alias("at"))
    facts = nodes.join(releases.withColumnRenamed("release_id", "id"), "id", "left_semi").select(F.col("id").alias("release_id"), "evidence_ids")
    published = edges.where("kind = 'publishes'").select(F.col("target_id").alias("release_id")).distinct()
    bare = event(facts.where(F.size("evidence_ids") == 0), "missing-node-evidence", F.col("release_id"), null, at(zero, zero, zero))
    orphan = event(facts.join(published, "release_id", "left_anti"), "missing-artifact-publication", F.col("release_id"), null, at(zero, zero, F.lit(1)))
    full = event(beyond, "traversal-state-limit-reached", null, null, at(F.col("_last"), F.col("_last_hop"), F.lit(20)))
    events = on_paths
    for more in (crowded, once, bare, orphan, full):
        events = events.unionByName(more)
    placed = events.withColumn("place", F.row_number().over(by_release.orderBy("at", "code", "node_id", "edge_id"))).where(F.col("place") <= limits.findings)
    over = F.col("place") == limits.findings
    told = lambda c: F.when(~over, F.col(c)).alias(c)
    kept = placed.select("release_id", F.when(over, "finding-limit-reached").otherwise(F.col("code")).alias("code"), told("node_id"), told("edge_id"), told("path_key"), F.col("place").cast("long").alias("place"), "at")
    kept = materialize(kept.withColumn("severity", severity[F.col("code")]))
    hops.unpersist()

    counted = kept.where("path_key IS NOT NULL AND severity <> 'warning'").groupBy("release_id", "path_key").agg(F.min("place").alias("first"))
    risk = counted.withColumn("_n", F.row_number().over(by_release.orderBy("first"))).where(F.col("_n") <= limits.risk_paths).drop("_n", "first")
    risk = materialize(risk.join(faulty.select("release_id", "path_key", F.reverse("node_ids").alias("node_ids"), F.reverse("edge_ids").alias("edge_ids")), ["release_id", "path_key"]))

    stops = kept.where("code = 'finding-limit-reached'").select("release_id", F.struct("at.ord", "at.hop").alias("_stop"))
    seen = heads.select("release_id", "ord", "hop", "node_id", "edge_id").unionByName(cycles.withColumn("node_id", null))
    seen = seen.join(stops, "release_id", "left").where(F.col("_stop").isNull() | (F.struct("ord", F.col("hop").cast("long").alias("hop")) <= F.col("_stop")))
    inspected = seen.groupBy("release_id").agg(F.size(F.collect_set("node_id")).cast("long").alias("nodes"), F.size(F.collect_set("edge_id")).cast("long").alias("edges"))  # at most the state bound
    judged = kept.groupBy("release_id").agg(
        F.count_if(F.col("severity") == "block").alias("blocking"),
        F.count_if(F.col("severity") == "quarantine").alias("quarantining"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"),
        F.some(F.col("code").isin(*TRUNCATING)).alias("truncated"),
    )
    rows = releases.join(judged, "release_id", "left").join(inspected, "release_id", "left").join(risk.groupBy("release_id").agg(F.count("*").alias("risk_paths")), "release_id", "left")
    rows = rows.na.fill(0, ["blocking", "quarantining", "warnings", "nodes", "edges", "risk_paths"]).na.fill("", ["codes"]).na.fill(False, ["truncated"])
    verdict = F.when(F.col("blocking") > 0, "block").when(F.col("truncated") | (F.col("quarantining") > 0), "quarantine").otherwise("allow")
    decisions = rows.select("release_id", verdict.alias("verdict"), "blocking", "quarantining", "warnings", "codes", (F.col("nodes") + 1).alias("inspected_nodes"), F.col("edges").alias("inspected_edges"), "risk_paths", "truncated")
    return Evaluation(kept.select("release_id", "code", "severity", "node_id", "edge_id", "path_key", "place"), risk, decisions)


def summary(decided: DataFrame) -> DataFrame:
    count = lambda v: F.count_if(F.col("verdict") == v)
    return decided.agg(F.count("*").alias("evaluated"), count("allow").alias("allowed"), count("quarantine").alias("quarantined"), count("block").alias("blocked"), F.count_if("truncated").alias("truncated"))


def _valid_id(column: str) -> Column:
    return F.coalesce((F.col(column) >= 0) & (F.col(column) < 1 << 53), F.lit(False))


def _valid_ids(column: str) -> Column:
    return F.coalesce(F.forall(column, lambda x: F.coalesce((x >= 0) & (x < 1 << 53), F.lit(False))), F.lit(False))


def _one_of(column: str, values) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def input_errors(nodes: DataFrame, edges: DataFrame, releases: DataFrame | None = None) -> DataFrame:
    """code, node_id, edge_id of everything that keeps the input from being evaluated; empty for a sound one.

    Rows of nodes and edges with a wrong id, kind, trust, boundary or evidence list, self-links, repeated ids, missing
    ends, kinds that a relation may not connect; of the requested releases repeated, missing and other nodes, and their
    absence altogether. An invalid row has no further errors.
    """
    null = F.lit(None).cast("long")
    node_ok = _valid_id("id") & _one_of("kind", NODE_KINDS) & _one_of("trust", TRUST) & _valid_ids("evidence_ids")
    ends = _valid_id("source_id") & _valid_id("target_id") & (F.col("source_id") != F.col("target_id"))
    edge_ok = _valid_id("id") & _one_of("kind", RELATIONS) & ends & _one_of("trust", TRUST) & _one_of("boundary", BOUNDARIES) & _valid_ids("evidence_ids")
    say = lambda df, code, node=null, edge=null: df.select(F.lit(code).alias("code"), node.cast("long").alias("node_id"), edge.cast("long").alias("edge_id"))
    of = F.col("id")
    out = [say(nodes.where(~node_ok), "invalid-node", of), say(edges.where(~edge_ok), "invalid-edge", null, of)]
    nodes, edges = nodes.where(node_ok), edges.where(edge_ok)
    repeated = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    out += [say(repeated(nodes, "id"), "duplicate-node-id", of), say(repeated(edges, "id"), "duplicate-edge-id", null, of)]
    known = nodes.groupBy("id").agg(F.min("kind").alias("kind"))
    placed = edges.select("id", F.col("kind").alias("relation"), "source_id", "target_id")
    for end in ("source", "target"):
        placed = placed.join(known.select(F.col("id").alias(f"{end}_id"), F.col("kind").alias(f"{end}_kind")), f"{end}_id", "left")
    missing = placed.where("source_kind IS NULL OR target_kind IS NULL")
    out.append(say(missing, "missing-edge-endpoint", F.when(F.col("source_kind").isNull(), F.col("source_id")).otherwise(F.col("target_id")), of))
    fits = F.lit(False)
    for kind, (sources, targets) in RELATIONS.items():
        fits = fits | ((F.col("relation") == kind) & F.col("source_kind").isin(*sources) & F.col("target_kind").isin(*targets))
    out.append(say(placed.where("source_kind IS NOT NULL AND target_kind IS NOT NULL").where(~fits), "invalid-edge-endpoints", null, of))
    if releases is not None:
        asked = releases.groupBy("release_id").agg(F.count("*").alias("n")).join(known.select(F.col("id").alias("release_id"), "kind"), "release_id", "left")
        which = F.col("release_id")
        out += [say(asked.where("n > 1"), "duplicate-release-id", which), say(asked.where("kind IS NULL"), "missing-release-node", which), say(asked.where("kind <> 'release'"), "wrong-release-node-kind", which)]
        out.append(say(releases.agg(F.count("*").alias("n")).where("n = 0"), "empty-release-set"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
