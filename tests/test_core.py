"""Fixtures of the graph engine with known results, and a first-in-first-out simulation of the capped traversal."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tracewright.functions import names as N
from tracewright.functions.identity import edge_logical_id, numeric_id, uri_component, valid_logical_id
from tracewright.functions.semver import parse_range, satisfies
from tracewright.operators import containment, evidence, firewall, investigations, merge, temporal, typosquat
from tracewright.operators.traverse import Limits, admitted_states, all_paths, authority_reach, bounded_traversal, hop_page
from tracewright.sources import lockfile, registry_docs
from tracewright.streaming import jobs

EDGE = "id long, source_id long, source_kind string, target_id long, evidence_ids array<long>, valid_from long, valid_until long"


def edges_of(spark, rows):
    return spark.createDataFrame([(i, s, k, t, e, f, u) for i, s, k, t, e, f, u in rows], EDGE)


# alpha (service 1) and beta (service 2) use affected (10); bridge (11) uses affected; alpha uses bridge; affected uses bridge (cycle)
BLAST = [
    (101, 1, "Service", 10, [900], 0, None),
    (102, 11, "PackageVersion", 10, [900], 0, None),
    (103, 2, "Service", 10, [900], 0, None),
    (104, 1, "Service", 11, [900], 0, None),
    (105, 10, "PackageVersion", 11, [900], 0, None),
]


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root_id long")


def test_blast_radius_fixture(spark):
    found = all_paths(roots(spark, 10), edges_of(spark, BLAST), 12, 1000).where("terminal").collect()
    assert sorted((r.cur, r.depth) for r in found) == [(1, 1), (1, 2), (2, 1)]
    shallow = bounded_traversal(roots(spark, 10), edges_of(spark, BLAST), Limits(depth=1)).services.collect()
    assert sorted(r.cur for r in shallow) == [1, 2]


def test_as_of_keeps_unknown_validity(spark):
    rows = [(101, 1, "Service", 10, [], None, None), (102, 2, "Service", 10, [], 50, None), (103, 3, "Service", 10, [], 10, 40), (104, 4, "Service", 10, [], 10, 45)]
    found = bounded_traversal(roots(spark, 10), edges_of(spark, rows), Limits(), as_of=45).services.collect()
    assert sorted(r.cur for r in found) == [1, 4]


def simulate(edges, start, limits):
    """Queue-based traversal with all bounds: (list of (service, edge ids), list of (code, node, path))."""
    by = {}
    for i, s, k, t, *_ in sorted(edges):
        by.setdefault(t, []).append((i, s, k))
    services, out, warnings, admitted, stopped = {}, [], [], 0, False

    def warn(code, node, path):
        nonlocal stopped
        if (code, node, path) in warnings or stopped:
            return
        if len(warnings) >= limits.warnings - 1:
            warnings.append(("warning-limit-reached", None, ()))
            stopped = True
        else:
            warnings.append((code, node, path))

    # roots are taken one after the other: a root's whole traversal comes before the next root's
    for r in sorted(start):
        if stopped:
            break
        admitted += 1
        if admitted > limits.states:
            warn("traversal-state-limit-reached", r, (r,))
            break
        queue = deque([(r, (r,), (), False)])
        while queue and not stopped:
            cur, nodes, path, terminal = queue.popleft()
            if terminal:
                if cur not in services and len(services) >= limits.ends:
                    warn("service-limit-reached", cur, nodes)
                elif services.get(cur, 0) >= limits.paths_per_end:
                    warn("paths-per-service-limit-reached", cur, nodes)
                elif len(out) >= limits.paths:
                    warn("path-limit-reached", cur, nodes)
                    stopped = True
                else:
                    services[cur] = services.get(cur, 0) + 1
                    out.append((cur, path))
                continue
            hops = by.get(cur, [])
            if len(hops) > limits.fan_out:
                warn("dependents-per-node-limit-reached", cur, nodes)
            deep = False
            for i, s, k in hops[: limits.fan_out]:
                if stopped:
                    break
                if s in nodes:
                    warn("cycle-skipped", s, nodes + (s,))
                elif len(path) >= limits.depth:
                    if not deep:
                        warn("depth-limit-reached", cur, nodes + (s,))
                    deep = True
                else:
                    admitted += 1
                    if admitted > limits.states:
                        warn("traversal-state-limit-reached", s, nodes + (s,))
                        stopped = True
                    else:
                        queue.append((s, nodes + (s,), path + (i,), k == "Service"))
    return out, warnings


@pytest.mark.parametrize("seed", range(8))
def test_bounds_equal_a_queue(spark, seed):
    r = random.Random(seed)
    rows, seen = [], set()
    for i in range(60):
        s, t = r.randrange(1, 16), r.randrange(8, 16)
        if s != t and (s, t) not in seen:
            seen.add((s, t))
            rows.append((1000 + i, s, "Service" if s < 8 else "PackageVersion", t, [1], 0, None))
    limits = Limits(depth=3, fan_out=r.choice([3, 20]), states=r.choice([15, 60, 5000]), ends=r.choice([3, 50]), paths_per_end=r.choice([1, 3]), paths=r.choice([4, 200]), warnings=r.choice([5, 30, 10**6]))
    incidents = {5: [8, 9, 12], 6: [9], 7: [14, 10], 8: [12, 8, 9, 10, 11, 13]}
    named = spark.createDataFrame([(i, r_) for i, rs in incidents.items() for r_ in [*rs, rs[0]]], "incident_id long, root_id long")
    found = bounded_traversal(named, edges_of(spark, rows), limits)
    for incident, start in incidents.items():  # each as its own call would
        services, warnings = simulate(rows, sorted(start), limits)
        assert [(x.cur, tuple(x.edge_ids)) for x in found.services.where(f"incident_id = {incident}").orderBy("ord").collect()] == services
        assert [(x.code, x.node_id, tuple(x.path)) for x in found.warnings.where(f"incident_id = {incident}").orderBy("place").collect()] == warnings


def test_no_level_outgrows_its_run(spark):
    """A root of very many paths in one incident neither costs nor cuts another's."""
    rows = [(s * 100 + t, s, "PackageVersion", t, [1], 0, None) for s in range(10, 22) for t in range(10, 22) if s != t] + [(9000, 1, "Service", 50, [1], 0, None)]
    page = hop_page(edges_of(spark, rows), "target_id", "source_id", 1000)
    states = admitted_states(spark.createDataFrame([(1, 10), (1, 50), (2, 50)], "run long, start_id long"), page, Limits(states=40)).collect()
    assert sorted(x.ord for x in states if x.run == 1) == list(range(1, 42)) and {x.start_id for x in states if x.run == 1} == {10}
    assert [(x.ord, x.cur) for x in sorted(states, key=lambda x: x.ord) if x.run == 2] == [(1, 50), (2, 1)]


def test_odd_roots_and_hops_are_warned_of(spark):
    rows = edges_of(spark, BLAST).withColumn("kind", F.when(F.col("id") == 104, "USED_BY").otherwise("DEPENDS_ON")).withColumn("derived", F.col("id") == 105)
    nodes = spark.createDataFrame([(1, "Service"), (2, "Service"), (10, "PackageVersion"), (11, "PackageVersion")], "id long, kind string")
    found = bounded_traversal(roots(spark, 1, 10, 77), rows, Limits(), nodes=nodes)
    assert sorted((x.cur, x.depth) for x in found.services.collect()) == [(1, 1), (2, 1)]
    said = [(x.code, x.node_id) for x in found.warnings.orderBy("place").collect()]
    assert said == [("unsupported-root-node", 1), ("invalid-canonical-hop", 1), ("invalid-canonical-hop", 10), ("missing-node", 77)] and not found.cut().collect()


def test_confidence_bands(spark):
    """Levels of paths by what backs their edges: exact at and below the threshold, contextual, mixed, missing."""
    known = spark.createDataFrame([(1, "package-lock", 0.85), (2, "package-lock", 0.5), (3, "npm-registry", 0.9), (4, "other", 0.9), (5, "odd", 0.9)], "id long, source_type string, confidence double")
    rows = [("strong", [[1]]), ("probable", [[1], [2]]), ("contextual", [[3], [4]]), ("possible", [[1], [3]]), ("possible2", [[5]]), ("unknown", [[1], [99]]), ("unknown2", [[1, 99]]), ("strong2", [[1, 2, 3]])]
    flat = [(4, 0, k, name, k * 100 + j, ids) for k, (name, edges) in enumerate(rows) for j, ids in enumerate(edges)]
    on_paths = spark.createDataFrame(flat, "incident_id long, root_id long, service_id long, path_key string, edge_id long, evidence_ids array<long>")
    stages = evidence.path_stages(evidence.edge_support(on_paths, known))
    got = {r.path_key: (r.band, r.stage) for r in evidence.strongest_paths(stages).collect()}
    assert {k: v[0] for k, v in got.items()} == {name: name.rstrip("2") for name, _ in rows}
    assert {k for k, v in got.items() if v[1] == "resolved"} == {"strong", "probable", "strong2"}
    cut = spark.createDataFrame([(4,)], "incident_id long")
    assert {r.band for r in evidence.strongest_paths(stages, cut).collect()} == {"unknown"}
    assert "strong" in {r.band for r in evidence.strongest_paths(stages, cut.where("incident_id = 9")).collect()}


def test_authority_fixture(spark):
    A, PKG, ORG, REPO, WF, CRED = 1, 2, 3, 4, 5, 6
    rel = [
        (11, "MAINTAINS", A, "Maintainer", PKG, "Package", [7]),
        (12, "MEMBER_OF", A, "Maintainer", ORG, "Organization", [7]),
        (13, "CONTROLS", A, "Maintainer", CRED, "Credential", [7]),
        (14, "OWNS", ORG, "Organization", REPO, "Repository", [7]),
        (15, "TRIGGERS", REPO, "Repository", WF, "CIWorkflow", [7]),
        (16, "CAN_ACCESS", WF, "CIWorkflow", CRED, "Credential", [7]),
        (17, "CAN_PUBLISH", CRED, "Credential", PKG, "Package", [7]),
        (18, "OWNS", ORG, "Organization", 99, "Credential", [7]),
        (19, "MAINTAINS", A, "Maintainer", 98, "Package", []),
    ]
    edges = spark.createDataFrame(rel, "id long, kind string, source_id long, source_kind string, target_id long, target_kind string, evidence_ids array<long>")
    seeds = spark.createDataFrame([(A, "Maintainer", [7]), (A, "Maintainer", [8]), (50, "Service", [7]), (REPO, "Repository", [])], "seed_id long, seed_kind string, seed_evidence array<long>")
    found = authority_reach(seeds, edges).collect()
    assert sum(r.target_id == PKG for r in found) == 3
    assert {r.seed_id for r in found} == {A} and 98 not in {r.target_id for r in found} and 99 not in {r.target_id for r in found}
    assert all(r.evidence_ids == [7, 8] for r in found)
    assert {r.capability for r in found if r.target_id == PKG} == {"maintain", "publish"}


def test_containment_fixture(spark):
    plan = spark.createDataFrame([("isolate-service", 1, "Service"), ("remove-publishing-access", 17, "CAN_PUBLISH"), ("isolate-service", 10, "PackageVersion")], "action string, target_id long, target_kind string")
    rel = spark.createDataFrame([(17, "CAN_PUBLISH", 6, "Credential", 2, "Package", [7]), (18, "CONTROLS", 1, "Maintainer", 6, "Credential", [7])], "id long, kind string, source_id long, source_kind string, target_id long, target_kind string, evidence_ids array<long>")
    seeds = spark.createDataFrame([(1, "Maintainer", [7])], "seed_id long, seed_kind string, seed_evidence array<long>")
    got = {r.measure: (r.before, r.after, r.removed) for r in containment.simulate(roots(spark, 10), edges_of(spark, BLAST), seeds, rel, plan).collect()}
    assert got["services"] == (2, 1, 1) and got["targets"] == (2, 1, 1) and got["service-paths"] == (3, 1, 2)
    # a run that was cut proves nothing
    cut = containment.simulate(roots(spark, 10), edges_of(spark, BLAST), seeds, rel, plan, Limits(depth=1)).collect()
    assert {(r.removed, r.status) for r in cut} == {(0, "inconclusive")}
    gone = containment.simulate_reach(roots(spark, 10), edges_of(spark, BLAST), plan).collect()
    assert [(r.root_id, r.service_id) for r in gone] == [(10, 1)]
    flags = [(r.action, r.target_id, r.valid) for r in containment.plan_effects(plan).collect()]
    assert sorted(flags) == [("isolate-service", 1, True), ("isolate-service", 10, False), ("remove-publishing-access", 17, True)]
    status = spark.range(1).select(*containment.conclusive(F.lit(True), F.lit(3)), *containment.conclusive(F.lit(False), F.lit(3)), *containment.conclusive(F.lit(False), F.lit(0))).first()
    assert list(status) == ["inconclusive", 0, "simulated-reduction", 3, "no-simulated-reduction", 0]


def test_windows(spark):
    t, h = 1_735_689_600_000, 3_600_000
    cases = [(t, t + 6 * h, "during"), (t, t + h // 2, "outside"), (t + 5 * h, None, "outside"), (None, None, "unknown"), (t, t + h, "during"), (t + 3 * h, None, "during")]
    rows = spark.createDataFrame(cases, "valid_from long, valid_until long, want string")
    got = rows.select("want", temporal.overlap_class(F.col("valid_from"), F.col("valid_until"), F.lit(t + h), F.lit(t + 3 * h)).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    both = spark.range(1).select(temporal.overlap_class(F.lit(t), F.lit(None).cast("long"), F.lit(t + h), F.lit(None).cast("long")).alias("x"), temporal.iso(F.lit(t)).alias("i")).first()
    assert both.x == "during" and both.i == "2025-01-01T00:00:00.000Z"


def test_validity_is_intersection_then_hull(spark):
    rows = [(1, 5, "p", 10, 100), (1, 5, "p", 20, 80), (1, 5, "q", 50, None), (1, 6, "r", None, None), (1, 7, "s", 1, 2)]
    df = spark.createDataFrame(rows, "root_id long, service_id long, path_key string, valid_from long, valid_until long").withColumn("incident_id", F.lit(0))
    got = {r.service_id: (r.opens, r.closes, r.unknown_paths) for r in temporal.service_validity(temporal.path_validity(df)).collect()}
    assert got == {5: (20, None, 0), 6: (None, None, 1), 7: (1, 2, 0)}


def test_snapshots_close(spark):
    rows = [("checkout", "a", 0), ("checkout", "a", 5), ("checkout", "b", 21), ("other", "a", 3)]
    df = spark.createDataFrame(rows, "service_id string, content string, valid_from long")
    history = temporal.close_snapshots(df)
    assert sorted(map(tuple, history.collect()), key=str) == sorted([("checkout", "a", 0, 21, False), ("checkout", "b", 21, None, True), ("other", "a", 3, None, True)], key=str)
    new, late = jobs.supersede(history, spark.createDataFrame([("checkout", "c", 30), ("other", "z", 1)], df.schema))
    assert [r.service_id for r in late.collect()] == ["other"] and sum(r.is_current for r in new.collect()) == 2


def release_fixture(spark):
    node = "id long, kind string, trust string, evidence_ids array<long>"
    chain = lambda ids: [(i, k, "trusted", [1]) for i, k in zip(ids, ("source-change", "workflow-run", "build", "artifact", "release"), strict=True)]
    nodes = chain([1, 2, 3, 4, 5]) + [(10, "source-change", "untrusted", [1]), (11, "workflow-run", "trusted", [1]), (12, "build", "trusted", [1]), (13, "cache-entry", "trusted", [1]), (14, "build", "trusted", [1]), (15, "artifact", "trusted", [1]), (16, "release", "trusted", [1])]
    nodes += [(20, "source-change", "unknown", [1]), (21, "build", "trusted", [1]), (22, "artifact", "trusted", [1]), (23, "release", "trusted", [1]), (30, "release", "trusted", [])]
    e = lambda i, k, s, t, b="same-trust-zone": (i, k, s, t, "trusted", b, [1])
    edges = [e(101, "triggers", 1, 2), e(102, "starts-build", 2, 3), e(103, "produces", 3, 4), e(104, "publishes", 4, 5)]
    edges += [e(111, "triggers", 10, 11), e(112, "starts-build", 11, 12), e(113, "writes-cache", 12, 13, "cross-trust-boundary"), e(114, "restores-cache", 13, 14), e(115, "produces", 14, 15), e(116, "publishes", 15, 16)]
    edges += [e(121, "influences", 20, 21), e(122, "produces", 21, 22), e(123, "publishes", 22, 23)]
    x = spark.createDataFrame(edges, "id long, kind string, source_id long, target_id long, trust string, boundary string, evidence_ids array<long>")
    return spark.createDataFrame(nodes, node), x


def test_release_firewall_fixture(spark):
    n, x = release_fixture(spark)
    got = {r.release_id: r for r in firewall.evaluate(n, x).decisions.collect()}
    assert {k: r.verdict for k, r in got.items()} == {5: "allow", 16: "block", 23: "quarantine", 30: "quarantine"}
    assert got[16].codes == "cross-boundary-cache,untrusted-node" and (got[16].inspected_nodes, got[16].inspected_edges, got[16].risk_paths) == (7, 6, 2)
    assert got[23].codes == "unknown-node" and got[30].codes == "missing-artifact-publication,missing-node-evidence"
    cut = firewall.evaluate(n, x, spark.createDataFrame([(5,)], "release_id long"), firewall.FirewallLimits(depth=1)).decisions.collect()
    assert [(r.verdict, r.truncated, r.codes) for r in cut] == [("quarantine", True, "depth-limit-reached")]
    lenient = firewall.evaluate(n, x, dispositions={"untrusted-node": "quarantine", "cross-boundary-cache": "quarantine"}).decisions
    assert lenient.where("release_id = 16").first().verdict == "quarantine"


def test_release_input_errors(spark):
    """Each of the ten codes, and none of a sound input."""
    n, x = release_fixture(spark)
    asked = spark.createDataFrame([(5,), (16,)], "release_id long")
    assert firewall.input_errors(n, x, asked).count() == 0
    said = lambda *a: {(r.code, r.node_id, r.edge_id) for r in firewall.input_errors(*a).collect()}
    assert said(n, x, asked.where("release_id < 0")) == {("empty-release-set", None, None)}
    assert said(n, x, spark.createDataFrame([(5,), (5,), (77,), (4,)], "release_id long")) == {("duplicate-release-id", 5, None), ("missing-release-node", 77, None), ("wrong-release-node-kind", 4, None)}
    change = lambda df, i, c, v: df.withColumn(c, F.when(F.col("id") == i, v).otherwise(F.col(c)))
    assert said(n.union(n.where("id = 1")), x) == {("duplicate-node-id", 1, None)} and said(n, x.union(x.where("id = 101"))) == {("duplicate-edge-id", None, 101)}
    for column, value in (("kind", F.lit("odd")), ("trust", F.lit(None).cast("string")), ("evidence_ids", F.array(F.lit(-1).cast("long")))):
        assert ("invalid-node", 20, None) in said(change(n, 20, column, value), x)
        assert said(n, change(x, 121, column, value)) == {("invalid-edge", None, 121)}
    for column, value in (("boundary", F.lit("")), ("source_id", F.lit(21).cast("long"))):
        assert said(n, change(x, 121, column, value)) == {("invalid-edge", None, 121)}
    assert said(n, change(x, 121, "source_id", F.lit(777).cast("long"))) == {("missing-edge-endpoint", 777, 121)}
    assert said(n, change(x, 121, "kind", F.lit("publishes"))) == {("invalid-edge-endpoints", None, 121)}


def slow_firewall(nodes, edges, release, limits):
    """One release by a queue: (findings in order, risk paths, inspected nodes, inspected edges)."""
    facts = {i: (trust, proof) for i, _, trust, proof in nodes}
    incoming = {}
    for row in sorted(edges):
        incoming.setdefault(row[3], []).append(row)
    found, risky, keys, seen_nodes, seen_edges = [], [], set(), {release}, set()
    state = {"stop": False, "paths": False}

    def tell(code, node=None, edge=None, path=None):
        if (code, node, edge, path) in keys:
            return
        if len(found) >= limits.findings - 1:
            state["stop"] = True
            if found[-1][0] != "finding-limit-reached":
                found.append(("finding-limit-reached", None, None, None))
            return
        keys.add((code, node, edge, path))
        found.append((code, node, edge, path))
        if path is not None and path not in risky:
            if len(risky) < limits.risk_paths:
                risky.append(path)
            elif not state["paths"]:
                state["paths"] = True
                tell("risk-path-limit-reached")

    if not facts[release][1]:
        tell("missing-node-evidence", release)
    if not any(e[1] == "publishes" for e in incoming.get(release, [])):
        tell("missing-artifact-publication", release)
    queue, admitted = deque([(release, (release,), ())]), 1
    while queue and not state["stop"]:
        cur, path, used = queue.popleft()
        hops = incoming.get(cur, [])
        if len(used) >= limits.depth and hops:
            tell("depth-limit-reached", cur)
            continue
        if len(hops) > limits.fan_in:
            tell("incoming-edge-limit-reached", cur)
        for i, kind, source, _, trust, boundary, proof in hops[: limits.fan_in]:
            if state["stop"]:
                break
            seen_edges.add(i)
            if source in path:
                tell("cycle-skipped", source, i)
                continue
            onward, edges_on = (source, *path), (i, *used)
            key = f"[[{','.join(map(str, onward))}],[{','.join(map(str, edges_on))}]]"
            seen_nodes.add(source)
            if not proof:
                tell("missing-edge-evidence", None, i, key)
            if trust != "trusted":
                tell(f"{trust}-edge", None, i, key)
            if kind.endswith("-cache") and boundary != "same-trust-zone":
                tell("cross-boundary-cache" if boundary.startswith("cross") else "unknown-cache-boundary", None, i, key)
            if not facts[source][1]:
                tell("missing-node-evidence", source, None, key)
            if facts[source][0] != "trusted":
                tell(f"{facts[source][0]}-node", source, None, key)
            if admitted >= limits.states:
                state["stop"] = True
                tell("traversal-state-limit-reached")
                break
            admitted += 1
            queue.append((source, onward, edges_on))
    return found, risky, len(seen_nodes), len(seen_edges)


@pytest.mark.parametrize("seed", range(6))
def test_release_caps_equal_a_queue(spark, seed):
    """Random graphs with cycles under bounds of which each acts in some of them."""
    r = random.Random(seed)
    trust = lambda: r.choice(["trusted", "trusted", "untrusted", "unknown"])
    nodes = [(i, "release" if i < 4 else "build", trust(), [1] if r.random() < 0.7 else []) for i in range(1, 12)]
    edges = []
    for i in range(34):
        s, t = r.randrange(4, 12), r.randrange(1, 12)
        if s != t:
            edges.append((100 + i, r.choice(["publishes", "influences", "writes-cache", "restores-cache"]), s, t, trust(), r.choice(["same-trust-zone", "cross-trust-boundary", "unknown"]), [1] if r.random() < 0.7 else []))
    limits = firewall.FirewallLimits(depth=r.choice([2, 4, 16]), fan_in=r.choice([2, 100]), states=r.choice([6, 40, 10_000]), risk_paths=r.choice([3, 1000]), findings=r.choice([7, 40, 10_000]))
    n = spark.createDataFrame(nodes, "id long, kind string, trust string, evidence_ids array<long>")
    x = spark.createDataFrame(edges, "id long, kind string, source_id long, target_id long, trust string, boundary string, evidence_ids array<long>")
    got = firewall.evaluate(n, x, None, limits)
    findings, paths, decided = got.findings.collect(), got.risk_paths.collect(), {d.release_id: d for d in got.decisions.collect()}
    for release in (1, 2, 3):
        want, risky, n_nodes, n_edges = slow_firewall(nodes, edges, release, limits)
        mine = sorted((f for f in findings if f.release_id == release), key=lambda f: f.place)
        assert [(f.code, f.node_id, f.edge_id, f.path_key) for f in mine] == want
        assert {p.path_key for p in paths if p.release_id == release} == set(risky)
        assert (decided[release].inspected_nodes, decided[release].inspected_edges) == (n_nodes, n_edges)


def test_ladder(spark):
    groups = {k: F.array(F.lit(1)) for k in ("declared", "resolved", "built", "deployed", "network", "executed")}
    assert list(spark.range(1).select(*evidence.ladder(groups)).first()) == [6, "executed", "execution-observed"]
    groups["built"] = F.array().cast("array<int>")
    assert list(spark.range(1).select(*evidence.ladder(groups)).first()) == [2, "resolved", "resolution-observed"]


def test_typosquat_names(spark):
    targets = spark.createDataFrame([(10, "React", 1, None), (11, "react", 2, 5), (20, "express", None, None), (30, "@angular/core", None, None), (40, "is", None, None), (50, "Café", None, None)], "package_id long, name string, rank long, popularity long").withColumn("evidence_ids", F.array("package_id"))
    corpus = typosquat.merge_corpus(targets)
    assert corpus.count() == 5
    seen = ["raect", "exprees", "reactt", "reacct", "@evil/react", "@angular/croe", "reaсt", "reakt", "REACT", "ix", "lodash", "bad name", "re-act"]
    observed = spark.createDataFrame(list(enumerate(seen)), "observed_id long, name string")
    names = typosquat.comparable(observed)
    assert {r.name: r.error for r in typosquat.invalid_names(observed).collect()} == {"bad name": "invalid-character"}
    compared = typosquat.compare(typosquat.candidates(names, corpus), names, corpus).where("accepted")
    got = {}
    for r in compared.collect():
        got.setdefault(seen[r.observed_id], []).append((r.package_id, r.transformations))
    assert set(got) == {"raect", "exprees", "reactt", "reacct", "@evil/react", "@angular/croe", "reaсt", "reakt", "re-act"}
    assert got["raect"] == [(10, ["adjacent-transposition"])]
    assert "scope-impersonation" in dict(got["@evil/react"])[10]
    assert dict(got["@angular/croe"])[30] == ["adjacent-transposition"]
    assert "unicode-confusable" in dict(got["reaсt"])[10] and got["re-act"] == [(10, ["separator-variation"])]
    assert "repeated-character" in dict(got["reactt"])[10]


def test_typosquat_classes(spark):
    corpus = typosquat.merge_corpus(spark.createDataFrame([(10, "react", 1, 1_000_000, [1])], "package_id long, name string, rank long, popularity long, evidence_ids array<long>"))
    names = typosquat.comparable(spark.createDataFrame([(1, "raect"), (2, "reacct"), (3, "reakt"), (4, "reactt")], "observed_id long, name string"))
    compared = typosquat.compare(typosquat.candidates(names, corpus), names, corpus)
    schema = "observed_id long, source string, published_at long, downloads long, scripts int, maintainer_differs boolean, evidence_ids array<long>, contexts array<struct<category:string,evidence_ids:array<long>>>, blocklisted boolean"
    context = spark.createDataFrame(
        [(1, "registry", None, None, 0, False, [5], [], False), (2, "lockfile", None, None, 0, False, [5], [("dependency-graph", [6]), ("provenance", [7])], False), (3, "registry", None, None, 0, False, [5], [], True), (4, "lockfile", None, None, 1, False, [5], [("dependency-graph", [5])], False)], schema
    )
    got = {r.observed_id: (r.classification, r.score) for r in typosquat.score(compared, context, 0).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "candidate", 2: "high-confidence", 3: "suspicious", 4: "suspicious"}
    assert got[1][1] == 30 + 16 and got[2][1] == 30 + 16 + 20 + 12 and got[3][1] == 30 + 24


def test_edit_script_against_recursion():
    def least(a, b):
        if not a or not b:
            return 100 * (len(a) + len(b))
        best = min(least(a[1:], b) + 100, least(a, b[1:]) + 100, least(a[1:], b[1:]) + (0 if a[0] == b[0] else 100))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            best = min(best, least(a[2:], b[2:]) + 75)
        return best

    r = random.Random(1)
    for _ in range(150):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(6))) for _ in range(2))
        assert N.edit_script(a, b)[0] == least(a, b)


def test_identity(spark):
    import hashlib

    ids = ["pkg:npm:café", 'a:"q"\\/', "pkg:npm:x", "Bad:x", " pkg:x", ""]
    rows = spark.createDataFrame([(i,) for i in ids], "v string").select("v", numeric_id(F.col("v")).alias("id"), valid_logical_id(F.col("v")).alias("ok"), edge_logical_id(F.lit("DEPENDS_ON"), F.col("v"), F.lit("b:é")).alias("e"), uri_component(F.col("v")).alias("u")).collect()
    from urllib.parse import quote

    for r in rows:
        assert r.id == int.from_bytes(hashlib.sha256(r.v.encode()).digest()[:8], "big") & (2**53 - 1)
        assert r.e == "rel:" + json.dumps(["edge", "DEPENDS_ON", r.v, "b:é", "default"], ensure_ascii=False, separators=(",", ":"))
        assert r.u == quote(r.v, safe="!'()*-._~")
    assert [r.ok for r in rows] == [True, True, True, False, False, False]


LOCK = {
    "lockfileVersion": 3,
    "packages": {
        "": {"dependencies": {"auth-lib": "2.0.0", "tool": "*"}, "devDependencies": {"auth-lib": "1"}, "optionalDependencies": {"gone": "1"}},
        "node_modules/auth-lib": {"version": "2.0.0", "dependencies": {"bad-lib": "^1.2.0"}, "devDependencies": {"never": "1"}, "peerDependencies": {"bad-lib": "*", "missing-peer": "1"}},
        "node_modules/bad-lib": {"version": "1.2.4"},
        "node_modules/@scope/x": {"version": "1.0.0", "dependencies": {"bad-lib": "1"}},
        "node_modules/@scope/x/node_modules/bad-lib": {"version": "1.0.0"},
        "node_modules/tool": {"link": True, "resolved": "packages/tool", "dev": True},
        "packages/tool": {"version": "0.1.0", "devDependencies": {"bad-lib": "1"}},
    },
}


def test_lockfile_fixture(spark):
    bad = {"lockfileVersion": 3, "packages": {"../x": {"version": "1"}, "node_modules/l": {"link": True, "resolved": "nowhere"}}}
    files = spark.createDataFrame([("svc", json.dumps(LOCK)), ("old", json.dumps({"lockfileVersion": 1, "packages": {}})), ("broken", "{"), ("bad", json.dumps(bad))], "service_id string, content string")
    entries, issues = lockfile.parse(files)
    assert sorted((r.service_id, r.code) for r in issues.collect()) == [("bad", "segment"), ("bad", "unresolved-link"), ("broken", "invalid-document"), ("old", "unsupported-version")]
    assert {r.path: r.name for r in entries.where("service_id = 'svc'").collect()}["node_modules/@scope/x"] == "@scope/x"
    found, lost = lockfile.resolve(entries)
    hits = {(r.path, r.dependency): (r.candidate, r.dependency_type) for r in found.collect()}
    assert hits[("node_modules/auth-lib", "bad-lib")] == ("node_modules/bad-lib", "production")
    assert hits[("node_modules/@scope/x", "bad-lib")] == ("node_modules/@scope/x/node_modules/bad-lib", "production")
    assert hits[("", "auth-lib")] == ("node_modules/auth-lib", "production")
    assert hits[("node_modules/tool", "bad-lib")] == ("node_modules/bad-lib", "development")
    assert sorted((r.dependency, r.severity) for r in lost.collect()) == [("gone", "warning"), ("missing-peer", "warning")]
    assert lockfile.fatal_services(issues, lost).count() == 3


def test_registry_expansion(spark):
    links = [("root", "zeta"), ("root", "alpha"), ("root", "cycle"), ("alpha", "shared"), ("cycle", "root"), ("zeta", "shared"), ("zeta", "fail-package"), ("shared", "leaf")]
    table = spark.createDataFrame(links, "name string, dependency string")
    start = spark.createDataFrame([("root",)], "name string")
    waves, cut = registry_docs.expand(start, table, 3, 100)
    assert not cut and sorted((r.depth, r.name) for r in waves.collect()) == [(0, "root"), (1, "alpha"), (1, "cycle"), (1, "zeta"), (2, "fail-package"), (2, "shared"), (3, "leaf")]
    few, cut = registry_docs.expand(start, table, 3, 3)
    assert cut and sorted(r.name for r in few.collect()) == ["alpha", "cycle", "root"]


def test_merge_and_parity(spark):
    node = "id long, kind string, logical_id string, observed_at long, synthetic boolean, evidence_ids array<long>, published_at long"
    rows = [(1, "PackageVersion", "v:1", 5, True, [3, 1], None), (1, "PackageVersion", "v:1", 9, False, [2], 77), (2, "PackageVersion", "v:2", 1, True, [], 8), (2, "PackageVersion", "v:2", 1, True, [], 9)]
    for order in (rows, rows[::-1]):
        merged, conflicts = merge.merge_nodes(spark.createDataFrame(order, node), ["published_at"])
        first = merged.where("id = 1").first()
        assert (first.evidence_ids, first.observed_at, first.synthetic, first.published_at) == ([1, 2, 3], 9, False, 77)
        assert [(r.id, r.column) for r in conflicts.collect()] == [(2, "published_at")]
    edges = spark.createDataFrame([(1, "rel:a", "DEPENDS_ON", 10, 20), (2, "rel:b", "DEPENDS_ON", 10, 30)], "id long, logical_id string, kind string, source_id long, target_id long")
    reverse = merge.reverse_edges(edges)
    assert merge.parity_violations(edges, reverse).count() == 0
    assert {r.rule for r in merge.parity_violations(edges.where("id = 1"), reverse).collect()} == {"orphan-reverse"}
    assert {r.rule for r in merge.parity_violations(edges, reverse.where("derived_from = 1")).collect()} == {"reverse-count"}


def test_upsert_and_hash(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 5, "old")], "id long, observed_at long, v string")
    new = spark.createDataFrame([(1, 4, "new"), (2, 6, "new"), (3, 1, "new")], old.schema)
    assert sorted((r.id, r.v) for r in merge.upsert(old, new).collect()) == [(1, "old"), (2, "new"), (3, "new")]
    hashed = lambda df: merge.batch_hash(df.select(merge.payload_hash(["id", "v"]).alias("payload_hash"))).first()[0]
    assert hashed(old) == hashed(old.orderBy("v", F.desc("id")).repartition(3)) != hashed(new)


@pytest.mark.parametrize(
    ("version", "text", "want"),
    [("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.3.0", "^0.2.3", False), ("0.0.4", "^0.0.3", False), ("1.2.9", "~1.2.3", True), ("2.3.9", "1.2.3 - 2.3", True), ("1.0.0-b.2", ">=1.0.0-b.1", True), ("1.0.1-b.2", ">=1.0.0-b.1", False), ("3.0.0", ">=1 <2 || >=3", True), ("1.2.3-a", "*", False), ("2.0.0-rc.1", "^1.2.3", False), ("4.9.9", "<=4", True), ("1.2.3", "no range", False)],
)
def test_semver(version, text, want):
    assert satisfies(version, text) is want
    assert (parse_range("no range") is None) and parse_range("1.x || ^2") is not None


def test_streams_go_on_where_they_ended(spark, tmp_path):
    """A second run over the same folder merges new files into the table of the first; nothing lives in the driver alone."""
    def put(name, rows):
        spark.createDataFrame(rows, "service_id long, content string, valid_from long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{name}"))

    def read():
        return spark.readStream.schema("service_id long, content string, valid_from long").parquet(str(tmp_path / "in" / "*"))

    base, other = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    put("one", [(1, "a", 10), (2, "x", 5), (1, "b", 20)])
    jobs.latest_by_key(spark, read(), "service_id", "valid_from", base)
    jobs.supersede_stream(spark, read(), other)
    put("two", [(1, "c", 30), (2, "old", 1), (3, "n", 7)])
    newest = jobs.latest_by_key(spark, read(), "service_id", "valid_from", base)
    assert {tuple(r) for r in newest.collect()} == {(1, "c", 30), (2, "x", 5), (3, "n", 7)}
    history, late = jobs.supersede_stream(spark, read(), other)
    got = sorted((r.service_id, r.content, r.valid_from, r.valid_until) for r in history.collect())
    assert got == [(1, "a", 10, 20), (1, "b", 20, 30), (1, "c", 30, None), (2, "x", 5, None), (3, "n", 7, None)]
    assert [(r.service_id, r.content) for r in late.collect()] == [(2, "old")]
    # no new file: the table stays as it is
    assert jobs.latest_by_key(spark, read(), "service_id", "valid_from", base).count() == 3


def test_job_stream(spark, tmp_path):
    rows = [(1, "signup", 0), (1, "click", 60), (1, "purchase", 120), (1, "error", 180), (2, "signup", 0), (2, "error", 30), (3, "click", 10), (4, "signup", 100_000)]
    spark.createDataFrame(rows, "job_id long, event_type string, s long").selectExpr("job_id", "event_type", "timestamp_seconds(1700000000 + s) AS ts").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("job_id long, event_type string, ts timestamp").parquet(str(tmp_path / "e"))
    changes = jobs.run_to_table(jobs.job_states(stream), "update").collect()
    last = {}
    for r in sorted(changes, key=lambda r: (r.events, r.at)):
        last[r.job_id] = r.status
    assert last[1] == "completed" and last[2] == "failed" and last[3] == "failed" and last[4] == "queued"


def test_path_emphasis(spark):
    """The named path, the first where the name is not one of the service's, nothing for a stranger."""
    paths = spark.createDataFrame([(1, 5, "p1", 1, [1, 5], [10]), (1, 5, "p2", 2, [1, 2, 5], [11, 12]), (2, 5, "p9", 1, [3, 5], [13])], "incident_id long, service_id long, path_key string, ord long, node_ids array<long>, edge_ids array<long>")

    def emphasised(*rows):
        selected = spark.createDataFrame(rows, "incident_id long, service_id long, path_key string")
        return sorted(tuple(r) for r in investigations.path_emphasis(paths, selected).collect())

    first = [(1, 5, "edge", 10), (1, 5, "node", 1), (1, 5, "node", 5)]
    assert emphasised((1, 5, "p2")) == [(1, 5, "edge", 11), (1, 5, "edge", 12), (1, 5, "node", 1), (1, 5, "node", 2), (1, 5, "node", 5)]
    assert emphasised((1, 5, None)) == emphasised((1, 5, "p9")) == emphasised((1, 5, "p1"), (1, 5, "p2")) == first
    assert emphasised((1, 6, "p1"), (3, 5, None)) == []
