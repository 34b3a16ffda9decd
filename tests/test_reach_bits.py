"""Merged reach: services are in no level, only the ends of edges are written, and two runs are compared by bits."""

from tracewright.operators import containment, traverse
from tracewright.operators.traverse import WORDS, Limits
from tracewright.plans import traversals


def test_levels_hold_no_services(spark, sf_dir, monkeypatch):
    written = []
    real = traverse.materialize
    for module in (traverse, traversals):
        monkeypatch.setattr(module, "materialize", lambda df: written.append(real(df)) or written[-1])
    assert traversals.t1_reached_services(spark, sf_dir).count()
    levels = [df for df in written if "depth" in df.columns]
    assert levels and not any(df.where("cur % 8 = 2").count() for df in levels)
    assert not any("evidence_ids" in df.columns for df in written)


def test_removal_of_many_roots(spark):
    n = 64 * WORDS + 40
    rows = [(k, k % n, (k * 7 + 3) % n, "PackageVersion") for k in range(n)] + [(n + k, n + k % 9, k, "Service") for k in range(0, n, 5)]
    edges = spark.createDataFrame(rows, "id long, source_id long, target_id long, source_kind string")
    plan = spark.createDataFrame([("block-package-version", k, "PackageVersion") for k in range(0, n, 11)] + [("isolate-service", n + 4, "Service"), ("pin-dependency", 1, "DEPENDS_ON")], "action string, target_id long, target_kind string")
    nodes, gone = {*range(0, n, 11), n + 4}, {1}

    def served(roots, kept):
        onward = {}
        for _, source, target, kind in kept:
            onward.setdefault(target, []).append((source, kind == "Service"))
        out = set()
        for root in roots:
            seen, level = {root}, [root]
            for _ in range(6):
                out |= {(root, s) for cur in level for s, stop in onward.get(cur, []) if stop}
                level = [s for s in {s for cur in level for s, stop in onward.get(cur, []) if not stop} if s not in seen]
                seen |= set(level)
        return out

    left = [r for r in rows if r[0] not in gone and r[1] not in nodes and r[2] not in nodes]
    want = served(range(n), rows) - served([k for k in range(n) if k not in nodes], left)
    found = containment.simulate_reach(spark.range(n).withColumnRenamed("id", "root_id"), edges, plan, Limits(depth=6))
    assert {(r.root_id, r.service_id) for r in found.collect()} == want and want
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row a root and service but those of the result
