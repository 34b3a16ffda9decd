"""Roots are merged as bits: more of them than a chunk holds, cycles, and no row a root and node before the result."""

from tracewright.operators import traverse
from tracewright.operators.traverse import WORDS, Limits, reached


def test_many_roots_equal_single_ones(spark, monkeypatch):
    n = 64 * WORDS + 70
    rows = [(k, k % n, (k * 7 + 3) % n, "PackageVersion") for k in range(n)] + [(n + k, k, (k * 5 + 1) % n, "PackageVersion") for k in range(n)]
    rows += [(2 * n + k, n + k % 9, k, "Service") for k in range(0, n, 3)]
    edges = spark.createDataFrame(rows, "id long, source_id long, target_id long, source_kind string")
    written = []
    real = traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df: written.append(real(df)) or written[-1])
    found = {(r.root_id, r.cur): (r.depth, r.terminal) for r in reached(spark.range(n).withColumnRenamed("id", "root_id"), edges, Limits(depth=4)).collect()}
    onward = {}
    for _, source, target, kind in rows:
        onward.setdefault(target, []).append((source, kind == "Service"))
    want = {}
    for root in range(n):
        level = {root: False}
        want[root, root] = (0, False)
        for d in range(1, 5):
            step = {s: stop for cur, stopped in level.items() if not stopped for s, stop in onward.get(cur, []) if (root, s) not in want}
            want |= {(root, s): (d, stop) for s, stop in step.items()}
            level = step
    assert found == want
    levels = [df.count() for df in written if "depth" in df.columns]
    assert max(levels) <= 3 * (n + 9)  # chunks of a node, not its roots
