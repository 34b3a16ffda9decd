"""Bounds of the registered traversals against the operators' own."""

from tests.test_core import BLAST, edges_of, roots
from tracewright.operators.firewall import FirewallLimits
from tracewright.operators.traverse import Limits, all_paths, path_cuts, reached
from tracewright.plans import releases, traversals


def test_registered_bounds_are_the_operators(spark, sf_dir):
    assert releases.WHOLE == FirewallLimits() and traversals.WHOLE == Limits()
    services = traversals.t1_reached_services(spark, sf_dir)
    assert services.where("depth > 2").count()


def test_every_incident_has_rows(spark, sf_dir):
    """No incident's paths are lost to another's bound."""
    found = traversals.t1_incidents(spark, sf_dir).collect()
    assert len(found) == len({r.incident_id for r in found}) > 5
    assert all(r.paths or r.warnings for r in found)


def test_reached_equals_simple_paths(spark):
    e, r = edges_of(spark, BLAST), roots(spark, 10)
    for depth in (1, 2, 12):
        states = all_paths(r, e, depth, 1000)
        want = {}
        for x in states.collect():
            want[x.cur] = min(x.depth, want.get(x.cur, 99))
        assert {x.cur: x.depth for x in reached(r, e, Limits(depth=depth)).collect()} == want
        deeper = all_paths(r, e, depth + 1, 1000).where(f"depth = {depth + 1}")
        cut = path_cuts(states, r, e, depth, 1000).first()
        assert cut.cut_paths == len({tuple(x.edge_ids[:-1]) for x in deeper.collect()}) and cut.truncated == bool(cut.cut_paths)
