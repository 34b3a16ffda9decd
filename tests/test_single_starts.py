"""Runs of one start: the same states as the general walk, and the release graph is read once."""

import random

import pytest

from tracewright.operators.traverse import Limits, admitted_states, hop_lists, hop_page, single_start_states
from tracewright.sources.derived import Graph


@pytest.mark.parametrize("bound", [5, 10_000])
def test_states_equal_the_general_walk(spark, bound):
    r = random.Random(bound)
    edges = spark.createDataFrame([(k, r.randrange(12), r.randrange(12)) for k in range(40)], "id long, source_id long, target_id long")
    starts = spark.createDataFrame([(k, k) for k in range(6)], "run long, start_id long")
    page, limits = hop_page(edges, "target_id", "source_id", 4), Limits(depth=4, fan_out=4, states=bound)
    shown = ["run", "cur", "depth", "node_ids", "edge_ids", "ord", "parent", "hop"]
    hops = hop_lists(page)
    got = {tuple(map(str, x)) for x in single_start_states(starts, hops, limits).select(shown).collect()}
    hops.unpersist()
    assert got == {tuple(map(str, x)) for x in admitted_states(starts, page, limits).select(shown).collect()}


def test_lines_are_read_once(spark, sf_dir):
    plan = Graph(spark, sf_dir).release_edges(True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
