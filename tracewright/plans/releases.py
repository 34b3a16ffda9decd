"""Registered release-firewall queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import firewall
from ..operators.firewall import DISPOSITIONS, NODE_KINDS, RELATIONS, TRUNCATING, FirewallLimits
from ..session import materialize
from ..sources.derived import Graph
from .graph_sql import query

#: The operator's own bounds; and tight ones, each of which cuts something of the derived releases.
WHOLE = FirewallLimits()
TIGHT = FirewallLimits(depth=4, fan_in=1, states=5, risk_paths=2, findings=6)
RELEASES = """
lines AS (SELECT *, (l_orderkey * 64 + nth) * 2 AS node, CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 'untrusted' WHEN l_returnflag = 'N' AND l_quantity <= 2 THEN 'unknown' ELSE 'trusted' END AS trust,
    CASE WHEN l_tax > 0.075 THEN []::BIGINT[] ELSE [l_suppkey] END AS proof, CASE WHEN l_linestatus = 'O' AND l_discount > 0.085 THEN 'cross-trust-boundary' ELSE 'same-trust-zone' END AS boundary
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem)),
chained AS (SELECT *, lead(node) OVER (PARTITION BY l_orderkey ORDER BY nth) AS next, lead(node, 2) OVER (PARTITION BY l_orderkey ORDER BY nth) AS second FROM lines),
r_nodes AS (SELECT o_orderkey * 2 + 1 AS id, 'release' AS kind, 'trusted' AS trust, CASE WHEN o_orderpriority = '1-URGENT' THEN []::BIGINT[] ELSE [o_custkey] END AS evidence_ids FROM orders
  UNION ALL SELECT node, CASE WHEN nth % 2 = 0 THEN 'cache-entry' ELSE 'build' END, trust, proof FROM lines),
r_edges AS (SELECT node * 4 AS id, CASE WHEN nth % 2 = 0 THEN 'restores-cache' ELSE 'writes-cache' END AS kind, node AS source_id, next AS target_id, trust, boundary, proof AS evidence_ids FROM chained WHERE next IS NOT NULL
  UNION ALL SELECT node * 4 + 1, 'influences', node, second, trust, boundary, proof FROM chained WHERE second IS NOT NULL AND nth % 3 = 1
  UNION ALL SELECT node * 4 + 2, 'publishes', node, l_orderkey * 2 + 1, trust, boundary, proof FROM chained JOIN orders ON l_orderkey = o_orderkey WHERE next IS NULL AND o_orderstatus <> 'P')
"""
#: What the capped queries walk besides: every sixth line is influenced by the one three places on, which closes a cycle.
LOOPS = "r_loops AS (SELECT * FROM r_edges UNION ALL SELECT node * 4 + 3, 'influences', third, node, trust, 'unknown', proof FROM (SELECT *, lead(node, 3) OVER (PARTITION BY l_orderkey ORDER BY nth) AS third FROM lines) WHERE third IS NOT NULL AND l_suppkey % 6 = 0)"
_SEVERITY = "CASE code " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in DISPOSITIONS.items()) + " END"
_LIST = lambda values: ", ".join(f"'{v}'" for v in values)


def evaluated(limits: FirewallLimits, edges: str = "r_edges") -> str:
    """CTEs `kept` (findings), `risk` (paths) and `decided` (verdicts) of all releases under the limits."""
    n, most = limits.states, limits.findings
    return f"""
r_page AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY id, source_id) AS hop, count(*) OVER (PARTITION BY target_id) AS width FROM {edges} QUALIFY hop <= {limits.fan_in}),
r_walk(release_id, cur, depth, node_ids, edge_ids, hop) AS (
  SELECT id, id, 0, [id], []::BIGINT[], 0::BIGINT FROM r_nodes WHERE kind = 'release'
  UNION ALL
  SELECT s.release_id, e.source_id, s.depth + 1, list_append(s.node_ids, e.source_id), list_append(s.edge_ids, e.id), e.hop FROM r_walk s JOIN r_page e ON e.target_id = s.cur WHERE s.depth < {limits.depth} AND NOT list_contains(s.node_ids, e.source_id)),
r_ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY depth, edge_ids) AS ord FROM r_walk) WHERE ord <= {n + 1}),
r_heads AS (SELECT c.release_id, p.ord, c.hop, c.ord AS own, c.cur AS node_id, c.edge_ids[-1] AS edge_id, '[[' || array_to_string(list_reverse(c.node_ids), ',') || '],[' || array_to_string(list_reverse(c.edge_ids), ',') || ']]' AS path_key
  FROM r_ranked c JOIN r_ranked p ON p.release_id = c.release_id AND p.depth = c.depth - 1 AND p.edge_ids = c.edge_ids[:c.depth - 1] WHERE c.depth > 0),
r_last AS (SELECT release_id, ord AS last, hop AS last_hop FROM r_heads WHERE own = {n + 1}),
r_looked AS (SELECT s.*, last, last_hop FROM r_ranked s LEFT JOIN r_last USING (release_id) WHERE ord <= {n} AND (last IS NULL OR ord <= last)),
r_cycles AS (SELECT s.release_id, s.ord, e.hop, e.source_id AS node_id, e.id AS edge_id FROM r_looked s JOIN r_page e ON e.target_id = s.cur WHERE s.depth < {limits.depth} AND list_contains(s.node_ids, e.source_id) AND (last IS NULL OR s.ord < last OR e.hop < last_hop)),
r_tests AS (SELECT h.*, e.kind, e.trust AS edge_trust, e.boundary, len(e.evidence_ids) AS edge_proof, v.trust AS node_trust, len(v.evidence_ids) AS node_proof FROM r_heads h JOIN {edges} e ON e.id = h.edge_id JOIN r_nodes v ON v.id = h.node_id),
r_found AS (SELECT release_id, code, CASE WHEN slot >= 4 THEN node_id END AS node_id, CASE WHEN slot < 4 THEN edge_id END AS edge_id, path_key, ord, hop, slot FROM (
  SELECT *, 'missing-edge-evidence' AS code, 1 AS slot FROM r_tests WHERE edge_proof = 0
  UNION ALL SELECT *, edge_trust || '-edge', 2 FROM r_tests WHERE edge_trust <> 'trusted'
  UNION ALL SELECT *, 'cross-boundary-cache', 3 FROM r_tests WHERE kind IN ('writes-cache', 'restores-cache') AND boundary = 'cross-trust-boundary'
  UNION ALL SELECT *, 'unknown-cache-boundary', 3 FROM r_tests WHERE kind IN ('writes-cache', 'restores-cache') AND boundary = 'unknown'
  UNION ALL SELECT *, 'missing-node-evidence', 4 FROM r_tests WHERE node_proof = 0
  UNION ALL SELECT *, node_trust || '-node', 5 FROM r_tests WHERE node_trust <> 'trusted')),
r_risky AS (SELECT release_id, ord, hop, min(slot) AS slot FROM r_found GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY ord, hop) = {limits.risk_paths + 1}),
r_events AS (
  SELECT release_id, code, node_id, edge_id, path_key, ord, hop, slot * 2 AS slot FROM r_found
  UNION ALL SELECT release_id, 'risk-path-limit-reached', NULL, NULL, NULL, ord, hop, slot * 2 + 1 FROM r_risky
  UNION ALL SELECT release_id, 'cycle-skipped', node_id, edge_id, NULL, ord, hop, 0 FROM r_cycles
  UNION ALL SELECT release_id, 'depth-limit-reached', cur, NULL, NULL, ord, 0, 0 FROM r_looked WHERE depth = {limits.depth} AND cur IN (SELECT target_id FROM r_page)
  UNION ALL SELECT release_id, 'incoming-edge-limit-reached', cur, NULL, NULL, ord, 0, 0 FROM r_looked WHERE depth < {limits.depth} AND cur IN (SELECT target_id FROM r_page WHERE width > {limits.fan_in})
  UNION ALL SELECT id, 'missing-node-evidence', id, NULL, NULL, 0, 0, 0 FROM r_nodes WHERE kind = 'release' AND len(evidence_ids) = 0
  UNION ALL SELECT id, 'missing-artifact-publication', id, NULL, NULL, 0, 0, 1 FROM r_nodes WHERE kind = 'release' AND id NOT IN (SELECT target_id FROM r_edges WHERE kind = 'publishes')
  UNION ALL SELECT release_id, 'traversal-state-limit-reached', NULL, NULL, NULL, last, last_hop, 20 FROM r_last),
r_once AS (SELECT * FROM r_events QUALIFY row_number() OVER (PARTITION BY release_id, code, node_id, edge_id, path_key ORDER BY ord, hop, slot) = 1),
r_placed AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY ord, hop, slot, code, node_id, edge_id) AS place FROM r_once QUALIFY place <= {most}),
kept AS (SELECT *, {_SEVERITY} AS severity FROM (SELECT release_id, CASE WHEN place = {most} THEN 'finding-limit-reached' ELSE code END AS code, CASE WHEN place < {most} THEN node_id END AS node_id, CASE WHEN place < {most} THEN edge_id END AS edge_id, CASE WHEN place < {most} THEN path_key END AS path_key, place, ord, hop FROM r_placed)),
risk AS (SELECT release_id, path_key FROM kept WHERE path_key IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY min(place)) <= {limits.risk_paths}),
r_seen AS (SELECT s.* FROM (SELECT release_id, ord, hop, node_id, edge_id FROM r_heads UNION ALL SELECT release_id, ord, hop, NULL, edge_id FROM r_cycles) s LEFT JOIN (SELECT release_id, ord, hop FROM kept WHERE code = 'finding-limit-reached') x ON x.release_id = s.release_id WHERE x.ord IS NULL OR s.ord < x.ord OR (s.ord = x.ord AND s.hop <= x.hop)),
decided AS (SELECT id AS release_id, CASE WHEN blocking > 0 THEN 'block' WHEN cut OR quarantining > 0 THEN 'quarantine' ELSE 'allow' END AS verdict, coalesce(blocking, 0) AS blocking, coalesce(quarantining, 0) AS quarantining, coalesce(warnings, 0) AS warnings,
    coalesce(codes, '') AS codes, coalesce(nodes, 0) + 1 AS inspected_nodes, coalesce(seen, 0) AS inspected_edges, coalesce(paths, 0) AS risk_paths, coalesce(cut, false) AS truncated
  FROM (SELECT id FROM r_nodes WHERE kind = 'release')
  LEFT JOIN (SELECT release_id, count(*) FILTER (severity = 'block') AS blocking, count(*) FILTER (severity = 'quarantine') AS quarantining, count(*) FILTER (severity = 'warning') AS warnings, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, bool_or(code IN ({_LIST(TRUNCATING)})) AS cut FROM kept GROUP BY 1) k ON k.release_id = id
  LEFT JOIN (SELECT release_id, count(DISTINCT node_id) AS nodes, count(DISTINCT edge_id) AS seen FROM r_seen GROUP BY 1) s ON s.release_id = id
  LEFT JOIN (SELECT release_id, count(*) AS paths FROM risk GROUP BY 1) r ON r.release_id = id)
"""


def _evaluated(spark: SparkSession, sf_dir: str, limits: FirewallLimits = WHOLE, loops: bool = False) -> firewall.Evaluation:
    g = Graph(spark, sf_dir)
    return firewall.evaluate(materialize(g.release_nodes()), materialize(g.release_edges(loops)), None, limits)


def t3_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).findings


def t3_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).decisions


def t3_risk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of every release that a finding lies on."""
    return _evaluated(spark, sf_dir).risk_paths.select("release_id", "path_key")


def t3_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tight bounds and cycles make of every release, by code."""
    found = _evaluated(spark, sf_dir, TIGHT, True).findings.where(F.col("code").isin("cycle-skipped", *TRUNCATING))
    return found.select("release_id", "code", "node_id", "edge_id", "place")


def t3_capped_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, TIGHT, True).decisions


def a12_firewall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firewall.summary(t3_decisions(spark, sf_dir))


def t3_input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a spoilt input by code: odd kinds, trusts, boundaries, ids, links to themselves and to nothing, repeated rows, releases that are none."""
    g = Graph(spark, sf_dir)
    nodes, edges = g.release_nodes(), g.release_edges()
    odd = F.when(F.col("id") % 22 == 0, "odd").otherwise(F.col("trust"))
    nodes = nodes.withColumn("trust", odd).withColumn("id", F.when(F.col("id") % 2002 == 0, -F.col("id")).otherwise(F.col("id")))
    nodes = nodes.unionByName(nodes.where("id % 26 = 1"))
    edges = edges.withColumn("target_id", F.when(F.col("id") % 17 == 0, F.col("source_id")).otherwise(F.col("target_id"))).withColumn("boundary", F.when(F.col("id") % 19 == 0, "odd").otherwise(F.col("boundary")))
    edges = edges.unionByName(edges.where("id % 29 = 0"))
    asked = g.release_nodes().where("id % 10 = 1").select(F.explode(F.array(F.col("id"), F.col("id"), F.col("id") + 1, F.col("id") * 64)).alias("release_id"))
    return firewall.input_errors(nodes, edges, asked).groupBy("code").agg(F.count("*").alias("n"), F.sum("node_id").cast("long").alias("nodes"), F.sum("edge_id").cast("long").alias("edges"))


QUERIES = {f.__name__: f for f in (t3_findings, t3_decisions, t3_risk_paths, t3_warnings, t3_capped_decisions, a12_firewall_summary, t3_input_errors)}
_FITS = " OR ".join(f"(e.kind = '{k}' AND a.kind IN ({_LIST(s)}) AND b.kind IN ({_LIST(t)}))" for k, (s, t) in RELATIONS.items())
ORACLES = {
    "t3_findings": query(RELEASES, evaluated(WHOLE), select="SELECT release_id, code, severity, node_id, edge_id, path_key, place FROM kept"),
    "t3_decisions": query(RELEASES, evaluated(WHOLE), select="SELECT * FROM decided"),
    "t3_risk_paths": query(RELEASES, evaluated(WHOLE), select="SELECT * FROM risk"),
    "t3_warnings": query(RELEASES, LOOPS, evaluated(TIGHT, "r_loops"), select=f"SELECT release_id, code, node_id, edge_id, place FROM kept WHERE code IN ('cycle-skipped', {_LIST(TRUNCATING)})"),
    "t3_capped_decisions": query(RELEASES, LOOPS, evaluated(TIGHT, "r_loops"), select="SELECT * FROM decided"),
    "a12_firewall_summary": query(RELEASES, evaluated(WHOLE), select="SELECT count(*) AS evaluated, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'quarantine') AS quarantined, count(*) FILTER (verdict = 'block') AS blocked, count(*) FILTER (truncated) AS truncated FROM decided"),
    "t3_input_errors": query(
        RELEASES,
        f"""n0 AS (SELECT CASE WHEN id % 2002 = 0 THEN -id ELSE id END AS id, kind, CASE WHEN id % 22 = 0 THEN 'odd' ELSE trust END AS trust FROM r_nodes), n1 AS (SELECT * FROM n0 UNION ALL SELECT * FROM n0 WHERE id % 26 = 1),
        e0 AS (SELECT id, kind, source_id, CASE WHEN id % 17 = 0 THEN source_id ELSE target_id END AS target_id, trust, CASE WHEN id % 19 = 0 THEN 'odd' ELSE boundary END AS boundary FROM r_edges), e1 AS (SELECT * FROM e0 UNION ALL SELECT * FROM e0 WHERE id % 29 = 0),
        asked AS (SELECT unnest([id, id, id + 1, id * 64]) AS id FROM r_nodes WHERE kind = 'release' AND id % 10 = 1),
        good_n AS (SELECT * FROM n1 WHERE id >= 0 AND trust <> 'odd' AND kind IN ({_LIST(NODE_KINDS)})), good_e AS (SELECT * FROM e1 WHERE source_id <> target_id AND boundary <> 'odd'),
        known AS (SELECT id, min(kind) AS kind FROM good_n GROUP BY 1), wanted AS (SELECT id, count(*) AS n FROM asked GROUP BY 1),
        faults AS (SELECT 'invalid-node' AS code, id AS node_id, NULL::BIGINT AS edge_id FROM n1 WHERE id < 0 OR trust = 'odd' UNION ALL SELECT 'invalid-edge', NULL, id FROM e1 WHERE source_id = target_id OR boundary = 'odd'
          UNION ALL SELECT 'duplicate-node-id', id, NULL FROM good_n GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'duplicate-edge-id', NULL, id FROM good_e GROUP BY 3 HAVING count(*) > 1
          UNION ALL SELECT 'missing-edge-endpoint', CASE WHEN a.id IS NULL THEN e.source_id ELSE e.target_id END, e.id FROM good_e e LEFT JOIN known a ON a.id = e.source_id LEFT JOIN known b ON b.id = e.target_id WHERE a.id IS NULL OR b.id IS NULL
          UNION ALL SELECT 'invalid-edge-endpoints', NULL, e.id FROM good_e e JOIN known a ON a.id = e.source_id JOIN known b ON b.id = e.target_id WHERE NOT ({_FITS})
          UNION ALL SELECT 'duplicate-release-id', id, NULL FROM wanted WHERE n > 1 UNION ALL SELECT 'missing-release-node', id, NULL FROM wanted WHERE id NOT IN (SELECT id FROM known)
          UNION ALL SELECT 'wrong-release-node-kind', w.id, NULL FROM wanted w JOIN known k ON k.id = w.id WHERE k.kind <> 'release')""",
        select="SELECT code, count(*) AS n, sum(node_id)::BIGINT AS nodes, sum(edge_id)::BIGINT AS edges FROM faults GROUP BY 1",
    ),
}
