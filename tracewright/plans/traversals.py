"""Registered traversal, evidence, temporal and containment queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import containment, evidence, temporal
from ..operators.traverse import AUTHORITY_LIMITS, Limits, Traversal, all_paths, authority_traversal, bounded_traversal, cut_nodes, path_cuts, reached
from ..session import materialize
from ..sources.derived import Graph
from .graph_sql import AUTHORITY, CUT, GRAPH, bounded, query, reach, states

#: The operators' own bounds hold for every registered traversal. LIMITS are tighter ones, to show what each of them cuts.
WHOLE = Limits()
LIMITS = Limits(depth=3, fan_out=40, states=5000, ends=60, paths_per_end=3, paths=100, warnings=400)
#: All simple paths of so many hops, without a bound on their number.
DEPTH, FAN_OUT = 2, 1000
TIGHT = Limits(depth=3, fan_out=3, states=60, ends=40, paths_per_end=2, paths=1 << 40)
AS_OF = 800_000_000_000
_joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
STATES = bounded(WHOLE)


def _traversal(g: Graph, edges: DataFrame | None = None, limits: Limits = WHOLE, as_of: int | None = None) -> Traversal:
    return bounded_traversal(g.incident_versions(), edges if edges is not None else materialize(g.depends_on()), limits, as_of)


def _on_paths(g: Graph) -> DataFrame:
    edges = materialize(g.depends_on())
    return evidence.path_edges(evidence.keyed(_traversal(g, edges).services), edges)


def t1_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that reach a version that an incident affects, by the paths that the operator's own bounds let through for that incident."""
    found = _traversal(Graph(spark, sf_dir)).services
    return evidence.keyed(found).select("incident_id", "root_id", "service_id", F.col("depth").cast("long").alias("depth"), "path_key")


def t1_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per incident what its traversal returned and whether, where and by which bound it ended."""
    found = _traversal(Graph(spark, sf_dir))
    served = found.services.groupBy("incident_id").agg(F.count("*").alias("paths"), F.count_distinct("cur").alias("services"), F.count_distinct("root_id").alias("roots"), F.max("ord").alias("last_state"))
    said = found.warnings.groupBy("incident_id").agg(F.count("*").alias("warnings"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return served.join(said, "incident_id", "full").join(found.cut().withColumn("cut", F.lit(True)), "incident_id", "left").na.fill(False, ["cut"])


def t1_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the traversals warn of; among the roots of three incidents are a service and an unknown node."""
    g = Graph(spark, sf_dir)
    nodes = g.versions().select("id", F.lit("PackageVersion").alias("kind")).unionByName(g.services().select("id", F.lit("Service").alias("kind")))
    odd = g.incidents().where("id < 30").select(F.col("id").alias("incident_id"), F.explode(F.array(F.lit(3).cast("long"), F.lit(10).cast("long"))).alias("root_id"))
    found = bounded_traversal(g.incident_versions().unionByName(odd), materialize(g.depends_on()), WHOLE, nodes=nodes)
    return found.warnings.select("incident_id", "code", "node_id", _joined("path").alias("path"), "place")


def t1_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that reach a version of the largest size within two hops, by every simple path."""
    g = Graph(spark, sf_dir)
    found = all_paths(g.largest_versions(), materialize(g.depends_on()), DEPTH, FAN_OUT).withColumn("incident_id", F.lit(0))
    return evidence.keyed(found).select("root_id", "service_id", F.col("depth").cast("long").alias("depth"), "path_key")


def t1_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _traversal(Graph(spark, sf_dir), as_of=AS_OF)
    return evidence.keyed(found.services).groupBy("incident_id", "root_id").agg(F.count("*").alias("path_count"), F.count_distinct("service_id").alias("service_count"))


def t1_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services under tight bounds."""
    found = _traversal(Graph(spark, sf_dir), limits=LIMITS).services
    return found.select("incident_id", "root_id", F.col("cur").alias("service_id"), "ord", _joined("edge_ids").alias("edge_ids"))


def t1_capped_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tight bounds cut, by incident and code."""
    return _traversal(Graph(spark, sf_dir), limits=LIMITS).warnings.groupBy("incident_id", "code").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def t1_reached_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that reach a version of the largest size within the operator's own bounds, with their fewest hops."""
    g = Graph(spark, sf_dir)
    found = reached(g.largest_versions(), g.dependency_ends(), WHOLE).where("terminal")
    return found.select("root_id", F.col("cur").alias("service_id"), F.col("depth").cast("long").alias("depth"))


def t1_path_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per version of the largest size, what a bound of two hops cuts."""
    g = Graph(spark, sf_dir)
    edges = materialize(g.depends_on())
    return path_cuts(all_paths(g.largest_versions(), edges, DEPTH, FAN_OUT), g.largest_versions(), edges, DEPTH, FAN_OUT)


def t1_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions whose dependents exceed a page of 25."""
    return cut_nodes(Graph(spark, sf_dir).depends_on(), "target_id", 25)


def t2_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    found = authority_traversal(g.authority_seeds(), materialize(g.authority())).services
    return found.select("incident_id", "seed_id", "target_id", F.col("depth").cast("long").alias("depth"), "capability", _joined("edge_ids").alias("edge_ids"), _joined("evidence_ids").alias("evidence_ids"))


def t2_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the authority traversal warns of under tight bounds."""
    g = Graph(spark, sf_dir)
    found = authority_traversal(g.authority_seeds(), materialize(g.authority()), TIGHT)
    return found.warnings.select("incident_id", "code", "node_id", _joined("path").alias("path"), "place")


def a1_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return evidence.funnel(evidence.path_stages(evidence.edge_support(_on_paths(g), g.evidence())))


def a3_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return evidence.source_summary(_on_paths(g).select("incident_id", F.explode("evidence_ids").alias("evidence_id")), g.evidence())


def a4_lookup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return evidence.lookup_summary(_on_paths(g).select("incident_id", F.explode("evidence_ids").alias("evidence_id")), g.evidence(), 100)


def p3_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return evidence.catalog(_on_paths(g).select("incident_id", F.explode("evidence_ids").alias("evidence_id")), g.evidence())


def a7_strongest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return evidence.strongest_paths(evidence.path_stages(evidence.edge_support(_on_paths(g), g.evidence())))


def a10_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.selection_summary(_on_paths(Graph(spark, sf_dir)))


def a5_service_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.service_validity(temporal.path_validity(_on_paths(Graph(spark, sf_dir))))


def a6_incident_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return temporal.incident_partition(temporal.service_validity(temporal.path_validity(_on_paths(g))), g.incidents())


def j9_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of versions that an incident affects, by overlap with its interval."""
    g = Graph(spark, sf_dir)
    named = g.affects().join(g.incidents().withColumnRenamed("id", "incident_id"), "incident_id").withColumnRenamed("version_id", "target_id")
    joined = temporal.interval_join(g.depends_on().select("target_id", "valid_from", "valid_until"), named, ["target_id"])
    return joined.groupBy("incident_id", "overlap").agg(F.count("*").alias("edge_count"))


def _plan(g: Graph) -> DataFrame:
    customer, part = g.table("customer"), g.table("part")
    isolate = customer.where("c_mktsegment = 'BUILDING'").select(F.lit("isolate-service").alias("action"), (F.col("c_custkey") * 8 + 2).alias("target_id"), F.lit("Service").alias("target_kind"))
    block = part.where("p_size = 49").select(F.lit("block-package-version").alias("action"), (F.col("p_partkey") * 8 + 1).alias("target_id"), F.lit("PackageVersion").alias("target_kind"))
    wrong = part.where("p_size = 48").select(F.lit("isolate-service").alias("action"), (F.col("p_partkey") * 8 + 1).alias("target_id"), F.lit("PackageVersion").alias("target_kind"))
    access = g.authority().where("kind = 'CAN_PUBLISH' AND size(evidence_ids) = 1").select(F.lit("remove-publishing-access").alias("action"), F.col("id").alias("target_id"), F.lit("CAN_PUBLISH").alias("target_kind"))
    return isolate.unionByName(block).unionByName(wrong).unionByName(access)


def t4_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's effect under the operators' own bounds; a run that these cut proves nothing."""
    g = Graph(spark, sf_dir)
    return containment.simulate(g.incident_versions(), materialize(g.depends_on()), g.authority_seeds(), materialize(g.authority()), materialize(_plan(g)))


def t4_small_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's effect where no run is cut: services that depend on an affected version themselves."""
    g = Graph(spark, sf_dir)
    edges = materialize(g.depends_on().where("source_kind = 'Service'"))
    wide = Limits(states=10**7, ends=10**7, paths_per_end=10**7, paths=10**7, warnings=10**7)
    every = Limits(depth=40, fan_out=10**6, states=10**7, ends=10**7, paths_per_end=10**7, paths=10**7, warnings=10**7)
    return containment.simulate(g.incident_versions(), edges, g.authority_seeds(), materialize(g.authority()), materialize(_plan(g)), wide, every)


def t4_out_of_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that the plan takes out of an affected version's reach, whatever the number of paths."""
    g = Graph(spark, sf_dir)
    return containment.simulate_reach(g.largest_versions(), g.dependency_ends(), materialize(_plan(g)), WHOLE)


SUPPORT = """
support AS (SELECT p.incident_id, p.root_id, p.service_id, p.path_key, u.edge_id, max(v.confidence) AS best, max(v.confidence) FILTER (v.source_type IN ('package-lock', 'cyclonedx', 'spdx', 'synthetic-fixture')) AS best_exact,
    count(*) FILTER (v.id IS NULL) AS missing, bool_and(v.source_type IN ('npm-registry', 'package-manifest', 'security-advisory', 'other')) FILTER (v.id IS NOT NULL) AS contextual
  FROM paths p, unnest(p.edge_ids) u(edge_id) JOIN edges e ON e.id = u.edge_id, unnest(e.evidence_ids) x(evidence_id) LEFT JOIN evidence v ON v.id = x.evidence_id GROUP BY 1, 2, 3, 4, 5),
stages AS (SELECT incident_id, root_id, service_id, path_key, bool_and(best IS NOT NULL) AS verified, bool_and(coalesce(best >= 0.8, false)) AS high, bool_and(best_exact IS NOT NULL) AS exact, min(coalesce(best_exact, 0)) AS exact_confidence,
  sum(missing) = 0 AS complete, bool_and(coalesce(contextual, true)) AS contextual FROM support GROUP BY 1, 2, 3, 4)
"""
CUT_RUNS = f"cut_runs AS (SELECT DISTINCT incident_id FROM said WHERE {CUT})"


def judged(whole: str = "true") -> str:
    """CTEs `judged` (stage and level of every path) and `strongest` (of every service of an incident)."""
    return f"""judged AS (SELECT *, CASE WHEN {whole} AND complete AND verified AND exact THEN 'resolved' ELSE 'candidate' END AS stage,
  CASE WHEN NOT ({whole} AND complete) THEN 'unknown' WHEN verified AND exact AND exact_confidence >= 0.8 THEN 'strong' WHEN verified AND exact THEN 'probable' WHEN verified AND contextual THEN 'contextual' WHEN verified THEN 'possible' ELSE 'unknown' END AS band FROM stages),
strongest AS (SELECT j.*, count(*) OVER (PARTITION BY incident_id, service_id) AS path_count, count(*) FILTER (stage = 'resolved') OVER (PARTITION BY incident_id, service_id) AS resolved_paths FROM judged j
  QUALIFY row_number() OVER (PARTITION BY incident_id, service_id ORDER BY stage DESC, list_position(['unknown', 'contextual', 'possible', 'probable', 'strong'], band) DESC, path_key) = 1)"""


ON_PATHS = "on_paths AS (SELECT p.incident_id, p.root_id, p.service_id, p.path_key, e.* FROM paths p, unnest(p.edge_ids) u(edge_id) JOIN edges e ON e.id = u.edge_id)"
CITED = "cited AS (SELECT DISTINCT incident_id, unnest(evidence_ids) AS evidence_id FROM on_paths)"
VALIDITY = """
path_validity AS (SELECT incident_id, service_id, path_key, max(valid_from) AS opens, min(valid_until) FILTER (valid_from IS NOT NULL) AS closes FROM on_paths GROUP BY incident_id, root_id, service_id, path_key),
validity AS (SELECT incident_id, service_id, min(opens) AS opens, CASE WHEN coalesce(bool_or(opens IS NOT NULL AND closes IS NULL), false) THEN NULL ELSE max(closes) FILTER (opens IS NOT NULL) END AS closes,
  count(*) FILTER (opens IS NULL) AS unknown_paths, count(*) AS path_count FROM path_validity GROUP BY 1, 2),
classed AS (SELECT v.*, CASE WHEN opens IS NULL THEN 'unknown' WHEN greatest(opens, interval_start) <= least(coalesce(closes, 9223372036854775807), coalesce(interval_end, 9223372036854775807)) THEN 'during' WHEN interval_start IS NULL THEN NULL ELSE 'outside' END AS overlap
  FROM validity v LEFT JOIN incidents i ON i.id = v.incident_id)
"""
QUERIES = {
    f.__name__: f
    for f in (
        t1_blast_radius, t1_incidents, t1_warnings, t1_two_hops, t1_as_of, t1_capped, t1_capped_warnings, t1_reached_services, t1_path_cuts, t1_truncation, t2_authority, t2_warnings, a1_funnel, a3_source_summary, a4_lookup_summary, p3_catalog,
        a7_strongest_paths, a10_selection, a5_service_validity, a6_incident_partition, j9_overlap, t4_containment, t4_small_containment, t4_out_of_reach,
    )
}
_PLAN_NODES = "plan_nodes AS (SELECT c_custkey * 8 + 2 AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT p_partkey * 8 + 1 FROM part WHERE p_size = 49)"
_PLAN = f"""{_PLAN_NODES},
open_roots AS (SELECT * FROM incident_roots WHERE root_id NOT IN (SELECT id FROM plan_nodes)),
authority2 AS (SELECT * FROM authority WHERE NOT (kind = 'CAN_PUBLISH' AND len(evidence_ids) = 1))"""


def _contained(limits: Limits, authority_limits: Limits, edges: str = "edges") -> tuple[str, ...]:
    """CTEs of the four runs of every incident and what they differ by."""
    left = f"left_edges AS (SELECT * FROM (SELECT * FROM {edges} QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY id, source_id) <= {limits.fan_out}) WHERE source_id NOT IN (SELECT id FROM plan_nodes) AND target_id NOT IN (SELECT id FROM plan_nodes))"
    runs = [bounded(limits, edges, p="b_"), _PLAN, left, bounded(limits, "left_edges", "open_roots", p="c_"), reach(authority_limits, p="a_"), reach(authority_limits, "authority2", p="d_")]
    pairs = {"services": ("b_paths", "c_paths", "service_id"), "service-paths": ("b_paths", "c_paths", "root_id, edge_ids"), "targets": ("a_paths", "d_paths", "service_id"), "target-paths": ("a_paths", "d_paths", "root_id, edge_ids")}
    measured = " UNION ALL ".join(
        f"SELECT incident_id, '{m}' AS measure, count(*) FILTER (was) AS before, count(*) FILTER (is_) AS after, count(*) FILTER (was AND NOT is_) AS gone FROM (SELECT incident_id, {k}, bool_or(was) AS was, bool_or(NOT was) AS is_ FROM (SELECT incident_id, {k}, true AS was FROM {x} UNION ALL SELECT incident_id, {k}, false FROM {y}) GROUP BY ALL) GROUP BY 1"
        for m, (x, y, k) in pairs.items()
    )
    cut = " UNION ".join(f"SELECT incident_id FROM {p}said WHERE {CUT}" for p in ("b_", "c_", "a_", "d_"))
    return *runs, f"measured AS ({measured})", f"cut AS ({cut})"


_MEASURED = """SELECT measured.incident_id, measure, before, after, CASE WHEN cut.incident_id IS NOT NULL THEN 0 ELSE gone END AS removed,
  CASE WHEN cut.incident_id IS NOT NULL THEN 'inconclusive' WHEN gone > 0 THEN 'simulated-reduction' ELSE 'no-simulated-reduction' END AS status FROM measured LEFT JOIN cut USING (incident_id)"""
_ALL = 10**7


def _reached(roots: str, edges: str, p: str) -> str:
    return f"""{p}page AS (SELECT * FROM {edges} QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY id, source_id) <= {WHOLE.fan_out}),
{p}hops_to(root_id, cur, depth, terminal) AS (
  SELECT root_id, root_id, 0, false FROM {roots}
  UNION
  SELECT h.root_id, e.source_id, h.depth + 1, e.source_kind = 'Service' FROM {p}hops_to h JOIN {p}page e ON e.target_id = h.cur WHERE NOT h.terminal AND h.depth < {WHOLE.depth})"""


ORACLES = {
    "t1_blast_radius": query(GRAPH, STATES, select="SELECT incident_id, root_id, service_id, depth::BIGINT AS depth, path_key FROM paths"),
    "t1_incidents": query(
        GRAPH,
        STATES,
        CUT_RUNS,
        "served AS (SELECT incident_id, count(*) AS paths, count(DISTINCT service_id) AS services, count(DISTINCT root_id) AS roots, max(ord) AS last_state FROM paths GROUP BY 1)",
        "told AS (SELECT incident_id, count(*) AS warnings, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM said GROUP BY 1)",
        select="SELECT coalesce(served.incident_id, told.incident_id) AS incident_id, paths, services, roots, last_state, warnings, codes, coalesce(served.incident_id, told.incident_id) IN (SELECT incident_id FROM cut_runs) AS cut FROM served FULL JOIN told USING (incident_id)",
    ),
    "t1_warnings": query(
        GRAPH,
        bounded(WHOLE, refused="SELECT id AS incident_id, 'missing-node' AS code, 3::BIGINT AS node_id FROM incidents WHERE id < 30 UNION ALL SELECT id, 'unsupported-root-node', 10 FROM incidents WHERE id < 30"),
        select="SELECT incident_id, code, node_id, array_to_string(path, ',') AS path, place FROM said",
    ),
    "t1_two_hops": query(GRAPH, states(DEPTH, FAN_OUT), select="SELECT root_id, service_id, depth::BIGINT AS depth, path_key FROM paths"),
    "t1_as_of": query(
        GRAPH,
        f"live AS (SELECT * FROM edges WHERE valid_from IS NULL OR (valid_from <= {AS_OF} AND (valid_until IS NULL OR valid_until >= {AS_OF})))",
        bounded(WHOLE, edges="live"),
        select="SELECT incident_id, root_id, count(*) AS path_count, count(DISTINCT service_id) AS service_count FROM paths GROUP BY 1, 2",
    ),
    "t1_capped": query(GRAPH, bounded(LIMITS), select="SELECT incident_id, root_id, service_id, ord, array_to_string(edge_ids, ',') AS edge_ids FROM paths"),
    "t1_capped_warnings": query(GRAPH, bounded(LIMITS), select="SELECT incident_id, code, count(*) AS n, min(place) AS first_place FROM said GROUP BY 1, 2"),
    "t1_reached_services": query(GRAPH, _reached("roots", "edges", ""), select="SELECT root_id, cur AS service_id, min(depth)::BIGINT AS depth FROM hops_to WHERE terminal GROUP BY 1, 2"),
    "t1_path_cuts": query(
        GRAPH,
        states(DEPTH, FAN_OUT),
        f"""open_ends AS (SELECT root_id, count(*) AS cut_paths FROM states s WHERE depth = {DEPTH} AND NOT terminal AND EXISTS (SELECT 1 FROM page e WHERE e.target_id = s.cur AND NOT list_contains(s.node_ids, e.source_id)) GROUP BY 1),
        wide AS (SELECT target_id FROM edges GROUP BY 1 HAVING count(*) > {FAN_OUT}),
        wide_on AS (SELECT root_id, count(DISTINCT cur) AS cut_nodes FROM states WHERE depth < {DEPTH} AND NOT terminal AND cur IN (SELECT target_id FROM wide) GROUP BY 1)""",
        select="SELECT root_id, coalesce(cut_paths, 0) AS cut_paths, coalesce(cut_nodes, 0) AS cut_nodes, coalesce(cut_paths, 0) > 0 OR coalesce(cut_nodes, 0) > 0 AS truncated FROM roots LEFT JOIN open_ends USING (root_id) LEFT JOIN wide_on USING (root_id)",
    ),
    "t1_truncation": query(GRAPH, select="SELECT target_id AS node_id FROM edges GROUP BY 1 HAVING count(*) > 25"),
    "t2_authority": query(
        AUTHORITY,
        reach(AUTHORITY_LIMITS),
        select="""SELECT incident_id, seed_id, target_id, depth::BIGINT AS depth,
        CASE last_kind WHEN 'MAINTAINS' THEN 'maintain' WHEN 'MEMBER_OF' THEN 'belong' WHEN 'OWNS' THEN 'own' WHEN 'CONTROLS' THEN 'control' WHEN 'TRIGGERS' THEN 'trigger' WHEN 'CAN_ACCESS' THEN 'access' ELSE 'publish' END AS capability,
        array_to_string(edge_ids, ',') AS edge_ids, array_to_string(evidence_ids, ',') AS evidence_ids FROM a_targets""",
    ),
    "t2_warnings": query(AUTHORITY, reach(TIGHT), select="SELECT incident_id, code, node_id, array_to_string(path, ',') AS path, place FROM a_said"),
    "a1_funnel": query(
        GRAPH,
        STATES,
        SUPPORT,
        "tall AS (SELECT incident_id, service_id, '1-candidate' AS stage, true AS ok FROM stages UNION ALL SELECT incident_id, service_id, '2-verified', verified FROM stages UNION ALL SELECT incident_id, service_id, '3-high-confidence', high FROM stages)",
        select="SELECT incident_id, stage, count(*) FILTER (ok) AS path_count, count(DISTINCT service_id) FILTER (ok) AS service_count, floor(count(*) FILTER (ok) / count(*) * 100 * 100 + 0.5) / 100 AS percent FROM tall GROUP BY 1, 2",
    ),
    "a3_source_summary": query(GRAPH, STATES, ON_PATHS, CITED, select="SELECT c.incident_id, source_type, count(*) AS evidence_count, floor(avg(confidence) * 10000 + 0.5) / 10000 AS mean_confidence FROM evidence v JOIN cited c ON c.evidence_id = v.id GROUP BY 1, 2"),
    "a4_lookup_summary": query(
        GRAPH,
        STATES,
        ON_PATHS,
        CITED,
        "asked AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY evidence_id) AS nth, evidence_id IN (SELECT id FROM evidence) AS known FROM cited)",
        "n AS (SELECT incident_id, count(*) AS referenced, count(*) FILTER (nth <= 100) AS requested, count(*) FILTER (nth <= 100 AND known) AS resolved FROM asked GROUP BY 1)",
        select="SELECT incident_id, referenced, requested, resolved, requested - resolved AS missing, referenced - requested AS omitted, referenced = resolved AS complete FROM n",
    ),
    "p3_catalog": query(GRAPH, STATES, ON_PATHS, CITED, select="SELECT c.incident_id, id AS evidence_id, source_type, confidence, v.incident_id = c.incident_id AS incident_linked FROM evidence v JOIN cited c ON c.evidence_id = v.id"),
    "a7_strongest_paths": query(GRAPH, STATES, SUPPORT, judged(), select="SELECT incident_id, service_id, stage, path_key, exact_confidence AS confidence, band, path_count, resolved_paths FROM strongest"),
    "a10_selection": query(
        GRAPH, STATES, ON_PATHS, select="SELECT incident_id, service_id, array_to_string(list_sort(list(DISTINCT dependency_type)), ',') AS dependency_types, array_to_string(list_sort(list(DISTINCT declared_range)), ',') AS declared_ranges FROM on_paths GROUP BY 1, 2"
    ),
    "a5_service_validity": query(GRAPH, STATES, ON_PATHS, VALIDITY, select="SELECT * FROM validity"),
    "a6_incident_partition": query(
        GRAPH,
        STATES,
        ON_PATHS,
        VALIDITY,
        select="""SELECT incident_id, overlap, count(*) AS service_count, count(*) FILTER (unknown_paths > 0 AND opens IS NOT NULL) AS partial_history, any_value(has_unknown) AS has_unknown
        FROM (SELECT *, bool_or(unknown_paths > 0) OVER (PARTITION BY incident_id) AS has_unknown FROM classed WHERE overlap IS NOT NULL) GROUP BY 1, 2""",
    ),
    "j9_overlap": query(
        GRAPH,
        select="""SELECT a.incident_id, CASE WHEN valid_from IS NULL THEN 'unknown' WHEN greatest(valid_from, interval_start) <= least(coalesce(valid_until, 9223372036854775807), coalesce(interval_end, 9223372036854775807)) THEN 'during' ELSE 'outside' END AS overlap,
        count(*) AS edge_count FROM affects a JOIN incidents i ON i.id = a.incident_id JOIN edges e ON e.target_id = a.version_id GROUP BY 1, 2""",
    ),
    "t4_containment": query(GRAPH, AUTHORITY, *_contained(WHOLE, AUTHORITY_LIMITS), select=_MEASURED),
    "t4_small_containment": query(
        GRAPH,
        AUTHORITY,
        "direct AS (SELECT * FROM edges WHERE source_kind = 'Service')",
        *_contained(Limits(12, 1000, _ALL, _ALL, _ALL, _ALL, _ALL), Limits(40, 10**6, _ALL, _ALL, _ALL, _ALL, _ALL), "direct"),
        select=_MEASURED,
    ),
    "t4_out_of_reach": query(
        GRAPH,
        _PLAN_NODES,
        "open_roots AS (SELECT * FROM roots WHERE root_id NOT IN (SELECT id FROM plan_nodes)), left_edges AS (SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM plan_nodes) AND target_id NOT IN (SELECT id FROM plan_nodes))",
        _reached("roots", "edges", ""),
        _reached("open_roots", "left_edges", "o_"),
        select="SELECT root_id, cur AS service_id FROM hops_to WHERE terminal EXCEPT SELECT root_id, cur FROM o_hops_to WHERE terminal",
    ),
}
