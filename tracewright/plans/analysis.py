"""Registered compositions: live analysis, its checks, stores, budgets, replay and promotion, with their oracles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import investigations, live, merge, typosquat
from ..session import materialize, shared_dir
from ..sources.derived import Graph, entity
from ..sources.stores import SnapshotStore, decode_release_nodes
from .graph_sql import GRAPH, query
from .packages import NAMES, SIGNATURES, observed_candidates
from .releases import RELEASES
from .traversals import AS_OF, CITED, CUT_RUNS, ON_PATHS, STATES, SUPPORT, VALIDITY, WHOLE, judged


def _analysis(spark: SparkSession, sf_dir: str) -> live.LiveAnalysis:
    g = Graph(spark, sf_dir)
    return live.analyse(g.incidents(), g.incident_versions(), materialize(g.depends_on()), g.evidence(), WHOLE)


def q8_live_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of every incident with validity class and strongest path."""
    found = _analysis(spark, sf_dir)
    key = ["incident_id", "service_id"]
    rows = found.services.select(*key, "overlap").join(found.impacts, key).join(found.cut.withColumn("truncated", F.lit(True)), "incident_id", "left").na.fill(False, ["truncated"])
    return rows.select(*key, "overlap", "stage", "band", "path_key", "path_count", "resolved_paths", "truncated")


def q9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.invariants(_analysis(spark, sf_dir))


def q9_broken_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks over a spoilt answer: impacts that lack or miscount, validity of strangers, a funnel that widens."""
    found = _analysis(spark, sf_dir)
    impacts = found.impacts.where("service_id % 3 <> 0").withColumn("path_count", F.when(F.col("service_id") % 5 == 0, F.col("path_count") + 1).otherwise(F.col("path_count")))
    services = found.services.unionByName(found.services.withColumn("service_id", F.col("service_id") + 1))
    funnel = found.funnel.withColumn("path_count", F.when(F.col("stage") == "3-high-confidence", F.col("path_count") + 10**6).otherwise(F.col("path_count")))
    return live.invariants(replace(found, impacts=impacts, services=services, funnel=funnel))


def p12_evidence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.ledger(_analysis(spark, sf_dir).catalog)


def p14_service_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct service dependents per version."""
    return Graph(spark, sf_dir).depends_on().where("source_kind = 'Service'").groupBy("target_id").agg(F.count("*").alias("services"))


def w5_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typosquat.within_budget(observed_candidates(Graph(spark, sf_dir), 5), 500, 900).select("observed_id", "package_id", F.col("place").cast("long").alias("place"))


def f22_finding_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).table("part").select("p_partkey", typosquat.finding_token(F.lit("corpus-1"), F.col("p_brand"), F.col("p_partkey")).alias("token"))


def s20_release_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release rows encoded as JSON and decoded again; caches of unknown trust are spoilt."""
    nodes = Graph(spark, sf_dir).release_nodes()
    stored = nodes.select("id", "kind", F.when((F.col("kind") == "cache-entry") & (F.col("trust") == "unknown"), "odd").otherwise(F.col("trust")).alias("trust"), F.to_json("evidence_ids").alias("evidence_ids"))
    good, issues = decode_release_nodes(stored)
    return good.groupBy("kind", "trust").agg(F.count("*").alias("n"), F.sum(F.size("evidence_ids")).cast("long").alias("ids")).unionByName(issues.groupBy(F.lit("issue").alias("kind"), F.col("code").alias("trust")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("ids")))


def k7_snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release graph written as snapshot, verified, read back and counted."""
    g = Graph(spark, sf_dir)
    store = SnapshotStore(spark, shared_dir(spark))
    store.write("s1", g.release_nodes(), g.release_edges())
    nodes, edges = store.read("s1")
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")))


def k2_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of optional dependencies arrive after those of all; ends outside the known versions are refused."""
    g = Graph(spark, sf_dir)
    edges = g.depends_on().select("id", "source_id", "target_id", F.coalesce("valid_from", F.lit(0)).alias("observed_at"), "dependency_type")
    known = g.versions().where("size <= 40").select("id").unionByName(g.services().select("id"))
    late = edges.where("dependency_type = 'optional'").withColumn("observed_at", F.col("observed_at") + 1)
    return merge.upsert_edges(edges.where("dependency_type = 'production'"), late, known).groupBy("dependency_type").agg(F.count("*").alias("n"), F.sum("observed_at").alias("clock"))


def a15_derived_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse edges generated once per order line: the latest generation stays."""
    lines = Graph(spark, sf_dir).table("lineitem").select(
        F.col("l_partkey").alias("id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("generated_at"), F.concat(F.lit("v"), "l_linenumber").alias("generator_version"), F.col("l_orderkey").alias("derived_from"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id")
    )
    return merge.merge_derived(lines).select("id", "generated_at", "generator_version", "derived_from")


def q7_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that promoted findings affect: parts as findings, promoted where the part is large."""
    g = Graph(spark, sf_dir)
    versions = g.versions()
    findings = versions.select(F.col("id").cast("string").alias("finding_id"), F.lit("open").alias("status"), F.lit("h").alias("payload_hash"), F.lit(AS_OF).alias("detected_at"), "package", "version")
    commands = versions.select(F.col("id").cast("string").alias("finding_id"), F.when(F.col("size") > 40, "promote").otherwise("dismiss").alias("action"), F.when(F.col("size") == 45, "x").otherwise("h").alias("expected_hash"), F.lit("k").alias("idempotency_key"), F.lit(1).alias("at"))
    incidents, affects = investigations.promoted_incidents(findings, investigations.review(findings, commands), versions)
    return affects.join(incidents, affects["incident"] == incidents["logical_id"]).select("logical_id", "version_id", "interval_start")


def s13_affected_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 affected versions of every incident, and whether there are more."""
    g = Graph(spark, sf_dir)
    edges = g.affects().select(F.col("incident_id").alias("target_id"), F.col("version_id").alias("id"), F.col("version_id").alias("source_id"))
    return investigations.dependents_page(edges, 15).select(F.col("target_id").alias("incident_id"), F.col("id").alias("version_id"), "truncated")


def s11_evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every incident that its nation's suppliers own."""
    g = Graph(spark, sf_dir)
    return g.evidence().join(g.table("nation").select(entity("n_nationkey", "Incident").alias("incident_id")), "incident_id").groupBy("incident_id", "source_type").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (q8_live_analysis, q9_invariants, q9_broken_invariants, p12_evidence_ledger, p14_service_dependents, w5_budget, f22_finding_token, s20_release_rows, k7_snapshot_store, k2_edge_upsert, a15_derived_merge, q7_promotion, s13_affected_page, s11_evidence_lookup)
}
ORACLES = {
    "q8_live_analysis": query(
        GRAPH,
        STATES,
        ON_PATHS,
        VALIDITY,
        SUPPORT,
        CUT_RUNS,
        judged("incident_id NOT IN (SELECT incident_id FROM cut_runs)"),
        select="SELECT incident_id, service_id, overlap, stage, band, path_key, strongest.path_count, resolved_paths, incident_id IN (SELECT incident_id FROM cut_runs) AS truncated FROM classed JOIN strongest USING (incident_id, service_id)",
    ),
    "q9_invariants": "SELECT 0 AS incident_id, 'x' AS rule, 'y' AS entity WHERE false",
    "q9_broken_invariants": query(
        GRAPH,
        STATES,
        "found AS (SELECT DISTINCT incident_id, service_id FROM paths), validity_keys AS (SELECT incident_id, service_id + 1 AS service_id FROM found)",
        select="""SELECT incident_id, 'service-without-impact' AS rule, service_id::VARCHAR AS entity FROM found WHERE service_id % 3 = 0
        UNION ALL SELECT incident_id, 'path-count', service_id::VARCHAR FROM found WHERE service_id % 3 <> 0 AND service_id % 5 = 0 UNION ALL SELECT incident_id, 'validity-without-service', service_id::VARCHAR FROM validity_keys ANTI JOIN found USING (incident_id, service_id)
        UNION ALL SELECT DISTINCT incident_id, 'funnel-widens', '3-high-confidence' FROM found, range(2) UNION ALL SELECT DISTINCT incident_id, 'funnel-widens', '3-high-confidence' FROM found""",
    ),
    "p12_evidence_ledger": query(GRAPH, STATES, ON_PATHS, CITED, select="SELECT incident_id, id AS evidence_id, source_type, confidence, true AS incident_linked FROM evidence JOIN cited USING (incident_id) WHERE id = evidence_id"),
    "p14_service_dependents": query(GRAPH, select="SELECT target_id, count(*) AS services FROM edges WHERE source_kind = 'Service' GROUP BY 1"),
    "w5_budget": query(
        NAMES, SIGNATURES, "few AS (SELECT * FROM placed WHERE place <= 5), first AS (SELECT DISTINCT observed_id FROM few ORDER BY 1 LIMIT 500)", select="SELECT observed_id, package_id, place FROM few WHERE observed_id IN (SELECT observed_id FROM first) ORDER BY observed_id, place LIMIT 900"
    ),
    "f22_finding_token": "SELECT p_partkey, sha256('[\"corpus-1\",\"' || p_brand || '\",\"' || p_partkey || '\"]') AS token FROM part",
    "s20_release_rows": query(
        RELEASES,
        select="""SELECT kind, trust, count(*) AS n, sum(len(evidence_ids))::BIGINT AS ids FROM r_nodes WHERE NOT (kind = 'cache-entry' AND trust = 'unknown') GROUP BY 1, 2
        UNION ALL SELECT 'issue', 'trust', count(*), 0 FROM r_nodes WHERE kind = 'cache-entry' AND trust = 'unknown' HAVING count(*) > 0""",
    ),
    "k7_snapshot_store": query(RELEASES, select="SELECT kind, count(*) AS n FROM r_nodes GROUP BY 1 UNION ALL SELECT kind, count(*) FROM r_edges GROUP BY 1"),
    "k2_edge_upsert": query(
        GRAPH,
        "known AS (SELECT p_partkey * 8 + 1 AS id FROM part WHERE p_size <= 40 UNION ALL SELECT c_custkey * 8 + 2 FROM customer)",
        select="""SELECT dependency_type, count(*) AS n, sum(coalesce(valid_from, 0) + (dependency_type = 'optional')::INT)::BIGINT AS clock FROM edges
        WHERE dependency_type = 'production' OR (source_id IN (SELECT id FROM known) AND target_id IN (SELECT id FROM known)) GROUP BY 1""",
    ),
    "a15_derived_merge": "SELECT l_partkey AS id, epoch_ms(l_shipdate) AS generated_at, 'v' || l_linenumber AS generator_version, l_orderkey AS derived_from FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY epoch_ms(l_shipdate) DESC, 'v' || l_linenumber DESC, l_orderkey DESC, l_suppkey DESC) = 1",
    "q7_promotion": f"SELECT 'incident:' || (p_partkey * 8 + 1) AS logical_id, p_partkey * 8 + 1 AS version_id, {AS_OF} AS interval_start FROM part WHERE p_size > 40 AND p_size <> 45",
    "s13_affected_page": query(GRAPH, "pl AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY version_id) AS place, count(*) OVER (PARTITION BY incident_id) AS total FROM affects)", select="SELECT incident_id, version_id, total > 15 AS truncated FROM pl WHERE place <= 15"),
    "s11_evidence_lookup": query(GRAPH, select="SELECT incident_id, source_type, count(*) AS n FROM evidence GROUP BY 1, 2"),
}
