"""Registered checks at the edge with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from ..session import materialize, read_table
from ..sources.derived import Graph, entity
from .graph_sql import GRAPH, query
from .ingest import ORACLES as INGEST
from .ingest import t6_expansion


def p10_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review commands made from orders, by what is wrong with them."""
    rows = read_table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") - 5).alias("finding_id"),
        F.when(F.col("o_orderstatus") == "P", "delete").otherwise("dismiss").alias("action"),
        F.when(F.col("o_totalprice") < 50_000, " ").otherwise("because").alias("reason"),
        F.lit("analyst").alias("reviewer"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("decided_at"),
        F.concat(F.lit("key-"), F.col("o_custkey")).alias("idempotency_key"),
        F.when(F.col("o_orderpriority") == "5-LOW", "x").otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("fingerprint"),
    )
    return rows.groupBy(checks.command_problem().alias("problem")).agg(F.count("*").alias("n"))


def p11_promotable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines' suppliers as evidence of parts as findings."""
    g = Graph(spark, sf_dir)
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    findings = g.table("lineitem").groupBy(F.col("l_partkey").alias("finding_id")).agg(
        F.every(F.col("l_linestatus") == "O").alias("synthetic"), (F.count("*") > 35).alias("truncated"), F.collect_set(F.when(F.col("l_quantity") > 48, entity(F.col("l_suppkey") * 4 + flag, "Evidence"))).alias("evidence_ids")
    )
    evidence = g.evidence().withColumn("synthetic", F.col("confidence") == 0.9)
    versions = g.table("part").where("p_size > 10").select(F.col("p_partkey").alias("finding_id"), F.lit(1).alias("version_id"))
    return checks.promotable(materialize(findings), evidence, versions)


def q2_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: the user is the token, the event type the fingerprint; users 0 to 49 are known as clicks."""
    events = read_table(spark, sf_dir, "events")
    requests = events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("token"), F.col("event_type").alias("fingerprint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    known = events.where("user_id < 50").select(F.col("user_id").alias("token")).distinct().withColumn("fingerprint", F.lit("click"))
    return checks.replay(requests, known).groupBy("outcome").agg(F.count("*").alias("n"))


def t7_seed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    nodes = g.evidence().select("id", F.lit("Evidence").alias("kind"))
    return checks.seed_problems(g.authority_seeds(), nodes)


def w10_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as open snapshots of users, closed at the user's median moment; at most 40 at once."""
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("service_id"), F.col("event_id").alias("snapshot_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"))
    closed = rows.groupBy("service_id").agg(F.floor((F.min("valid_from") + F.max("valid_from")) / 2).alias("closed_at"))
    edges = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("id"))
    return checks.bounded_closure(rows, edges, closed, 40, 200)


def f16_stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = checks.stable_json(F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand", F.lit("name"), "p_name"))
    return read_table(spark, sf_dir, "part").select("p_partkey", text.alias("json"), F.sha2(text, 256).alias("content_hash"))


def f20_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", checks.latency_text(F.col("o_orderkey") * 10).alias("latency"))


def a22_wave_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion waves, parts below size 25 having a document."""
    available = read_table(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    return checks.wave_statistics(t6_expansion(spark, sf_dir), available)


def s10_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that dependency edges cite as evidence and that do not exist."""
    g = Graph(spark, sf_dir)
    wanted = g.depends_on().select(F.explode("evidence_ids").alias("id"))
    return checks.nodes_by_id(g.evidence(), wanted)[1]


QUERIES = {f.__name__: f for f in (p10_commands, p11_promotable, q2_replay, t7_seed_evidence, w10_closure, f16_stable_json, f20_latency, a22_wave_statistics, s10_lookup)}
ORACLES = {
    "p10_commands": """SELECT CASE WHEN o_orderkey < 5 THEN 'finding-id' WHEN o_orderstatus = 'P' THEN 'action' WHEN o_totalprice < 50000 THEN 'reason' WHEN length('key-' || o_custkey) < 8 THEN 'idempotency-key' WHEN o_orderpriority = '5-LOW' THEN 'fingerprint' END AS problem, count(*) AS n FROM orders GROUP BY 1""",
    "p11_promotable": query(
        GRAPH,
        """good AS (SELECT id FROM evidence WHERE source_type = 'package-lock' AND confidence >= 0.8 AND confidence <> 0.9),
        f AS (SELECT l_partkey AS finding_id, bool_and(l_linestatus = 'O') AS synthetic, count(*) > 35 AS truncated, bool_or(l_quantity > 48 AND (l_suppkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 8 + 7 IN (SELECT id FROM good)) AS backed FROM lineitem GROUP BY 1)""",
        select="SELECT finding_id, NOT synthetic AND NOT truncated AND backed AND coalesce(p_size > 10, false) AS promotable FROM f LEFT JOIN part ON p_partkey = finding_id",
    ),
    "q2_replay": """WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER w AS n, first_value(event_type) OVER w AS lead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT CASE WHEN user_id < 50 THEN CASE WHEN event_type = 'click' THEN 'replayed' ELSE 'conflict' END WHEN n = 1 THEN 'created' WHEN event_type = lead THEN 'replayed' ELSE 'conflict' END AS outcome, count(*) AS n FROM r GROUP BY 1""",
    "t7_seed_evidence": "SELECT s_suppkey * 8 + 3 AS seed_id, 'missing-evidence' AS code FROM supplier WHERE s_acctbal < -500",
    "w10_closure": """WITH s AS (SELECT user_id AS service_id, event_id, epoch_us(ts) AS f FROM events), c AS (SELECT service_id, (min(f) + max(f)) // 2 AS closed_at, count(*) AS total FROM s GROUP BY 1),
        o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY f, event_id) <= 40), e AS (SELECT l_orderkey AS event_id, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT o.service_id, count(*) AS snapshots, least(coalesce(sum(n), 0), 200)::BIGINT AS edges, any_value(total) > 40 OR coalesce(sum(n), 0) > 200 AS truncated, count(*) FILTER (closed_at < f) AS inverted FROM o JOIN c USING (service_id) LEFT JOIN e USING (event_id) GROUP BY 1""",
    "f16_stable_json": """WITH j AS (SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","type":"' || p_type || '"}' AS json FROM part) SELECT p_partkey, json, sha256(json) AS content_hash FROM j""",
    "f20_latency": "SELECT o_orderkey, CASE WHEN o_orderkey < 100 THEN o_orderkey * 10 || 'ms' ELSE printf('%.2fs', o_orderkey * 10 / 1000.0) END AS latency FROM orders",
    "a22_wave_statistics": f"""WITH waves AS ({INGEST["t6_expansion"]}) SELECT depth, count(*) AS scheduled, count(p_partkey) AS succeeded, count(*) - count(p_partkey) AS failed FROM waves LEFT JOIN part ON 'p' || p_partkey = name AND p_size < 25 GROUP BY 1""",
    "s10_lookup": query(GRAPH, select="SELECT DISTINCT x AS id FROM (SELECT unnest(evidence_ids) AS x FROM edges) WHERE x NOT IN (SELECT id FROM evidence)"),
}
