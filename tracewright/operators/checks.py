"""Checks at the edge: review commands, promotability, idempotent requests, seed evidence, closing bounds, stable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import MAX_ID

#: What a review command may look like.
IDEMPOTENCY_KEY, FINGERPRINT = r"^[A-Za-z0-9._-]{8,80}$", r"^[a-f0-9]{64}$"
REASON_LENGTH, REVIEWER_LENGTH = 2000, 200
#: How much one supersession may close.
MAX_CLOSED_SNAPSHOTS, MAX_CLOSED_EDGES = 100, 25_000
TRUSTED_CONFIDENCE = 0.8


def command_problem() -> Column:
    """Why a review command (finding_id, action, reason, reviewer, decided_at, idempotency_key, fingerprint) is invalid, or null."""
    text = lambda c, n: F.col(c).isNull() | (F.trim(c) == "") | (F.length(c) > n)
    whole = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > MAX_ID)
    fits = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    return (
        F.when(whole("finding_id"), "finding-id")
        .when(~F.coalesce(F.col("action").isin("dismiss", "promote"), F.lit(False)), "action")
        .when(text("reason", REASON_LENGTH), "reason")
        .when(text("reviewer", REVIEWER_LENGTH), "reviewer")
        .when(whole("decided_at"), "decided-at")
        .when(~fits("idempotency_key", IDEMPOTENCY_KEY), "idempotency-key")
        .when(~fits("fingerprint", FINGERPRINT), "fingerprint")
    )


def trusted_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence of real lockfiles with enough confidence."""
    return evidence.where(~F.col("synthetic") & (F.col("source_type") == "package-lock") & (F.col("confidence") >= TRUSTED_CONFIDENCE))


def promotable(findings: DataFrame, evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """finding_id, promotable: not synthetic, with trusted evidence, at least one exact version, versions not truncated.

    findings: finding_id, synthetic, truncated, evidence_ids; versions: finding_id, version_id.
    """
    trusted = trusted_evidence(evidence).select(F.col("id").alias("evidence_id"))
    backed = findings.select("finding_id", F.explode("evidence_ids").alias("evidence_id")).join(trusted, "evidence_id", "left_semi").select("finding_id", F.lit(True).alias("_backed")).distinct()
    exact = versions.select("finding_id", F.lit(True).alias("_exact")).distinct()
    yes = lambda c: F.coalesce(c, F.lit(False))
    return findings.join(backed, "finding_id", "left").join(exact, "finding_id", "left").select("finding_id", (~F.col("synthetic") & ~F.col("truncated") & yes("_backed") & yes("_exact")).alias("promotable"))


def replay(requests: DataFrame, known: DataFrame) -> DataFrame:
    """request_id, outcome of idempotent requests (request_id, token, fingerprint, at) given known ones (token, fingerprint).

    A known token with the same fingerprint is a replay, with another a conflict; of new requests with one token the
    earliest creates and the others are judged against it.
    """
    first = Window.partitionBy("token").orderBy("at", "request_id")
    joined = requests.join(known.withColumnRenamed("fingerprint", "_known"), "token", "left")
    leader = F.coalesce("_known", F.first("fingerprint").over(first))
    created = F.col("_known").isNull() & (F.row_number().over(first) == 1)
    return joined.select("request_id", F.when(created, "created").when(F.col("fingerprint") == leader, "replayed").otherwise("conflict").alias("outcome"))


def seed_problems(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed_id, code) of seeds whose evidence is none, missing, or no evidence."""
    cited = seeds.select("seed_id", F.explode("seed_evidence").alias("id")).join(nodes.select("id", "kind"), "id", "left")
    code = F.when(F.col("kind").isNull(), "missing-evidence").when(F.col("kind") != "Evidence", "wrong-evidence-kind")
    bare = seeds.where(F.coalesce(F.size("seed_evidence"), F.lit(0)) <= 0).select("seed_id", F.lit("missing-required-evidence").alias("code"))
    return cited.select("seed_id", code.alias("code")).where("code IS NOT NULL").union(bare).distinct()


def bounded_closure(snapshots: DataFrame, edges: DataFrame, closed_at: DataFrame, max_snapshots: int = MAX_CLOSED_SNAPSHOTS, max_edges: int = MAX_CLOSED_EDGES) -> DataFrame:
    """Per service what one supersession closes: snapshots, edges, truncated, and inverted ones that would end before they begin.

    snapshots: service_id, snapshot_id, valid_from (open ones); edges: snapshot_id, id; closed_at: service_id, closed_at.
    """
    place = F.row_number().over(Window.partitionBy("service_id").orderBy("valid_from", "snapshot_id"))
    total = F.count("*").over(Window.partitionBy("service_id"))
    opened = snapshots.withColumn("_n", place).withColumn("_total", total).where(F.col("_n") <= max_snapshots)
    per = edges.groupBy("snapshot_id").agg(F.count("*").alias("edges"))
    joined = opened.join(per, "snapshot_id", "left").join(closed_at, "service_id")
    summed = joined.groupBy("service_id").agg(
        F.count("*").alias("snapshots"), F.coalesce(F.sum("edges"), F.lit(0)).alias("_edges"), F.max("_total").alias("_all"), F.count_if(F.col("closed_at") < F.col("valid_from")).alias("inverted")
    )
    return summed.select("service_id", "snapshots", F.least("_edges", F.lit(max_edges)).alias("edges"), ((F.col("_all") > max_snapshots) | (F.col("_edges") > max_edges)).alias("truncated"), "inverted")


def stable_json(properties: Column) -> Column:
    """A map as JSON with its names in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties))))


def latency_text(millis: Column) -> Column:
    """Milliseconds below a second, else seconds with two places, ties in the third upwards."""
    return F.when(millis < 1000, F.concat(millis.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.2fs", millis / 1000.0))


def wave_statistics(waves: DataFrame, available: DataFrame) -> DataFrame:
    """Per depth of an expansion: scheduled names, those with a document, and those without."""
    known = available.select("name", F.lit(1).alias("ok")).distinct()
    return waves.join(known, "name", "left").groupBy("depth").agg(F.count("*").alias("scheduled"), F.count("ok").alias("succeeded"), (F.count("*") - F.count("ok")).alias("failed"))


def nodes_by_id(nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of wanted ids; repeated wishes count once."""
    ids = wanted.select("id").distinct()
    return nodes.join(ids, "id", "left_semi"), ids.join(nodes, "id", "left_anti")
