"""The whole analysis of incidents, side by side: traversal, funnel, catalog, temporal partition, impacts, and the checks on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import evidence, temporal
from .traverse import Limits, bounded_traversal


@dataclass(frozen=True)
class LiveAnalysis:
    """Reports over one snapshot of the graph, one an incident; all are DataFrames with incident_id. `cut` lists the
    incidents whose traversal a bound ended."""

    paths: DataFrame
    funnel: DataFrame
    catalog: DataFrame
    services: DataFrame
    impacts: DataFrame
    warnings: DataFrame
    cut: DataFrame


def analyse(incidents: DataFrame, affected: DataFrame, edges: DataFrame, known: DataFrame, limits: Limits, as_of: int | None = None) -> LiveAnalysis:
    """incidents: id, interval_start, interval_end; affected: incident_id, root_id; edges as of `Graph.depends_on`; known:
    evidence. All incidents are analysed side by side; the traversal and the path edges are written once."""
    found = bounded_traversal(affected, edges, limits, as_of)
    cut = materialize(found.cut())
    paths = materialize(evidence.keyed(found.services))
    on_paths = materialize(evidence.path_edges(paths, edges))
    stages = materialize(evidence.path_stages(evidence.edge_support(on_paths, known)))
    referenced = on_paths.select("incident_id", F.explode("evidence_ids").alias("evidence_id"))
    spans = incidents.select(F.col("id").alias("incident_id"), "interval_start", "interval_end")
    validity = temporal.service_validity(temporal.path_validity(on_paths)).join(spans, "incident_id", "left")
    services = validity.withColumn("overlap", temporal.overlap_class(F.col("opens"), F.col("closes"), F.col("interval_start"), F.col("interval_end"))).drop("interval_start", "interval_end")
    return LiveAnalysis(paths, evidence.funnel(stages), evidence.catalog(referenced, known), services, evidence.strongest_paths(stages, cut), found.warnings, cut)


def invariants(result: LiveAnalysis) -> DataFrame:
    """(incident_id, rule, entity) of what a sound answer never shows: a funnel that widens, services and impacts that
    differ, paths that are counted differently."""
    key = ["incident_id", "service_id"]
    stages = result.funnel.select("incident_id", F.col("stage"), F.col("path_count").alias("n"), F.col("service_count").alias("s"))
    after = stages.select("incident_id", F.col("stage").alias("later"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    wider = stages.join(after, "incident_id").where("stage < later AND (n2 > n OR s2 > s)")
    services = result.paths.select(*key).distinct()
    counted = result.paths.groupBy(*key).agg(F.count("*").alias("n"))
    say = lambda df, rule, c: df.select("incident_id", F.lit(rule).alias("rule"), F.col(c).cast("string").alias("entity"))
    return (
        say(wider, "funnel-widens", "later")
        .union(say(services.join(result.impacts, key, "left_anti"), "service-without-impact", "service_id"))
        .union(say(result.impacts.join(services, key, "left_anti"), "impact-without-service", "service_id"))
        .union(say(result.impacts.join(counted, key).where(F.col("n") != F.col("path_count")), "path-count", "service_id"))
        .union(say(result.services.join(services, key, "left_anti"), "validity-without-service", "service_id"))
    )


def ledger(catalog: DataFrame) -> DataFrame:
    """Every incident's own evidence, strongest first."""
    return catalog.where("incident_linked").orderBy("incident_id", F.col("confidence").desc(), "evidence_id")
