"""Evidence over paths: funnel, source summary, lookup, ladder, catalog, impact explanations.

Paths carry the incident they belong to; every answer is one an incident, all incidents side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import half_up

#: Source types that prove an exact resolution, and the least confidence that counts as high.
EXACT_SOURCES = ("package-lock", "cyclonedx", "spdx", "synthetic-fixture")
CONTEXTUAL_SOURCES = ("npm-registry", "package-manifest", "security-advisory", "other")
HIGH_CONFIDENCE = 0.8
#: The exposure ladder's stages from the weakest on, and what the last proven one says.
LADDER = ("declared", "resolved", "built", "deployed", "network", "executed", "incident")
CONCLUSIONS = ("candidate", "declaration-observed", "resolution-observed", "build-observed", "deployment-observed", "network-observed", "execution-observed", "incident-confirmed")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path columns with edge_id and the edge's attributes, one row per edge of each path."""
    exploded = paths.select("incident_id", "root_id", "service_id", "path_key", F.explode("edge_ids").alias("id"))
    return exploded.join(edges.drop("source_id", "source_kind", "target_id"), "id").withColumnRenamed("id", "edge_id")


def keyed(paths: DataFrame) -> DataFrame:
    """Service paths with service_id and the key [root, service, edges...], from states or a traversal's services."""
    ids = F.concat(F.array("root_id", "cur"), F.col("edge_ids"))
    more = [c for c in ("node_ids", "ord") if c in paths.columns]
    return paths.where("terminal").select("incident_id", "root_id", F.col("cur").alias("service_id"), "depth", "edge_ids", *more, F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit("]")).alias("path_key"))


def edge_support(on_paths: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per path edge: the best confidence of resolved evidence, the best among exact sources, the number of ids that do not
    resolve, and whether all resolved sources are contextual."""
    cited = on_paths.select("incident_id", "root_id", "service_id", "path_key", "edge_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = evidence.select(F.col("id").alias("evidence_id"), "source_type", "confidence")
    exact, contextual = F.col("source_type").isin(*EXACT_SOURCES), F.col("source_type").isin(*CONTEXTUAL_SOURCES)
    return cited.join(known, "evidence_id", "left").groupBy("incident_id", "root_id", "service_id", "path_key", "edge_id").agg(
        F.max("confidence").alias("best"),
        F.max(F.when(exact, F.col("confidence"))).alias("best_exact"),
        F.count_if(F.col("evidence_id").isNotNull() & F.col("confidence").isNull()).alias("missing"),
        F.coalesce(F.every(contextual), F.lit(True)).alias("contextual"),
    )


def path_stages(support: DataFrame, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    """Per path: verified = every edge has resolved evidence; high = every edge has some of at least `threshold`; exact = every
    edge has an exact source, with the least of their best confidences; complete = every cited id resolves."""
    return support.groupBy("incident_id", "root_id", "service_id", "path_key").agg(
        F.every(F.col("best").isNotNull()).alias("verified"),
        F.every(F.coalesce(F.col("best") >= threshold, F.lit(False))).alias("high"),
        F.every(F.col("best_exact").isNotNull()).alias("exact"),
        F.min(F.coalesce("best_exact", F.lit(0.0))).alias("exact_confidence"),
        (F.sum("missing") == 0).alias("complete"),
        F.every("contextual").alias("contextual"),
    )


def funnel(stages: DataFrame) -> DataFrame:
    """Paths and distinct services per stage with the share of all paths in percent (halves up, 0 of none)."""
    pairs = F.explode(F.array(F.struct(F.lit("1-candidate").alias("stage"), F.lit(True).alias("ok")), F.struct(F.lit("2-verified").alias("stage"), F.col("verified").alias("ok")), F.struct(F.lit("3-high-confidence").alias("stage"), F.col("high").alias("ok"))))
    counted = stages.select("incident_id", "service_id", pairs.alias("s")).groupBy("incident_id", "s.stage").agg(
        F.count_if("s.ok").alias("path_count"), F.count_distinct(F.when(F.col("s.ok"), F.col("service_id"))).alias("service_count"), F.count("*").alias("_all")
    )
    share = F.when(F.col("_all") == 0, F.lit(0.0)).otherwise(half_up(F.col("path_count") / F.col("_all") * 100, 100))
    return counted.select("incident_id", "stage", "path_count", "service_count", share.alias("percent"))


def _cited(referenced: DataFrame, evidence: DataFrame) -> DataFrame:
    """incident_id (of the paths) with the evidence their edges name, once each."""
    ids = referenced.select("incident_id", F.col("evidence_id").alias("id")).distinct()
    return evidence.withColumnRenamed("incident_id", "of_incident").join(ids, "id")


def source_summary(referenced: DataFrame, evidence: DataFrame) -> DataFrame:
    """Referenced evidence by incident and source type: count and mean confidence at four places."""
    used = _cited(referenced, evidence)
    exact = F.sum(F.col("confidence").cast("decimal(18,12)")).cast("double") / F.count("confidence")  # whatever the order of the rows
    return used.groupBy("incident_id", "source_type").agg(F.count("*").alias("evidence_count"), half_up(exact, 10_000).alias("mean_confidence"))


def lookup_summary(referenced: DataFrame, evidence: DataFrame, limit: int) -> DataFrame:
    """Per incident the referenced, requested (the `limit` smallest ids), resolved, missing and omitted evidence ids, and completeness."""
    ids = referenced.select("incident_id", "evidence_id").distinct()
    placed = ids.withColumn("_n", F.row_number().over(Window.partitionBy("incident_id").orderBy("evidence_id")))
    known = evidence.select(F.col("id").alias("evidence_id"), F.lit(True).alias("_found"))
    asked = placed.where(F.col("_n") <= limit).join(known, "evidence_id", "left").groupBy("incident_id").agg(F.count("*").alias("requested"), F.count("_found").alias("resolved"))
    counts = ids.groupBy("incident_id").agg(F.count("*").alias("referenced")).join(asked, "incident_id")
    return counts.select(
        "incident_id", "referenced", "requested", "resolved", (F.col("requested") - F.col("resolved")).alias("missing"), (F.col("referenced") - F.col("requested")).alias("omitted"), (F.col("referenced") == F.col("resolved")).alias("complete")
    )


def catalog(referenced: DataFrame, evidence: DataFrame) -> DataFrame:
    """Redacted evidence of the referenced ids: no URI or detail, only whether it belongs to the incident."""
    linked = F.coalesce(F.col("of_incident") == F.col("incident_id"), F.lit(False))
    return _cited(referenced, evidence).select("incident_id", F.col("id").alias("evidence_id"), "source_type", "confidence", linked.alias("incident_linked"))


def ladder(groups: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(stages reached, last stage, conclusion) from evidence-id arrays by stage name; the first empty stage ends the climb."""
    reached, alive = F.lit(0), F.lit(True)
    for name in LADDER:
        alive = alive & F.coalesce(F.size(groups[name]) > 0, F.lit(False)) if name in groups else F.lit(False)
        reached = reached + alive.cast("int")
    names = F.array(F.lit("candidate"), *map(F.lit, LADDER))
    return reached, F.element_at(names, reached + 1), F.element_at(F.array(*map(F.lit, CONCLUSIONS)), reached + 1)


#: The confidence levels from the weakest on.
BANDS = ("unknown", "contextual", "possible", "probable", "strong")


def confidence_band(complete: Column, threshold: float = HIGH_CONFIDENCE) -> Column:
    """Level of a path: exact proof of every edge is strong from the threshold on, else probable; verified edges without it
    are contextual where every source is, else possible; what is incomplete or unverified is unknown."""
    proven = F.col("verified") & F.col("exact")
    return (
        F.when(~complete, "unknown")
        .when(proven & (F.col("exact_confidence") >= threshold), "strong")
        .when(proven, "probable")
        .when(F.col("verified") & F.col("contextual"), "contextual")
        .when(F.col("verified"), "possible")
        .otherwise("unknown")
    )


def strongest_paths(stages: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """Per incident and service the strongest path (stage, level, key). Nothing is conclusive in an incident of `cut`
    (incident_id), whose traversal a bound ended."""
    judged = stages.withColumn("_cut", F.lit(False)) if cut is None else stages.join(cut.select("incident_id", F.lit(True).alias("_cut")), "incident_id", "left")
    whole = F.col("complete") & ~F.coalesce("_cut", F.lit(False))
    levels = F.array(*map(F.lit, BANDS))
    judged = judged.withColumn("band", confidence_band(whole)).withColumn("stage", F.when(whole & F.col("verified") & F.col("exact"), "resolved").otherwise("candidate"))
    service = ["incident_id", "service_id"]
    best = Window.partitionBy(*service).orderBy((F.col("stage") == "resolved").desc(), F.array_position(levels, F.col("band")).desc(), "path_key")
    ranked = judged.withColumn("_n", F.row_number().over(best))
    counts = judged.groupBy(*service).agg(F.count("*").alias("path_count"), F.count_if(F.col("stage") == "resolved").alias("resolved_paths"))
    return ranked.where("_n = 1").select(*service, "stage", "path_key", F.col("exact_confidence").alias("confidence"), "band").join(counts, service)


def selection_summary(on_paths: DataFrame) -> DataFrame:
    """Per incident and service the distinct dependency types and declared ranges along its paths."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return on_paths.groupBy("incident_id", "service_id").agg(listed("dependency_type").alias("dependency_types"), listed("declared_range").alias("declared_ranges"))
