"""Graph fragments: conflict-detecting merge, validation, reverse-edge parity, row codec, guarded upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import edge_logical_id, numeric_id, reverse_edge_logical_id, valid_logical_id
from ..session import materialize

#: Relation, allowed source kinds, allowed target kinds; * is any kind but those named after a minus.
ENDPOINTS = (
    ("HAS_VERSION", "Package", "PackageVersion"),
    ("DECLARES_DEPENDENCY", "Repository Service PackageVersion", "Package"),
    ("DEPENDS_ON", "Service PackageVersion", "PackageVersion"),
    ("CONTAINS", "Repository", "Service"),
    ("TRIGGERS", "Repository", "CIWorkflow"),
    ("PRODUCES", "CIWorkflow", "Build"),
    ("PRODUCES", "Build", "Artifact"),
    ("DEPLOYED_AS", "Artifact", "Deployment"),
    ("RUNS", "Deployment", "Service"),
    ("MAINTAINS", "Maintainer", "Package"),
    ("MEMBER_OF", "Maintainer", "Organization"),
    ("OWNS", "Organization", "Package Repository Service"),
    ("CAN_PUBLISH", "Credential", "Package"),
    ("CAN_ACCESS", "CIWorkflow", "Credential"),
    ("CONTROLS", "Maintainer Organization", "Credential"),
    ("AFFECTS", "Incident", "PackageVersion"),
    ("SUPPORTS", "Evidence", "* -Evidence"),
    ("TARGETS", "Finding", "Package"),
    ("TARGETS", "Control", "* -Evidence -Control"),
    ("LOOKALIKE_OF", "Package", "Package"),
    ("IMITATES", "Finding", "Package"),
    ("RESOLVED_IN", "LockfileSnapshot", "PackageVersion"),
)
NODE_KINDS = (
    "Package PackageVersion Service Repository Build Artifact Deployment Maintainer Credential CIWorkflow Organization Incident Evidence Control Finding LockfileSnapshot"
).split()


def endpoint_rules(spark) -> DataFrame:
    """(kind, source_kind, target_kind) of every allowed combination."""
    wide = lambda spec: [k for k in NODE_KINDS if f"-{k}" not in spec.split()] if spec.startswith("*") else spec.split()
    rows = [(kind, s, t) for kind, sources, targets in ENDPOINTS for s in wide(sources) for t in wide(targets)]
    return spark.createDataFrame(rows, "kind string, source_kind string, target_kind string")


def union_all(fragments: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fragments)


def distinct_values(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and the sorted distinct elements of the array `column` over their rows; repeats are gone before anything is gathered."""
    each = rows.select(*keys, F.explode(column).alias("_value")).distinct()
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list("_value")).alias(column))


def _merged(rows: DataFrame, checked: list[str], *more: Column) -> DataFrame:
    """One row per id, in one grouping: the checked columns complemented, evidence united, the latest observed_at, and as
    `_conflicts` the checked columns with contradicting values. No evidence is an empty array."""
    each = rows.select("*", F.explode_outer("evidence_ids").alias("_value"))
    contradicts = lambda c: F.when(F.min(c) != F.max(c), c)
    return each.groupBy("id").agg(F.max("observed_at").alias("observed_at"), *[F.min(c).alias(c) for c in checked], F.array_sort(F.collect_set("_value")).alias("evidence_ids"), F.array_compact(F.array(*[contradicts(c) for c in checked])).alias("_conflicts"), *more)


def _split(merged: DataFrame, columns: list[str], written: bool) -> tuple[DataFrame, DataFrame]:
    merged = materialize(merged) if written else merged
    return merged.select(*columns), merged.select("id", F.explode("_conflicts").alias("column"))


def merge_nodes(rows: DataFrame, optional: list[str], required: list[str] = ("kind", "logical_id"), written: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): one row per id with evidence united, the latest observed_at, synthetic only if all agree,
    optional properties complemented; conflicts are (id, column) with contradicting values, and are never resolved.

    Order of the rows does not matter. Evidence nodes must agree on synthetic. With `written` the rows are merged once for both results.
    """
    checked = [*required, *optional]
    mixed = F.when(F.some("synthetic") & ~F.every("synthetic") & (F.max("kind") == "Evidence"), F.array(F.lit("synthetic"))).otherwise(F.array())
    merged = _merged(rows, checked, F.every("synthetic").alias("synthetic"), mixed.alias("_mixed"))
    merged = merged.withColumn("_conflicts", F.concat("_conflicts", "_mixed")).drop("_mixed")
    return _split(merged, ["id", *checked, "observed_at", "synthetic", "evidence_ids"], written)


def merge_edges(rows: DataFrame, optional: list[str], required: list[str] = ("kind", "logical_id", "source_id", "target_id"), written: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of canonical edges, as `merge_nodes`: evidence united, the latest observed_at, optional properties
    complemented; ends, kind or a property that contradict are conflicts. A derived edge is no canonical one."""
    checked = [*required, *optional]
    return _split(_merged(rows.where(~F.col("derived")), checked), ["id", *checked, "observed_at", "evidence_ids"], written)


def merge_derived(rows: DataFrame) -> DataFrame:
    """Reverse edges by id: the latest generation, ties by generator version."""
    return rows.groupBy("id").agg(F.max(F.struct("generated_at", "generator_version", "derived_from", "source_id", "target_id")).alias("m")).select("id", "m.*")


def reverse_edges(edges: DataFrame, *carried: str) -> DataFrame:
    """USED_BY view of DEPENDS_ON edges: swapped ends, identity derived from the canonical one, and its `carried` columns."""
    logical = reverse_edge_logical_id(F.col("logical_id"))
    return edges.where("kind = 'DEPENDS_ON'").select(numeric_id(logical).alias("id"), logical.alias("logical_id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.col("id").alias("derived_from"), *carried)


def parity_violations(edges: DataFrame, reverse: DataFrame) -> DataFrame:
    """(rule, entity_id): canonical edges without exactly one exact reverse, reverses without a canonical edge or with another id."""
    canonical = edges.where("kind = 'DEPENDS_ON'").select("id", "logical_id", "source_id", "target_id")
    exact = canonical.join(reverse.select(F.col("derived_from").alias("id"), F.col("id").alias("r_id"), F.col("source_id").alias("r_source"), F.col("target_id").alias("r_target")), "id", "full")
    fits = (F.col("source_id") == F.col("r_target")) & (F.col("target_id") == F.col("r_source"))
    known = exact.where(F.col("logical_id").isNotNull())
    wrong = known.groupBy("id").agg(F.count_if(fits).alias("n")).where("n <> 1").select(F.lit("reverse-count").alias("rule"), F.col("id").alias("entity_id"))
    orphan = exact.where(F.col("logical_id").isNull()).select(F.lit("orphan-reverse").alias("rule"), F.col("r_id").alias("entity_id"))
    renamed = known.where(F.col("r_id").isNotNull() & (F.col("r_id") != numeric_id(reverse_edge_logical_id(F.col("logical_id"))))).select(F.lit("reverse-identity").alias("rule"), F.col("r_id").alias("entity_id"))
    return wrong.unionByName(orphan).unionByName(renamed)


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, entity_id) of everything in the graph that breaks a rule; a valid graph has none.

    nodes: id, logical_id, kind, evidence_ids, observed_at, synthetic; edges: id, logical_id, kind, source_id,
    target_id, evidence_ids, observed_at.
    """
    spark = nodes.sparkSession
    unsafe = lambda what: [
        F.when(~valid_logical_id(F.col("logical_id")), f"{what}-logical-id"),
        F.when(F.coalesce(numeric_id(F.col("logical_id")) != F.col("id"), F.lit(True)), f"{what}-identity"),
        F.when(F.col("observed_at").isNull() | (F.col("observed_at") < 0), f"{what}-timestamp"),
    ]
    of_nodes = [*unsafe("node"), F.when(~F.col("kind").isin(*NODE_KINDS), "node-kind"), F.when((F.col("kind") == "Evidence") & (F.size("evidence_ids") > 0), "evidence-of-evidence")]
    of_edges = [*unsafe("edge"), F.when(F.size("evidence_ids") == 0, "edge-without-evidence")]
    out = [df.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), F.col("id").alias("entity_id")) for df, rules in ((nodes, of_nodes), (edges, of_edges))]
    for df, what in ((nodes, "node"), (edges, "edge")):
        out.append(df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"duplicate-{what}").alias("rule"), F.col("id").alias("entity_id")))
    kinds = nodes.select(F.col("id").alias("_id"), F.col("kind").alias("_kind"))
    proofs = kinds.where("_kind = 'Evidence'").select("_id").distinct()
    cited = nodes.select(F.lit("node-evidence").alias("rule"), "id", F.explode("evidence_ids").alias("_cited")).unionByName(edges.select(F.lit("edge-evidence").alias("rule"), "id", F.explode("evidence_ids").alias("_cited")))
    # few are unknown, so what cites them is found without dealing every citation
    unknown = materialize(cited.select("_cited").distinct().join(proofs, F.col("_cited") == F.col("_id"), "left_anti")).toDF("_unknown")
    out.append(cited.join(unknown, F.col("_cited").eqNullSafe(F.col("_unknown")), "left_semi").select("rule", F.col("id").alias("entity_id")).distinct())
    # both ends in one chain of joins; an end with several rows is each of their kinds
    ends = edges.select("id", "kind", "source_id", "target_id").join(kinds.toDF("source_id", "source_kind").withColumn("_s", F.lit(True)), "source_id", "left").join(kinds.toDF("target_id", "target_kind").withColumn("_t", F.lit(True)), "target_id", "left")
    ends = ends.join(F.broadcast(endpoint_rules(spark).withColumn("_allowed", F.lit(True))), ["kind", "source_kind", "target_kind"], "left")
    wrong = [F.when(F.col("_s").isNull(), "missing-source"), F.when(F.col("_t").isNull(), "missing-target"), F.when(F.col("_s") & F.col("_t") & F.col("_allowed").isNull(), "endpoint-kinds")]
    out.append(ends.select(F.explode(F.array_compact(F.array(*wrong))).alias("rule"), F.col("id").alias("entity_id")))
    return union_all(out)


def payload_hash(columns: list[str]) -> Column:
    """SHA-256 of the row as JSON list of sorted [name, value] pairs; null is not the empty string."""
    pairs = [F.to_json(F.array(F.lit(c), F.col(c).cast("string"))) for c in sorted(columns)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *pairs), F.lit("]")), 256)


def batch_hash(rows: DataFrame) -> DataFrame:
    """One order-independent hash of all row hashes: digests of ever wider hash ranges. A range gathers the row hashes that
    begin with the same eight hex digits, a wider one at most 256 digests, so no task holds many."""
    digest = lambda inner: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(inner)), lambda x: x["h"]), ""), 256)
    level = rows.select(F.substring("payload_hash", 1, 8).alias("at"), F.struct(F.col("payload_hash").alias("h")).alias("inner"))
    for width in (6, 4, 2, 0):
        level = level.groupBy("at").agg(digest("inner").alias("h")).select(F.substring("at", 1, width).alias("at"), F.struct("at", "h").alias("inner"))
    return level.agg(digest("inner").alias("batch_hash"))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id", clock: str = "observed_at") -> DataFrame:
    """Newest `clock` wins per key; a tie keeps the current row."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(key).orderBy(F.col(clock).desc(), "_new")
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_new")


def upsert_edges(current: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """As `upsert`, for edges both of whose ends exist."""
    ids = nodes.select(F.col("id").alias("_id"))
    for end in ("source_id", "target_id"):
        incoming = incoming.join(ids, incoming[end] == ids["_id"], "left_semi")
    return upsert(current, incoming)


def statistics(fragments: DataFrame, merged: DataFrame) -> DataFrame:
    """rows in, out, deduplicated, and evidence references kept."""
    kept = merged.agg(F.count("*").alias("rows_out"), F.sum(F.size("evidence_ids")).cast("long").alias("evidence_references"))
    both = fragments.agg(F.count("*").alias("rows_in")).unionByName(kept, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("rows_in", "rows_out", "evidence_references")]).select("rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("deduplicated"), "evidence_references")
