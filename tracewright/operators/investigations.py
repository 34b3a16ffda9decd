"""Incident, package and finding queries: affected versions, lists by keyset page, overviews, the review life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semver import in_range, valid_range
from ..session import materialize

#: Bounds of the lists.
AFFECTED_SHOWN, OVERVIEW_LIMIT, MAX_AFFECTED = 5000, 12, 10_000
#: Review states from which a decision may lead on, and where to.
DECISIONS = {"dismiss": "dismissed", "promote": "promoted"}
OPEN_STATES = ("open", "reviewing")


def affected_versions(incidents: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(affected, problems) of incidents (incident_id, package, exact array, range) over versions (id, package, version).

    Exact versions must exist; a range must be valid and match something unless exact versions were given; more than
    MAX_AFFECTED versions are a problem. Ranges are tested once per distinct (version, range).
    """
    named = incidents.join(versions, "package")
    exact = named.where(F.array_contains("exact", F.col("version")))
    pairs = named.where(F.col("range").isNotNull()).select("version", "range").distinct().withColumn("_in", in_range("version", "range")).where("_in")
    ranged = named.join(pairs.drop("_in"), ["version", "range"])
    found = exact.select("incident_id", F.col("id").alias("version_id")).union(ranged.select("incident_id", F.col("id").alias("version_id"))).distinct()
    asked = incidents.select("incident_id", "package", F.explode("exact").alias("version"))
    say = lambda df, code: df.select("incident_id", F.lit(code).alias("code")).distinct()
    missing = say(asked.join(versions, ["package", "version"], "left_anti"), "exact-version-missing")
    bad = say(incidents.where(F.col("range").isNotNull() & ~valid_range("range")), "invalid-range")
    nothing = say(incidents.where(F.size("exact") == 0).join(found, "incident_id", "left_anti"), "range-matches-nothing")
    many = say(found.groupBy("incident_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_AFFECTED), "too-many-versions")
    return found, missing.union(bad).union(nothing).union(many)


def keyset_page(rows: DataFrame, order: list[tuple[str, bool]], limit: int, after: tuple | None = None) -> DataFrame:
    """The `limit` + 1 rows after a position; order is (column, descending). One more than asked tells of a next page."""
    if after is not None:
        beyond: Column = F.lit(False)
        for k, (column, down) in reversed(list(enumerate(order))):
            c, v = F.col(column), F.lit(after[k])
            beyond = ((c < v) if down else (c > v)) | ((c == v) & beyond)
        rows = rows.where(beyond)
    return rows.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in order]).limit(limit + 1)


def incident_list(incidents: DataFrame, affects: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """A page of incidents, newest first, with their affected versions counted up to the bound."""
    counts = affects.groupBy("incident_id").agg(F.least(F.count("*"), F.lit(AFFECTED_SHOWN)).alias("affected_count"))
    page = keyset_page(incidents, [("observed_at", True), ("id", True)], limit, after)
    return page.join(counts.withColumnRenamed("incident_id", "id"), "id", "left").withColumn("affected_count", F.coalesce("affected_count", F.lit(0)))


def dependents_page(edges: DataFrame, limit: int) -> DataFrame:
    """The first `limit` dependents of every version by (edge, dependent), and whether there are more."""
    by = Window.partitionBy("target_id")
    placed = edges.withColumn("place", F.row_number().over(by.orderBy("id", "source_id"))).withColumn("total", F.count("*").over(by))
    return placed.where(F.col("place") <= limit).select("target_id", "id", "source_id", "place", (F.col("total") > limit).alias("truncated"))


def package_overview(versions: DataFrame, edges: DataFrame, affects: DataFrame, limit: int = OVERVIEW_LIMIT) -> DataFrame:
    """Per package: versions, dependents (services among them), incidents, and the versions listed up to `limit`."""
    dependents = edges.select(F.col("target_id").alias("id"), "source_id", "source_kind").join(versions.select("id", "package"), "id")
    used = dependents.groupBy("package").agg(F.count_distinct("source_id").alias("dependents"), F.count_distinct(F.when(F.col("source_kind") == "Service", F.col("source_id"))).alias("services"))
    hit = affects.join(versions.select(F.col("id").alias("version_id"), "package"), "version_id").groupBy("package").agg(F.count_distinct("incident_id").alias("incidents"))
    shown = versions.withColumn("_n", F.row_number().over(Window.partitionBy("package").orderBy("version"))).where(F.col("_n") <= limit)
    listed = shown.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("version")), ",").alias("listed"))
    total = versions.groupBy("package").agg(F.count("*").alias("versions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return total.join(listed, "package").join(used, "package", "left").join(hit, "package", "left").select("package", "versions", "listed", zero("dependents"), zero("services"), zero("incidents"))


def shared_authority(maintains: DataFrame) -> DataFrame:
    """Other packages of a package's maintainers: package_id, related_id, shared maintainers.

    Joined through distinct (maintainer, package) pairs; both sides of the result are packages, not lines.
    """
    pairs = maintains.select(F.col("source_id").alias("maintainer"), F.col("target_id").alias("package_id")).distinct()
    other = pairs.withColumnRenamed("package_id", "related_id")
    return pairs.join(other, "maintainer").where("package_id <> related_id").groupBy("package_id", "related_id").agg(F.count("*").alias("shared"))


def exposure(states: DataFrame, edges: DataFrame, trusted: DataFrame) -> DataFrame:
    """First path per incident, root and service of which every edge shares evidence with the trusted set: incident_id, root_id, service_id, depth, path."""
    ids = trusted.select("evidence_id").distinct()
    paths = states.where("terminal")
    walked = edges.join(materialize(paths.select(F.explode("edge_ids").alias("id")).distinct()), "id", "left_semi")
    backed = walked.select("id", F.explode("evidence_ids").alias("evidence_id")).join(ids, "evidence_id", "left_semi").select("id").distinct()
    hops = paths.select("incident_id", "root_id", "cur", "depth", "edge_ids", F.explode("edge_ids").alias("id")).join(backed.withColumn("ok", F.lit(1)), "id", "left")
    whole = hops.groupBy("incident_id", "root_id", "cur", "depth", "edge_ids").agg(F.count("ok").alias("n")).where(F.col("n") == F.col("depth"))
    first = F.row_number().over(Window.partitionBy("incident_id", "root_id", "cur").orderBy("depth", "edge_ids"))
    return whole.withColumn("_n", first).where("_n = 1").select("incident_id", "root_id", F.col("cur").alias("service_id"), "depth", "edge_ids")


def review(findings: DataFrame, commands: DataFrame) -> DataFrame:
    """Findings (finding_id, status, payload_hash) after review commands (finding_id, action, expected_hash, idempotency_key, at).

    Of several commands the earliest counts. It applies if the finding is open and its hash is unchanged; the same
    decision again is `repeated`, another one on a decided finding `rejected`, a changed hash `conflict`.
    """
    first = F.row_number().over(Window.partitionBy("finding_id").orderBy("at", "idempotency_key"))
    command = commands.withColumn("_n", first).where("_n = 1").drop("_n")
    goal = F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])[F.col("action")]
    joined = findings.join(command, "finding_id", "left")
    outcome = (
        F.when(F.col("action").isNull(), "untouched")
        .when(goal.isNull(), "rejected")
        .when(F.col("status") == goal, "repeated")
        .when(~F.col("status").isin(*OPEN_STATES), "rejected")
        .when(F.col("payload_hash") != F.col("expected_hash"), "conflict")
        .otherwise("applied")
    )
    return joined.withColumn("outcome", outcome).select("finding_id", F.when(F.col("outcome") == "applied", goal).otherwise(F.col("status")).alias("status"), "outcome")


def promoted_incidents(findings: DataFrame, reviewed: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidents, affects) of promoted findings: an open interval from detection on, and the exact observed versions."""
    promoted = findings.join(reviewed.where("outcome = 'applied' AND status = 'promoted'").select("finding_id"), "finding_id", "left_semi")
    incidents = promoted.select(F.concat(F.lit("incident:"), "finding_id").alias("logical_id"), F.col("detected_at").alias("interval_start"), F.lit(None).cast("long").alias("interval_end"), "package")
    affects = promoted.join(versions, ["package", "version"]).select(F.concat(F.lit("incident:"), "finding_id").alias("incident"), F.col("id").alias("version_id"))
    return incidents, affects


def path_view(paths: DataFrame) -> DataFrame:
    """Nodes of every incident's service paths with the keys of the paths through them and the layer where each is first seen."""
    walked = paths.select("incident_id", "path_key", "service_id", F.posexplode("node_ids").alias("layer", "node_id"))
    return walked.groupBy("incident_id", "node_id").agg(F.count_distinct("path_key").alias("path_count"), F.min_by("layer", F.struct("service_id", "path_key", "layer")).cast("long").alias("layer"), F.min("layer").cast("long").alias("least_layer"))


def edge_view(paths: DataFrame) -> DataFrame:
    """Edges of every incident's service paths with the number of paths and of services that run over them."""
    walked = paths.select("incident_id", "path_key", "service_id", F.explode("edge_ids").alias("edge_id"))
    return walked.groupBy("incident_id", "edge_id").agg(F.count_distinct("path_key").alias("path_count"), F.count_distinct("service_id").alias("service_count"))


def path_emphasis(paths: DataFrame, selected: DataFrame) -> DataFrame:
    """incident_id, service_id, element (node or edge), id: what a selection (incident_id, service_id, path_key) emphasises.

    It is the named path of the service; its first (by `ord`) if none is named or the name is not one of its paths; nothing
    for an unknown service. Of several selections of a service the least path_key counts.
    """
    key = ["incident_id", "service_id"]
    chosen = selected.groupBy(*key).agg(F.min("path_key").alias("wanted"))
    order = F.struct((F.col("path_key") != F.coalesce("wanted", F.lit(""))).alias("other"), "ord")
    best = paths.join(chosen, key).groupBy(*key).agg(F.min_by(F.struct("node_ids", "edge_ids"), order).alias("p"))
    listed = lambda kind, c: F.transform(F.col(f"p.{c}"), lambda x: F.struct(F.lit(kind).alias("element"), x.alias("id")))
    return best.select(*key, F.explode(F.concat(listed("node", "node_ids"), listed("edge", "edge_ids"))).alias("x")).select(*key, "x.*")
