"""Registered ingestion, investigation and streaming queries with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence, investigations, temporal
from ..operators.traverse import bounded_traversal
from ..session import materialize, read_table
from ..sources import fragments, lockfile, registry_docs
from ..sources.derived import Graph
from ..streaming import jobs
from .graph_sql import AUTHORITY, GRAPH, edge_of, query
from .traversals import STATES, WHOLE

_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def lockfiles(g: Graph, **carried: Column) -> DataFrame:
    """One lockfile (service_id, content) per order: its distinct parts form a chain of dependencies.

    Every second part is installed below the one before, the others at the top; returned ones among these are not
    installed. Orders of status P have a lockfile of an unsupported version. `carried` are further columns, of the order.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = g.table("lineitem").withColumn("at", F.row_number().over(order))
    once = lines.withColumn("_n", F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy("at"))).where("_n = 1")
    chain = Window.partitionBy("l_orderkey").orderBy("at")
    name = F.concat(F.lit("p"), F.col("l_partkey"))
    rows = once.withColumn("n", F.row_number().over(chain)).withColumn("name", name).withColumn("before", F.lag("name").over(chain)).withColumn("next", F.lead("name").over(chain)).withColumn("next_tax", F.lead("l_tax").over(chain))
    nested = F.concat(F.lit("node_modules/"), "before", F.lit("/node_modules/"), "name")
    path = F.when(F.col("n") % 2 == 0, nested).otherwise(F.concat(F.lit("node_modules/"), "name"))
    needs = lambda test, dependency: F.when(test & dependency.isNotNull(), F.create_map(F.coalesce(dependency, F.lit("")), F.lit("^1.0.0")))
    entry = lambda version, dependency, tax: F.struct(version.alias("version"), needs(tax <= 0.05, dependency).alias("dependencies"), needs(tax > 0.05, dependency).alias("optionalDependencies"))
    installed = F.when(~((F.col("n") > 1) & (F.col("n") % 2 == 1) & (F.col("l_returnflag") == "R")), F.struct(path.alias("path"), entry(F.concat(F.lit("1."), "n", F.lit(".0")), F.col("next"), F.col("next_tax")).alias("e")))
    root = F.when(F.col("n") == 1, F.struct(F.lit("").alias("path"), entry(F.lit(None).cast("string"), F.col("name"), F.col("l_tax")).alias("e")))
    packages = F.map_from_entries(F.flatten(F.collect_list(F.array_compact(F.array(root, installed)))))
    status = g.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(3).alias("lockfileVersion"), *[c.alias(name) for name, c in carried.items()])
    files = rows.groupBy("l_orderkey").agg(packages.alias("packages")).join(status, "l_orderkey")
    return files.select(F.col("l_orderkey").cast("string").alias("service_id"), F.to_json(F.struct("lockfileVersion", "packages")).alias("content"), *carried)


def _read(g: Graph) -> DataFrame:
    return lockfile.read_files(materialize(lockfiles(g)))


def s3_lockfile_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfile.inlined(_read(Graph(spark, sf_dir)), ["service_id"], "entries", "path").select("service_id", "path", "name", "version")


def s3_lockfile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfile.inlined(_read(Graph(spark, sf_dir)), [], "faults", "code").groupBy("code").agg(F.count("*").alias("n"))


def s8_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest installed copy of every declared dependency."""
    found = lockfile.inlined(lockfile.resolve_files(_read(Graph(spark, sf_dir))), ["service_id"], "found", "path")
    return found.select("service_id", "path", "dependency", "candidate", "resolved_version", "dependency_type")


def s9_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfile.inlined(lockfile.resolve_files(_read(Graph(spark, sf_dir))), ["service_id"], "lost", "path").select("service_id", "path", "dependency", "severity")


def s19_lockfile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fragments.dependency_edges(lockfile.resolve_files(_read(Graph(spark, sf_dir))))
    return edges.select("id", "source_logical", "target_logical", "dependency_type", "declared_range", "lockfile_path")


def p15_observed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockfile.observed_packages(lockfile.inlined(_read(Graph(spark, sf_dir)), ["service_id"], "entries", "path"))


def packuments(g: Graph) -> DataFrame:
    """One registry document per brand, maintained by a share of the suppliers; its parts are versions that declare the brands of their order's next part."""
    part = g.table("part").select("p_partkey", "p_brand", "p_size")
    follow = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pairs = g.table("lineitem").withColumn("next", F.lead("l_partkey").over(follow)).where("next IS NOT NULL").select(F.col("l_partkey").alias("p_partkey"), "next").distinct()
    brands = pairs.join(part.select(F.col("p_partkey").alias("next"), F.col("p_brand").alias("dependency"), "p_size"), "next").where("p_size >= 40").select("p_partkey", "dependency").distinct()
    needs = brands.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("dependency", F.lit("*")))).alias("dependencies"))
    version = F.concat_ws(".", F.col("p_size"), F.col("p_partkey"), F.lit("0"))
    rows = part.join(needs, "p_partkey", "left").withColumn("version", version)
    entry = F.struct(F.col("version").alias("key"), F.struct(F.col("p_brand").alias("name"), F.when(F.col("p_partkey") == 7, "other").otherwise(F.col("version")).alias("version"), "dependencies").alias("value"))
    docs = rows.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(entry)).alias("versions"), F.max("version").alias("latest"))
    owned = F.concat(F.lit("Brand#"), F.col("s_suppkey") % 5 + 1, F.floor(F.col("s_suppkey") / 5) % 5 + 1)
    people = g.table("supplier").select(owned.alias("p_brand"), F.struct(F.col("s_name").alias("name")).alias("m")).groupBy("p_brand").agg(F.collect_list("m").alias("maintainers"))
    docs = docs.join(people, "p_brand", "left")
    return docs.select(F.to_json(F.struct(F.col("p_brand").alias("name"), F.create_map(F.lit("latest"), F.col("latest")).alias("dist-tags"), "maintainers", "versions")).alias("content"))


def s2_packument_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of the latest version of every valid document."""
    packages, _ = registry_docs.parse(materialize(packuments(Graph(spark, sf_dir))))
    found, _ = registry_docs.selected_versions(packages)
    return registry_docs.declared(found).select("name", "version", "dependency", "dependency_type")


def s2_packument_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_docs.parse(materialize(packuments(Graph(spark, sf_dir))))[1].groupBy("code").agg(F.count("*").alias("n"))


def t6_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names reached from parts of size 1 over order successors, within the operator's own bounds."""
    g = Graph(spark, sf_dir)
    name = lambda c: F.concat(F.lit("p"), F.col(c))
    follow = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    links = g.table("lineitem").withColumn("next", F.lead("l_partkey").over(follow)).where("next IS NOT NULL").select(name("l_partkey").alias("name"), name("next").alias("dependency")).distinct()
    waves, _ = registry_docs.expand(g.table("part").where("p_size = 1").select(name("p_partkey").alias("name")), materialize(links))
    return waves.select("name", F.col("depth").cast("long").alias("depth"))


def q1_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected versions and problems of one incident per brand: by range, by exact versions (one of them unknown), or by an
    invalid range."""
    g = Graph(spark, sf_dir)
    versions = g.versions().withColumn("version", F.concat("version", F.lit(".0")))
    first = F.min_by(F.concat_ws(".", "p_size", "p_partkey", F.lit("0")), "p_partkey").alias("first")
    brands = g.table("part").groupBy(F.col("p_brand").alias("package")).agg(F.min("p_size").alias("low"), first).withColumn("way", F.right("package", F.lit(1)).cast("int") % 3)
    exact = F.when(F.col("way") == 1, F.array("first", F.lit("0.0.0"))).otherwise(F.array().cast("array<string>"))
    by_range = F.when(F.col("way") == 0, F.concat(F.lit("^"), F.col("low") + 3, F.lit(".0.0 || >=45 <47"))).when(F.col("way") == 2, F.lit("no range"))
    incidents = brands.select(F.concat(F.lit("incident:"), "package").alias("incident_id"), "package", exact.alias("exact"), by_range.alias("range"))
    found, problems = investigations.affected_versions(incidents, versions)
    return found.unionByName(problems, allowMissingColumns=True)


def w6_incident_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    first = investigations.incident_list(g.incidents(), g.affects(), 6)
    last = first.orderBy(F.col("observed_at").desc(), F.col("id").desc()).limit(6).orderBy("observed_at", "id").first()
    page = investigations.incident_list(g.incidents(), g.affects(), 6, (last["observed_at"], last["id"]))
    return page.select("id", "observed_at", "affected_count")


def s12_dependents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigations.dependents_page(Graph(spark, sf_dir).depends_on(), 10).select("target_id", "id", "source_id", F.col("place").cast("long").alias("place"), "truncated")


def q4_package_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return investigations.package_overview(g.versions(), materialize(g.depends_on()), g.affects())


def j5_shared_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigations.shared_authority(Graph(spark, sf_dir).authority().where("kind = 'MAINTAINS'"))


def t5_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First path per service all of whose edges share lockfile evidence of high confidence."""
    g = Graph(spark, sf_dir)
    edges = materialize(g.depends_on())
    trusted = g.evidence().where((F.col("source_type") == "package-lock") & (F.col("confidence") >= 0.8)).select(F.col("id").alias("evidence_id"))
    found = investigations.exposure(bounded_traversal(g.incident_versions(), edges, WHOLE).services, edges, trusted)
    return found.select("incident_id", "root_id", "service_id", F.col("depth").cast("long").alias("depth"), _text("edge_ids").alias("edge_ids"))


def a23_path_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    found = bounded_traversal(g.incident_versions(), materialize(g.depends_on()), WHOLE).services
    paths = found.select("incident_id", F.concat_ws("/", F.col("root_id"), _text("edge_ids")).alias("path_key"), F.col("cur").alias("service_id"), "node_ids")
    return investigations.path_view(paths)


def _shown_paths(g: Graph) -> DataFrame:
    return evidence.keyed(bounded_traversal(g.incident_versions(), materialize(g.depends_on()), WHOLE).services)


def a23_edge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigations.edge_view(_shown_paths(Graph(spark, sf_dir)))


def p13_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is emphasised when every service is selected: with the greatest key of its paths, or, every third, with none of them."""
    paths = materialize(_shown_paths(Graph(spark, sf_dir)))
    named = F.when(F.col("service_id") % 3 == 0, F.lit("none of them")).otherwise(F.max("path_key"))
    return investigations.path_emphasis(paths, paths.groupBy("incident_id", "service_id").agg(named.alias("path_key")))


def q6_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings, their first line as review command."""
    g = Graph(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "reviewing").otherwise("dismissed")
    findings = g.table("orders").select(F.col("o_orderkey").alias("finding_id"), status.alias("status"), F.lit("h").alias("payload_hash"))
    commands = g.table("lineitem").where("l_quantity > 25").select(
        F.col("l_orderkey").alias("finding_id"),
        F.when(F.col("l_returnflag") == "R", "promote").otherwise("dismiss").alias("action"),
        F.when(F.col("l_tax") < 0.02, "stale").otherwise("h").alias("expected_hash"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string")).alias("idempotency_key"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("at"),
    )
    return investigations.review(findings, commands).groupBy("status", "outcome").agg(F.count("*").alias("n"))


def f14_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure ladder of every customer from its orders' priorities and statuses."""
    ids = lambda test: F.collect_set(F.when(test, F.col("o_orderkey")))
    groups = Graph(spark, sf_dir).table("orders").groupBy("o_custkey").agg(
        ids(F.lit(True)).alias("declared"), ids(F.col("o_orderstatus") == "F").alias("resolved"), ids(F.col("o_orderpriority") == "1-URGENT").alias("built"), ids(F.col("o_orderpriority") == "5-LOW").alias("deployed"), ids(F.col("o_totalprice") > 400_000).alias("network")
    )
    reached, stage, said = evidence.ladder({c: F.col(c) for c in ("declared", "resolved", "built", "deployed", "network")})
    return groups.select("o_custkey", reached.cast("long").alias("reached"), stage.alias("stage"), said.alias("conclusion"))


def k6_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of every user's event type, closed by the next different one."""
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("service_id"), F.col("event_type").alias("content"), F.unix_millis(F.col("ts").cast("timestamp")).alias("valid_from"))
    return temporal.close_snapshots(rows)


def f13_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", temporal.iso(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"))


def a21_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest status of every user's job, counted."""
    rows = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("jobs"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("job_id", F.col("user_id"))


def r1_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every job and since when, after streaming all events and before any timeout."""
    changes = jobs.run_to_table(jobs.job_states(_stream(spark, sf_dir)), "update").where("NOT timed_out")
    last = F.max_by(F.struct("status", "at", "events"), "events").alias("s")
    return changes.groupBy("job_id").agg(last).select("job_id", "s.*")


def r2_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_to_table(jobs.first_submissions(_stream(spark, sf_dir).select("event_id", "ts"), "event_id"), "append").agg(F.count("*").alias("n"))


def r2_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as submission of its user's day: the first is accepted, one of another type contradicts it."""
    day = F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    rows = _stream(spark, sf_dir).select(day.alias("idempotency_key"), F.col("event_type").alias("payload"), "event_id", "ts")
    return jobs.submission_outcomes(spark, rows)


def r4_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot history of every user, from a stream of its event types."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("long").alias("service_id"), F.col("event_type").alias("content"), F.unix_millis("ts").alias("valid_from"))
    return jobs.supersede_stream(spark, rows)[0]


def r3_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts from the stream; the last update of each window."""
    updates = jobs.run_to_table(jobs.activity(_stream(spark, sf_dir)), "update")
    return updates.groupBy("start", "event_type").agg(F.max("n").alias("n"))


def r5_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every job, with its payload."""
    at = F.struct(F.unix_millis("ts").alias("at"), "event_id").alias("clock")
    rows = _stream(spark, sf_dir).select("job_id", at, "event_type")
    return jobs.latest_by_key(spark, rows, "job_id", "clock").select("job_id", "clock.at", "clock.event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        s3_lockfile_entries, s3_lockfile_issues, s8_resolutions, s9_unresolved, s19_lockfile_edges, p15_observed_packages, s2_packument_versions, s2_packument_issues, t6_expansion, q1_affected, w6_incident_page, s12_dependents_page,
        q4_package_overview, j5_shared_authority, t5_exposure, a23_path_view, a23_edge_view, p13_emphasis, q6_review, f14_ladder, k6_snapshots, f13_iso, a21_job_stats, r1_job_states, r2_submissions, r2_outcomes, r3_activity, r4_supersession, r5_latest,
    )
}
LOCK = """
at_line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
once AS (SELECT * FROM at_line QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY pos) = 1),
chain AS (SELECT *, row_number() OVER w AS n, 'p' || l_partkey AS name, lag('p' || l_partkey) OVER w AS before FROM once WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)),
placed AS (SELECT c.*, l_orderkey::VARCHAR AS service_id, CASE WHEN n % 2 = 0 THEN 'node_modules/' || before || '/node_modules/' || name ELSE 'node_modules/' || name END AS path, '1.' || n || '.0' AS version,
    NOT (n > 1 AND n % 2 = 1 AND l_returnflag = 'R') AS installed FROM chain c JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'),
wanted AS (SELECT b.service_id, coalesce(a.path, '') AS path, b.name AS dependency, b.path AS candidate, b.version AS resolved_version, CASE WHEN b.l_tax <= 0.05 THEN 'production' ELSE 'optional' END AS dependency_type, b.installed, a.name AS source_name, a.version AS source_version
  FROM placed b LEFT JOIN placed a ON a.l_orderkey = b.l_orderkey AND a.n = b.n - 1 WHERE b.n = 1 OR a.installed)
"""
_LOCK_EDGE = edge_of("'DEPENDS_ON'", "CASE WHEN path = '' THEN 'service:' || service_id ELSE 'pkgver:npm:' || source_name || '@' || source_version END", "'pkgver:npm:' || dependency || '@' || resolved_version", "'package-lock:' || CASE WHEN path = '' THEN '<root>' ELSE path END || '->' || candidate || ':' || dependency || ':' || dependency_type")
_NEXT = "follow AS (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS next FROM lineitem)"
_PACK = f"""{_NEXT},
needs AS (SELECT DISTINCT l_partkey AS p_partkey, b.p_brand AS dependency FROM follow JOIN part b ON b.p_partkey = next WHERE b.p_size >= 40),
latest AS (SELECT p_brand, max(p_size || '.' || p_partkey || '.0') AS version FROM part GROUP BY 1 HAVING NOT bool_or(p_partkey = 7))
"""
ORACLES = {
    "s3_lockfile_entries": query(LOCK, select="SELECT service_id, path, name, version FROM placed WHERE installed UNION ALL SELECT DISTINCT service_id, '', NULL, NULL FROM placed"),
    "s3_lockfile_issues": "SELECT 'unsupported-version' AS code, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0",
    "s8_resolutions": query(LOCK, select="SELECT service_id, path, dependency, candidate, resolved_version, dependency_type FROM wanted WHERE installed"),
    "s9_unresolved": query(LOCK, select="SELECT service_id, path, dependency, CASE dependency_type WHEN 'optional' THEN 'warning' ELSE 'error' END AS severity FROM wanted WHERE NOT installed"),
    "s19_lockfile_edges": query(LOCK, select="SELECT CASE WHEN path = '' THEN 'service:' || service_id ELSE 'pkgver:npm:' || source_name || '@' || source_version END AS source_logical, 'pkgver:npm:' || dependency || '@' || resolved_version AS target_logical, dependency_type, '^1.0.0' AS declared_range, candidate AS lockfile_path, " + _LOCK_EDGE + " AS id FROM wanted WHERE installed"),
    "p15_observed_packages": query(LOCK, select="SELECT service_id, name, count(DISTINCT version) AS versions, CASE WHEN count(DISTINCT version) = 1 THEN min(version) END AS version FROM placed WHERE installed GROUP BY 1, 2"),
    "s2_packument_versions": query(_PACK, select="SELECT p.p_brand AS name, l.version, n.dependency, 'production' AS dependency_type FROM latest l JOIN part p ON p.p_brand = l.p_brand AND p.p_size || '.' || p.p_partkey || '.0' = l.version JOIN needs n USING (p_partkey)"),
    "s2_packument_issues": "SELECT 'version-mismatch' AS code, count(DISTINCT p_brand) AS n FROM part WHERE p_partkey = 7",
    "t6_expansion": query(
        _NEXT,
        """links AS (SELECT DISTINCT 'p' || l_partkey AS name, 'p' || next AS dependency FROM follow WHERE next IS NOT NULL),
        w0 AS (SELECT DISTINCT 'p' || p_partkey AS name, 0::BIGINT AS depth FROM part WHERE p_size = 1 ORDER BY 1 LIMIT 100),
        w1 AS (SELECT DISTINCT dependency AS name, 1::BIGINT AS depth FROM links JOIN w0 USING (name) WHERE dependency NOT IN (SELECT name FROM w0) ORDER BY 1 LIMIT (SELECT 100 - count(*) FROM w0)),
        s1 AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1),
        w2 AS (SELECT DISTINCT dependency AS name, 2::BIGINT AS depth FROM links JOIN w1 USING (name) WHERE dependency NOT IN (SELECT name FROM s1) ORDER BY 1 LIMIT (SELECT 100 - count(*) FROM s1)),
        s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM w2),
        w3 AS (SELECT DISTINCT dependency AS name, 3::BIGINT AS depth FROM links JOIN w2 USING (name) WHERE dependency NOT IN (SELECT name FROM s2) ORDER BY 1 LIMIT (SELECT 100 - count(*) FROM s2))""",
        select="SELECT * FROM s2 UNION ALL SELECT * FROM w3",
    ),
    "q1_affected": """WITH low AS (SELECT p_brand, min(p_size) + 3 AS major, min(p_partkey) AS first, right(p_brand, 1)::INT % 3 AS way FROM part GROUP BY 1),
        found AS (SELECT p_brand, p_partkey * 8 + 1 AS version_id FROM part JOIN low USING (p_brand) WHERE (way = 0 AND (p_size = major OR p_size IN (45, 46))) OR (way = 1 AND p_partkey = first))
        SELECT 'incident:' || p_brand AS incident_id, version_id, NULL AS code FROM found
        UNION ALL SELECT 'incident:' || p_brand, NULL, 'exact-version-missing' FROM low WHERE way = 1
        UNION ALL SELECT 'incident:' || p_brand, NULL, 'invalid-range' FROM low WHERE way = 2
        UNION ALL SELECT 'incident:' || p_brand, NULL, 'range-matches-nothing' FROM low WHERE way <> 1 AND p_brand NOT IN (SELECT p_brand FROM found)""",
    "w6_incident_page": query(
        GRAPH,
        "counted AS (SELECT i.id, i.observed_at, (SELECT least(count(*), 5000) FROM affects a WHERE a.incident_id = i.id) AS affected_count, row_number() OVER (ORDER BY observed_at DESC, id DESC) AS place FROM incidents i)",
        select="SELECT id, observed_at, affected_count FROM counted WHERE place BETWEEN 7 AND 13",
    ),
    "s12_dependents_page": query(GRAPH, "pl AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY id, source_id) AS place, count(*) OVER (PARTITION BY target_id) AS total FROM edges)", select="SELECT target_id, id, source_id, place, total > 10 AS truncated FROM pl WHERE place <= 10"),
    "q4_package_overview": query(
        GRAPH,
        """v AS (SELECT p_partkey * 8 + 1 AS id, p_brand AS package, p_size || '.' || p_partkey AS version FROM part),
        listed AS (SELECT package, array_to_string(list_sort(list(version)), ',') AS listed FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY package ORDER BY version) <= 12) GROUP BY 1),
        used AS (SELECT package, count(DISTINCT source_id) AS dependents, count(DISTINCT source_id) FILTER (source_kind = 'Service') AS services FROM edges JOIN v ON v.id = target_id GROUP BY 1),
        hit AS (SELECT package, count(DISTINCT incident_id) AS incidents FROM affects JOIN v ON v.id = version_id GROUP BY 1),
        total AS (SELECT package, count(*) AS versions FROM v GROUP BY 1)""",
        select="SELECT package, versions, listed, coalesce(dependents, 0) AS dependents, coalesce(services, 0) AS services, coalesce(incidents, 0) AS incidents FROM total JOIN listed USING (package) LEFT JOIN used USING (package) LEFT JOIN hit USING (package)",
    ),
    "j5_shared_authority": query(AUTHORITY, select="SELECT a.target_id AS package_id, b.target_id AS related_id, count(*) AS shared FROM authority a JOIN authority b ON a.source_id = b.source_id AND a.target_id <> b.target_id WHERE a.kind = 'MAINTAINS' AND b.kind = 'MAINTAINS' GROUP BY 1, 2"),
    "t5_exposure": query(
        GRAPH,
        STATES,
        """trusted AS (SELECT id FROM evidence WHERE source_type = 'package-lock' AND confidence >= 0.8), backed AS (SELECT DISTINCT e.id FROM edges e, unnest(e.evidence_ids) u(x) WHERE x IN (SELECT id FROM trusted)),
        ok AS (SELECT p.incident_id, p.root_id, p.service_id, p.depth, p.edge_ids FROM paths p, unnest(p.edge_ids) u(x) GROUP BY 1, 2, 3, 4, 5 HAVING bool_and(x IN (SELECT id FROM backed)))""",
        select="SELECT incident_id, root_id, service_id, depth::BIGINT AS depth, array_to_string(edge_ids, ',') AS edge_ids FROM ok QUALIFY row_number() OVER (PARTITION BY incident_id, root_id, service_id ORDER BY depth, edge_ids) = 1",
    ),
    "a23_path_view": query(
        GRAPH,
        STATES,
        "walked AS (SELECT incident_id, root_id || '/' || array_to_string(edge_ids, ',') AS k, service_id, unnest(node_ids) AS node_id, unnest(range(len(node_ids))) AS layer FROM paths)",
        "firsts AS (SELECT incident_id, node_id, layer FROM walked QUALIFY row_number() OVER (PARTITION BY incident_id, node_id ORDER BY service_id, k, layer) = 1)",
        select="SELECT w.incident_id, w.node_id, count(DISTINCT k) AS path_count, any_value(f.layer)::BIGINT AS layer, min(w.layer)::BIGINT AS least_layer FROM walked w JOIN firsts f USING (incident_id, node_id) GROUP BY 1, 2",
    ),
    "a23_edge_view": query(GRAPH, STATES, select="SELECT incident_id, x AS edge_id, count(DISTINCT path_key) AS path_count, count(DISTINCT service_id) AS service_count FROM paths, unnest(edge_ids) u(x) GROUP BY 1, 2"),
    "p13_emphasis": query(
        GRAPH,
        STATES,
        "named AS (SELECT *, max(path_key) OVER (PARTITION BY incident_id, service_id) AS greatest FROM paths)",
        "chosen AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY incident_id, service_id ORDER BY CASE WHEN service_id % 3 = 0 THEN 0 ELSE (path_key <> greatest)::INT END, ord) = 1)",
        select="SELECT incident_id, service_id, 'node' AS element, x AS id FROM chosen, unnest(node_ids) u(x) UNION ALL SELECT incident_id, service_id, 'edge', x FROM chosen, unnest(edge_ids) u(x)",
    ),
    "q6_review": """WITH f AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'O' THEN 'reviewing' ELSE 'dismissed' END AS status FROM orders),
        c AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 'promoted' ELSE 'dismissed' END AS goal, l_tax < 0.02 AS stale FROM lineitem WHERE l_quantity > 25
          QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice) = 1),
        j AS (SELECT status, goal, CASE WHEN goal IS NULL THEN 'untouched' WHEN status = goal THEN 'repeated' WHEN status = 'dismissed' THEN 'rejected' WHEN stale THEN 'conflict' ELSE 'applied' END AS outcome FROM f LEFT JOIN c USING (id))
        SELECT CASE WHEN outcome = 'applied' THEN goal ELSE status END AS status, outcome, count(*) AS n FROM j GROUP BY 1, 2""",
    "f14_ladder": """WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') > 0 AS r, count(*) FILTER (o_orderpriority = '1-URGENT') > 0 AS b, count(*) FILTER (o_orderpriority = '5-LOW') > 0 AS d, count(*) FILTER (o_totalprice > 400000) > 0 AS n FROM orders GROUP BY 1),
        s AS (SELECT o_custkey, (1 + CASE WHEN r THEN 1 + CASE WHEN b THEN 1 + CASE WHEN d THEN 1 + n::INT ELSE 0 END ELSE 0 END ELSE 0 END)::BIGINT AS reached FROM g)
        SELECT o_custkey, reached, ['declared', 'resolved', 'built', 'deployed', 'network'][reached] AS stage, ['declaration-observed', 'resolution-observed', 'build-observed', 'deployment-observed', 'network-observed'][reached] AS conclusion FROM s""",
    "k6_snapshots": """WITH e AS (SELECT user_id AS service_id, event_type AS content, (epoch_us(ts) // 1000) AS valid_from FROM events),
        c AS (SELECT * FROM e QUALIFY coalesce(lag(content) OVER (PARTITION BY service_id ORDER BY valid_from, content) <> content, true)),
        n AS (SELECT *, lead(valid_from) OVER (PARTITION BY service_id ORDER BY valid_from, content) AS valid_until FROM c) SELECT *, valid_until IS NULL AS is_current FROM n""",
    "f13_iso": "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events",
    "a21_job_stats": "SELECT status, count(*) AS jobs FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1) GROUP BY 1",
    "r1_job_states": """WITH e AS (SELECT user_id AS job_id, event_type, epoch_us(ts) // 1000 AS at, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type) AS n FROM events),
        done AS (SELECT job_id, min(n) AS n FROM e WHERE event_type IN ('purchase', 'error') GROUP BY 1), total AS (SELECT job_id, max(n) AS events FROM e GROUP BY 1)
        SELECT job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, e.at AS at, events
        FROM total LEFT JOIN done USING (job_id) JOIN e USING (job_id) WHERE e.n = coalesce(done.n, total.events)""",
    "r2_outcomes": """SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN event_type = first_value(event_type) OVER w THEN 'repeated' ELSE 'conflict' END AS outcome
        FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY epoch_us(ts) // 1000, event_id)""",
    "r4_supersession": """WITH e AS (SELECT user_id::BIGINT AS service_id, event_type AS content, epoch_us(ts) // 1000 AS valid_from FROM events),
        c AS (SELECT * FROM e QUALIFY coalesce(lag(content) OVER (PARTITION BY service_id ORDER BY valid_from, content) <> content, true)),
        n AS (SELECT *, lead(valid_from) OVER (PARTITION BY service_id ORDER BY valid_from, content) AS valid_until FROM c) SELECT *, valid_until IS NULL AS is_current FROM n""",
    "r2_submissions": "SELECT count(DISTINCT event_id) AS n FROM events",
    "r3_activity": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "r5_latest": "SELECT user_id AS job_id, epoch_us(max(ts)) // 1000 AS at, arg_max(event_id, (epoch_us(ts) // 1000, event_id)) AS event_id, arg_max(event_type, (epoch_us(ts) // 1000, event_id)) AS event_type FROM events GROUP BY 1",
}
