"""Registry documents: parsing, version selection, declarations, and breadth-first expansion over declared names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import uri_component
from ..session import materialize
from .lockfile import declared_as

_MAP = "map<string,string>"
VERSION = f"struct<name:string,version:string,dependencies:{_MAP},devDependencies:{_MAP},peerDependencies:{_MAP},optionalDependencies:{_MAP}>"
PACKUMENT = f"struct<name:string,`dist-tags`:{_MAP},time:{_MAP},maintainers:array<struct<name:string,email:string>>,versions:map<string,{VERSION}>>"
PRECEDENCE = (("peer", "peerDependencies"), ("production", "dependencies"), ("optional", "optionalDependencies"))
MAX_VERSIONS = 25


def parse(documents: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(packages, issues): valid documents as struct column j with sha256; a version's key must equal its payload."""
    read = documents.select(F.sha2(content, 256).alias("sha256"), F.from_json(content, PACKUMENT).alias("j"))
    wrong = F.exists(F.map_entries("j.versions"), lambda e: ~F.coalesce(e["key"] == e["value"]["version"], F.lit(False)))
    code = F.when(F.col("j").isNull() | F.col("j.name").isNull() | F.col("j.versions").isNull(), "invalid-document").when(wrong, "version-mismatch")
    coded = read.withColumn("code", code)
    return coded.where(F.col("code").isNull()).drop("code"), coded.where(F.col("code").isNotNull()).select("sha256", "code")


def selected_versions(packages: DataFrame, requested: DataFrame | None = None, limit: int = MAX_VERSIONS) -> tuple[DataFrame, DataFrame]:
    """(versions, missing): requested (name, version) pairs, else the latest of each package; at most `limit` of each."""
    latest = packages.select(F.col("j.name").alias("name"), F.col("j.dist-tags")["latest"].alias("version"))
    wanted = latest if requested is None else requested.select("name", "version").distinct()
    place = F.row_number().over(Window.partitionBy("name").orderBy("version"))
    wanted = wanted.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")
    known = packages.select(F.col("j.name").alias("name"), "sha256", F.col("j.time").alias("time"), F.explode("j.versions").alias("version", "v"))
    found = wanted.join(known, ["name", "version"]).withColumn("published_at", F.unix_millis(F.try_to_timestamp(F.col("time")[F.col("version")])))
    return found.drop("time"), wanted.join(known.select("name", "version"), ["name", "version"], "left_anti")


def declared(versions: DataFrame) -> DataFrame:
    """DECLARES_DEPENDENCY rows (never DEPENDS_ON: nothing is installed): name, version, dependency, range, type."""
    listed = [declared_as(F.coalesce(F.col(f"v.{column}"), F.expr(f"cast(map() AS {_MAP})")), rank, kind) for rank, (kind, column) in enumerate(PRECEDENCE)]
    rows = versions.select("name", "version", F.explode(F.concat(*listed)).alias("d")).select("name", "version", "d.*")
    return rows.groupBy("name", "version", "dependency").agg(F.max_by(F.struct("range", "dependency_type"), "rank").alias("s")).select("name", "version", "dependency", "s.range", "s.dependency_type")


def maintainer_logical_id(handle: Column) -> Column:
    return F.concat(F.lit("maintainer:npm:"), uri_component(F.lower(handle)))


def expand(roots: DataFrame, declared_names: DataFrame, depth: int = 3, max_packages: int = 100) -> tuple[DataFrame, bool]:
    """(waves, truncated): names reached breadth first from `roots` (name) over (name, dependency), each once.

    Every wave admits its unseen names in order while the package bound allows; what does not fit truncates.
    """
    wave = roots.select("name").distinct().orderBy("name").limit(max_packages + 1)
    wave = materialize(wave.withColumn("depth", F.lit(0)))
    held = wave.count()
    truncated = held > max_packages
    if truncated:
        wave, held = materialize(wave.orderBy("name").limit(max_packages)), max_packages
    seen = wave
    for d in range(1, depth + 1):
        fresh = wave.join(declared_names, "name").select(F.col("dependency").alias("name")).distinct().join(seen.select("name"), "name", "left_anti")
        # one more than fits, so that the cut is noticed; a bounded sort
        ordered = materialize(fresh.orderBy("name").limit(max_packages - held + 1).withColumn("depth", F.lit(d)))
        n = ordered.count()
        if n > max_packages - held:
            truncated = True
            ordered = materialize(ordered.orderBy("name").limit(max_packages - held))
            n = max_packages - held
        if not n:
            break
        held, wave, seen = held + n, ordered, seen.unionByName(ordered)
    return seen, truncated
