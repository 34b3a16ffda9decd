"""Graph and release snapshots in shared storage: staged writes that are verified before a manifest publishes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.firewall import NODE_KINDS, TRUST
from ..operators.merge import violations


class SnapshotError(RuntimeError):
    """A snapshot that is absent, incomplete or already there."""


@dataclass(frozen=True)
class SnapshotStore:
    """Immutable snapshots below one path, each a folder of node and edge tables and a manifest with their counts."""

    spark: SparkSession
    path: str

    def _at(self, snapshot_id: str, part: str) -> str:
        return f"{self.path}/snapshot_id={snapshot_id}/{part}"

    def write(self, snapshot_id: str, nodes: DataFrame, edges: DataFrame, validate: bool = False) -> None:
        """Stage both tables, read them back, compare counts, then write the manifest. An existing snapshot is not replaced."""
        if validate:
            broken = violations(nodes, edges).limit(1).collect()
            if broken:
                raise SnapshotError(f"invalid graph: {broken[0].rule} {broken[0].entity_id}")
        counts = {}
        for part, table in (("nodes", nodes), ("edges", edges)):
            table.write.mode("errorifexists").parquet(self._at(snapshot_id, part))
            counts[part] = self.spark.read.parquet(self._at(snapshot_id, part)).count()
        ends = self.spark.read.parquet(self._at(snapshot_id, "edges"))
        known = self.spark.read.parquet(self._at(snapshot_id, "nodes")).select(F.col("id").alias("_id"))
        lost = sum(ends.join(known, ends[c] == known["_id"], "left_anti").limit(1).count() for c in ("source_id", "target_id"))
        state = "failed" if lost else "ready"
        manifest = self.spark.createDataFrame([(snapshot_id, counts["nodes"], counts["edges"], state)], "snapshot string, nodes long, edges long, state string")
        manifest.coalesce(1).write.mode("errorifexists").json(self._at(snapshot_id, "manifest"))
        if lost:
            raise SnapshotError(f"snapshot {snapshot_id} has edges without ends")

    def read(self, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a ready snapshot whose tables still have the manifest's counts."""
        try:
            manifest = self.spark.read.json(self._at(snapshot_id, "manifest")).first()
        except Exception as e:
            raise SnapshotError(f"no snapshot {snapshot_id}") from e
        if manifest is None or manifest.state != "ready":
            raise SnapshotError(f"snapshot {snapshot_id} is not ready")
        nodes, edges = (self.spark.read.parquet(self._at(snapshot_id, part)) for part in ("nodes", "edges"))
        if (nodes.count(), edges.count()) != (manifest.nodes, manifest.edges):
            raise SnapshotError(f"snapshot {snapshot_id} is not whole")
        return nodes, edges


def decode_release_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, issues) from stored rows (id, kind, trust, evidence_ids JSON): enumerations, sorted distinct ids."""
    ids = F.from_json("evidence_ids", "array<bigint>")
    sound = ids.isNotNull() & (ids == F.array_sort(F.array_distinct(ids)))
    code = F.when(~F.col("kind").isin(*NODE_KINDS), "kind").when(~F.col("trust").isin(*TRUST), "trust").when(~F.coalesce(sound, F.lit(False)), "evidence-ids").when(F.col("id").isNull() | (F.col("id") < 0), "id")
    coded = rows.withColumn("code", code).withColumn("ids", ids)
    return coded.where(F.col("code").isNull()).select("id", "kind", "trust", F.col("ids").alias("evidence_ids")), coded.where(F.col("code").isNotNull()).select("id", "code")
