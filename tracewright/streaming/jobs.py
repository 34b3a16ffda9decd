"""Jobs and snapshots as streams: state machine with timeouts, idempotent submission, windowed counts, supersession."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import upsert
from ..operators.temporal import close_snapshots
from ..session import shared_dir

#: How long a job may run without an event, how long a finished one is kept, how late an event may be, and which event leads to which status.
ACTIVE_TIMEOUT_MS, RETENTION_MS, LATE_MS = 15 * 60_000, 60 * 60_000, 10 * 60_000
TERMINAL = ("completed", "partially_completed", "failed")
STATUS = {"signup": "queued", "click": "running", "view": "running", "purchase": "completed", "error": "failed"}
OUTPUT = "job_id long, status string, at long, events long, timed_out boolean"
_COLUMNS = ["job_id", "status", "at", "events", "timed_out"]


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One job's events in time order; a terminal status stays, a silent active job times out as failed.

    A finished job leaves the state after its retention, so the state holds active and recent jobs only.
    """
    status, at, n = state.get if state.exists else (None, 0, 0)
    if state.hasTimedOut:
        state.remove()
        if status not in TERMINAL:
            yield pd.DataFrame([(key[0], "failed", at + ACTIVE_TIMEOUT_MS, n, True)], columns=_COLUMNS)
        return
    rows = pd.concat(list(batches)).sort_values(["at", "event_type"], kind="stable")
    for event_type, when in zip(rows["event_type"], rows["at"], strict=True):
        n += 1
        if status not in TERMINAL:
            status, at = STATUS.get(event_type, status), int(when)
    state.update((status, at, n))
    state.setTimeoutTimestamp(max(at + (RETENTION_MS if status in TERMINAL else ACTIVE_TIMEOUT_MS), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(key[0], status, at, n, False)], columns=_COLUMNS)


def job_states(events: DataFrame) -> DataFrame:
    """Status changes of jobs from a stream (job_id, event_type, ts): job_id, status, at (ms), events so far, timed_out."""
    rows = events.withWatermark("ts", "10 minutes").select("job_id", "event_type", "ts", F.unix_millis("ts").alias("at"))
    return rows.groupBy("job_id").applyInPandasWithState(_advance, OUTPUT, "status string, at long, events long", "update", GroupStateTimeout.EventTimeTimeout)


def first_submissions(events: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    """Idempotent submission: the first event of each key inside the watermark; repeats are dropped."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling counts by event type, late events within the watermark included."""
    grouped = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.unix_millis("w.start").alias("start"), "event_type", "n")


def run_to_table(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what its source holds now, into a table in shared storage, and read that."""
    spark = stream.sparkSession
    base = shared_dir(spark)

    def write(batch: DataFrame, number: int) -> None:
        # a replayed batch writes the same folder again
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={number:08d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(each or write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data/batch=*")


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}*.parquet")


def submission_outcomes(spark: SparkSession, stream: DataFrame, base: str | None = None) -> DataFrame:
    """event_id, outcome of a stream of submissions (idempotency_key, payload, event_id, ts): in time order the first of a key
    is accepted, others repeat it or contradict its payload (conflict).

    The accepted payloads are a table, made anew by each batch; a key leaves it when it has been silent for the retention
    (and ten minutes for late submissions). Restarts as `latest_by_key`.
    """
    base = base or shared_dir(spark)
    key = "idempotency_key"

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(key, "payload", "event_id", F.unix_millis("ts").alias("at"), F.lit(True).alias("_new"))
        if number:
            known = spark.read.parquet(f"{base}/known/version={number - 1}")
            rows = rows.unionByName(known.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        first = Window.partitionBy(key).orderBy("_new", "at", "event_id")
        same = F.col("payload") == F.first("payload").over(first)
        outcome = F.when(F.row_number().over(first) == 1, "accepted").when(same, "repeated").otherwise("conflict")
        said = rows.withColumn("outcome", outcome).where("_new").select("event_id", "outcome")
        said.write.mode("overwrite").parquet(f"{base}/data/batch={number}")
        kept = rows.groupBy(key).agg(F.min_by("payload", F.struct("_new", "at", "event_id")).alias("payload"), F.max("at").alias("at"))
        newest = rows.agg((F.max("at") - LATE_MS - RETENTION_MS).alias("_silent"))
        kept.join(F.broadcast(newest), F.col("at") >= F.col("_silent")).drop("_silent").write.mode("overwrite").parquet(f"{base}/known/version={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, outcome string").parquet(f"{base}/data/batch=*")


def supersede(current: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, quarantined): new snapshots close the open one of their service; those older than it are set aside."""
    opened = current.where("is_current").select("service_id", F.col("valid_from").alias("_open"))
    placed = arrived.join(opened, "service_id", "left")
    late = F.col("_open").isNotNull() & (F.col("valid_from") < F.col("_open"))
    fresh = placed.where(~late).select("service_id", "content", "valid_from")
    return close_snapshots(current.select("service_id", "content", "valid_from").unionByName(fresh)), placed.where(late).drop("_open")


def latest_by_key(spark: SparkSession, stream: DataFrame, key: str, clock: str, base: str | None = None) -> DataFrame:
    """Guarded upsert of a stream: the newest `clock` wins, each batch merged into a new version of the table.

    With `base`, the stream goes on where an earlier run with that folder ended: batch n merges into version n - 1, which
    is found in storage.
    """
    base = base or shared_dir(spark)

    def each(batch: DataFrame, number: int) -> None:
        current = spark.read.parquet(f"{base}/data/version={number - 1}") if number else batch.limit(0)
        upsert(current, upsert(batch.limit(0), batch, key, clock), key, clock).write.mode("overwrite").parquet(f"{base}/data/version={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.parquet(f"{base}/data")
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")


def supersede_stream(spark: SparkSession, stream: DataFrame, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(history, quarantined) after a stream of snapshots (service_id, content, valid_from): each batch supersedes the open
    snapshot of its services; those older than it are set aside. Restarts as `latest_by_key`."""
    base = base or shared_dir(spark)
    start = "service_id long, content string, valid_from long, valid_until long, is_current boolean"

    def each(batch: DataFrame, number: int) -> None:
        current = spark.read.parquet(f"{base}/history/version={number - 1}") if number else spark.createDataFrame([], start)
        history, late = supersede(current, batch)
        history.write.mode("overwrite").parquet(f"{base}/history/version={number}")
        late.write.mode("overwrite").parquet(f"{base}/late/version={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    history, late = spark.read.parquet(f"{base}/history"), spark.read.parquet(f"{base}/late")
    newest = history.agg(F.max("version")).first()[0]
    return history.where(F.col("version") == newest).drop("version"), late.drop("version")
