"""Idempotent submissions as a stream: order, conflicts, keys known from earlier batches, forgotten keys."""

import datetime

from tracewright.session import shared_dir
from tracewright.streaming import jobs

SCHEMA = "idempotency_key string, payload string, event_id long, ts timestamp"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_outcomes_over_batches(spark):
    path, base = shared_dir(spark), shared_dir(spark)
    batches = [
        [("k", "x", 2, at(1)), ("k", "y", 1, at(1)), ("k", "y", 3, at(2)), ("old", "x", 4, at(0)), ("none", None, 5, at(0)), ("none", None, 6, at(1))],
        [("k", "y", 7, at(0)), ("k", "x", 8, at(30)), ("other", "x", 9, at(90))],
        [("old", "z", 10, at(91)), ("k", "x", 11, at(92))],
    ]
    for rows in batches:  # each run goes on with what the one before it left in storage
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        said = jobs.submission_outcomes(spark, spark.readStream.schema(SCHEMA).parquet(path), base)
    assert {r.event_id: r.outcome for r in said.collect()} == {
        1: "accepted", 2: "conflict", 3: "repeated", 4: "accepted", 5: "accepted", 6: "conflict", 7: "repeated", 8: "conflict", 9: "accepted", 10: "accepted", 11: "conflict",
    }
    assert said.count() == 11
