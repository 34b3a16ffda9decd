"""Inclusive intervals with open ends: overlap, path and service validity, incident windows, snapshot history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = (1 << 63) - 1


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Do two inclusive intervals meet? A null end is open."""
    return F.greatest(a_start, b_start) <= F.least(F.coalesce(a_end, F.lit(FOREVER)), F.coalesce(b_end, F.lit(FOREVER)))


def overlap_class(valid_from: Column, valid_until: Column, start: Column, end: Column) -> Column:
    """during, outside, or unknown where the validity has no beginning."""
    return F.when(valid_from.isNull(), "unknown").when(overlaps(valid_from, valid_until, start, end), "during").otherwise("outside")


def iso(millis: Column) -> Column:
    """ISO-8601 text in UTC (the session's time zone must be UTC)."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def path_validity(on_paths: DataFrame) -> DataFrame:
    """Per path the intersection of its edges' known validities: latest beginning, earliest end."""
    known = F.col("valid_from").isNotNull()
    return on_paths.groupBy("incident_id", "root_id", "service_id", "path_key").agg(
        F.max("valid_from").alias("opens"), F.min(F.when(known, F.col("valid_until"))).alias("closes"), F.count_if(~known).alias("unknown_edges")
    )


def service_validity(paths: DataFrame) -> DataFrame:
    """Per incident and service the hull of its paths' validities; open as soon as one path is; paths without one are counted."""
    known = F.col("opens").isNotNull()
    return paths.groupBy("incident_id", "service_id").agg(
        F.min("opens").alias("opens"),
        F.when(~F.coalesce(F.some(known & F.col("closes").isNull()), F.lit(False)), F.max(F.when(known, F.col("closes")))).alias("closes"),
        F.count_if(~known).alias("unknown_paths"),
        F.count("*").alias("path_count"),
    )


def incident_partition(services: DataFrame, incidents: DataFrame) -> DataFrame:
    """Services of every incident by overlap with its interval (incidents: id, interval_start, interval_end): their number,
    how many have a partial history, and `has_unknown`: whether any has none or a partial one."""
    spans = incidents.select(F.col("id").alias("incident_id"), "interval_start", "interval_end")
    classed = services.join(spans, "incident_id").withColumn("overlap", overlap_class(F.col("opens"), F.col("closes"), F.col("interval_start"), F.col("interval_end")))
    counted = classed.groupBy("incident_id", "overlap").agg(F.count("*").alias("service_count"), F.count_if((F.col("unknown_paths") > 0) & F.col("opens").isNotNull()).alias("partial_history"))
    unknown = classed.groupBy("incident_id").agg(F.some(F.col("unknown_paths") > 0).alias("has_unknown"))
    return counted.join(unknown, "incident_id")


def interval_join(spans: DataFrame, incidents: DataFrame, on: list[str]) -> DataFrame:
    """Spans (valid_from, valid_until) and incidents (interval_start, interval_end) of one key that overlap.

    An equi-join on `on` with the overlap as residual condition; spans without a beginning are `unknown` and stay.
    """
    joined = spans.join(incidents, on)
    kind = overlap_class(F.col("valid_from"), F.col("valid_until"), F.col("interval_start"), F.col("interval_end"))
    return joined.withColumn("overlap", kind)


def close_snapshots(snapshots: DataFrame, key: str = "service_id") -> DataFrame:
    """Lockfile history: each snapshot ends where the next of its service begins; the latest stays open.

    Consecutive snapshots of equal content are one; ties in time go by content.
    """
    order = Window.partitionBy(key).orderBy("valid_from", "content")
    changed = snapshots.withColumn("_before", F.lag("content").over(order)).where(F.col("_before").isNull() | (F.col("_before") != F.col("content"))).drop("_before")
    return changed.withColumn("valid_until", F.lead("valid_from").over(order)).withColumn("is_current", F.col("valid_until").isNull())
