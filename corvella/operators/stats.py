"""Processing statistics over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import duration_ms


def event_logs(events: DataFrame) -> DataFrame:
    """The driver's events as processing logs."""
    ts = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "processing").otherwise("completed")
    return events.select("event_id", F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("group_id"), "user_id", status.alias("status"), ts.alias("started_at"), F.when(status == "completed", F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 1_000_000).cast("long"))).alias("completed_at"))


def totals(logs: DataFrame) -> DataFrame:
    """Counts by status, by topic, and of all."""
    grouped = logs.groupingSets([["status"], ["topic"], []], "status", "topic").agg(F.count("*").alias("n"))
    return grouped.select(F.coalesce("status", F.lit("*")).alias("status"), F.coalesce("topic", F.lit("*")).alias("topic"), "n")


def durations(logs: DataFrame) -> DataFrame:
    ms = duration_ms(F.col("started_at"), F.col("completed_at"))
    return logs.groupBy("topic", "status").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(ms), F.lit(0.0)), 3).alias("avg_ms"))


def mail_totals(logs: DataFrame, mails: Column) -> DataFrame:
    """Events and their mails by status, and of all ('*')."""
    g = logs.rollup("status").agg(F.count("*").alias("n"), F.sum(mails).alias("emails"))
    return g.select(F.coalesce("status", F.lit("*")).alias("status"), "n", "emails")


def batch_totals(batches: DataFrame) -> DataFrame:
    """By status of batches (processed): how many, rows they processed, mean size."""
    return batches.groupBy("status").agg(F.count("*").alias("n"), F.sum("processed").alias("processed"), F.round(F.avg("processed"), 6).alias("avg_processed"))


def saved(rows: DataFrame, by: str, batch: int = 300) -> DataFrame:
    """By group of rows (status): errors, batches, whether a part failed, and 'failed' if nothing was completed."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("storage_errors"), F.count_if(F.col("status") == "completed").alias("ok"))
    return g.select(by, "storage_errors", F.ceil(F.col("n") / batch).alias("batches"), (F.col("storage_errors") > 0).alias("has_partial_failure"), F.when(F.col("ok") == 0, "failed").otherwise("completed").alias("status"))


def health(logs: DataFrame, since) -> DataFrame:
    recent = logs.where(F.col("started_at") >= since)
    out = recent.groupBy("group_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("health", F.when(F.col("completed") > 0, "healthy").otherwise("degraded"))


def health_windows(logs: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """health of each group in sliding windows of event time, for a stream (update mode) as for a table; a window that saw nothing completed is degraded.

    What is later than delay is dropped by the watermark of a stream."""
    w = F.window("started_at", window, slide)
    st = F.col("status")
    out = logs.withWatermark("started_at", delay).groupBy(w.alias("w"), "group_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("total"), F.count_if(st == "completed").alias("completed"), F.count_if(st == "failed").alias("failed"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "group_id", "last_event", "total", "completed", "failed", F.when(F.col("completed") > 0, "healthy").otherwise("degraded").alias("health"))


def silent(windows: DataFrame) -> DataFrame:
    """Each group as of the newest window of all: its own last window, and whether it is healthy there; degraded too if it has gone silent."""
    last = windows.groupBy("group_id").agg(F.max("window_end").alias("last_seen"), F.max_by("health", "window_end").alias("health"))
    gone = F.col("last_seen") < windows.agg(F.max("window_end")).scalar()
    return last.select("group_id", "last_seen", gone.alias("silent"), F.when(gone, "degraded").otherwise(F.col("health")).alias("health"))


def newest(logs: DataFrame, n: int = 100) -> DataFrame:
    return logs.orderBy(F.desc("started_at"), "event_id").limit(n)


def since(logs: DataFrame, as_of, hours: int, status: str | None = None) -> DataFrame:
    """Logs that started in the hours before as_of, of one status or of all."""
    out = logs.where(F.col("started_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    return out if status is None else out.where(F.col("status") == status)


def running(batched: DataFrame, n: int, *by: str) -> DataFrame:
    """Per key of batched rows (batch_no): emails, batches, their mean size, and the size of the last one if it is not full."""
    b = batched.groupBy(*by, "batch_no").agg(F.count("*").alias("size"))
    last = F.max_by("size", "batch_no")
    g = b.groupBy(*by).agg(F.sum("size").alias("emails"), F.count("*").alias("batches"), last.alias("last"))
    mean = F.round(F.try_divide("emails", "batches"), 6)
    return g.select(*by, "emails", "batches", mean.alias("average_batch_size"), F.when(F.col("last") < n, F.col("last")).otherwise(0).cast("long").alias("current_batch_size"))


def counters(batched: DataFrame, failed: Column, *by: str) -> DataFrame:
    """Events, failed ones, and batches of each consumer. Batches are counted, not listed: one count per (key, batch) first."""
    b = batched.groupBy(*by, "user_id", "batch_no").agg(F.count("*").alias("n"), F.count_if(failed).alias("bad"))
    return b.groupBy(*by).agg(F.sum("n").alias("total_events"), F.sum("bad").alias("failed_events"), F.count("*").alias("total_batches"))
