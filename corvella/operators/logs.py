"""Processing logs as append-only rows: a start, then a completion or a failure. The current state is a view of them.

Kinds are 'event', 'email', 'batch' and 'document'. Times are columns of the input, never the clock, and ids are hashes
of kind and key, so that a replay appends rows that change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import short_sha

COLUMNS = ("log_id", "kind", "key", "status", "at", "error", "details")
# The order in which a key can go through its states when times tie.
STATES = ("uploaded", "pending", "processing", "failed", "skipped", "completed")


def entries(rows: DataFrame, kind: str, key: str, status: Column, at: Column, error: Column | None = None, details: dict[str, Column] | None = None) -> DataFrame:
    """One log row for each row of the input; a null key has no log and gives none."""
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    k = F.col(key).cast("string")
    return rows.where(k.isNotNull()).select(
        short_sha("log:", 24, F.lit(f"{kind}:"), k).alias("log_id"), F.lit(kind).alias("kind"), k.alias("key"), status.alias("status"), at.cast("timestamp").alias("at"),
        (F.lit(None) if error is None else error).cast("string").alias("error"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("details"),
    )


def started(rows: DataFrame, kind: str, key: str, at: Column, **details: Column) -> DataFrame:
    return entries(rows, kind, key, F.lit("processing"), at, details=details)


def finished(rows: DataFrame, kind: str, key: str, at: Column, error: Column | None = None, **details: Column) -> DataFrame:
    """completed, or failed where there is an error."""
    e = F.lit(None).cast("string") if error is None else error
    return entries(rows, kind, key, F.when(e.isNull(), "completed").otherwise("failed"), at, e, details)


def _rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))


def current(log: DataFrame) -> DataFrame:
    """The last state of each key, with the times of its start and end and the error of that state."""
    last = F.struct("at", _rank().alias("r"))
    when = lambda s, f: f(F.when(F.col("status") == s, F.col("at")))
    g = log.groupBy("log_id", "kind", "key").agg(
        F.max_by(F.struct("status", "error"), last).alias("s"), when("processing", F.min).alias("started_at"), when("completed", F.max).alias("completed_at"), when("failed", F.max).alias("failed_at"))
    return g.select("log_id", "kind", "key", "s.status", "s.error", "started_at", "completed_at", "failed_at")


def history(log: DataFrame) -> DataFrame:
    """The states each key went through, in order; equal rows of a replay count once."""
    steps = F.array_sort(F.collect_set(F.struct("at", _rank().alias("r"), "status")))
    return log.groupBy("log_id", "kind", "key").agg(F.transform(steps, lambda s: s["status"]).alias("states"))


def email_started(events: DataFrame, at: Column, key: str = "event_id", mails: str = "mails") -> DataFrame:
    """The start of an e-mail event, with the number of its mails (an array); null and empty arrays count 0."""
    return started(events, "email", key, at, email_count=F.greatest(F.coalesce(F.size(mails), F.lit(0)), F.lit(0)))


def email_stats(log: DataFrame) -> DataFrame:
    """Per state of e-mail events: how many, and their mails."""
    mails = log.where("kind = 'email'").groupBy("log_id").agg(F.max(F.col("details")["email_count"].cast("long")).alias("mails"))
    return current(log.where("kind = 'email'")).join(mails, "log_id").groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("mails", F.lit(0))).alias("emails"))


def batch_stats(log: DataFrame) -> DataFrame:
    """Per state of batches: how many, rows they processed, mean seconds from start to end."""
    processed = log.groupBy("log_id").agg(F.max(F.col("details")["processed_count"].cast("long")).alias("processed"))
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1_000_000
    return current(log.where("kind = 'batch'")).join(processed, "log_id").groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("processed", F.lit(0))).alias("processed"), F.round(F.avg(seconds), 6).alias("avg_seconds"))
