"""Mutations as DataFrame operations: upsert, delete, status logs, dedup, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CONTENT_TYPES, by_extension, extractor, safe_name


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Rows of new replace those of old; without a window over untouched rows.

    Of rows of new with one key, that with the highest version stays, or any one where there is no version."""
    if version is None:
        last = new.dropDuplicates([key])
    else:
        rows = F.struct(*[F.col(c) for c in new.columns])
        last = new.groupBy(F.col(key).alias("_key")).agg(F.max_by(rows, F.col(version)).alias("r")).where("r IS NOT NULL").select("r.*")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(last)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def latest(log: DataFrame, key: str, value: str, at: str, *tie: str) -> DataFrame:
    """The last value of each key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(at, *tie)).alias(value), F.max(at).alias(at))


def mark_duplicates(new: DataFrame, known: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """existing_id: the known document with the hash, else the first of the batch that has it. A null hash equals no other.

    The first of a hash is a partial aggregate, so that a hash shared by most files makes no group of theirs, and only hashes that
    occur twice are joined: where they are few, Spark broadcasts them. new is read twice; let it hold the hash, not the content."""
    twice = new.groupBy("quick_hash").agg(F.min(order).alias("first_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = new.join(twice, "quick_hash", "left")
    out = out.withColumn("existing_id", F.when(F.col("first_id") != F.col(order), F.col("first_id")))
    if known is not None:
        k = known.groupBy("quick_hash").agg(F.min(order).alias("known_id"))
        out = out.join(k, "quick_hash", "left").withColumn("existing_id", F.coalesce("known_id", "existing_id")).drop("known_id")
    return out.drop("first_id").withColumn("status", F.when(F.col("existing_id").isNotNull(), "duplicate").otherwise("uploaded"))


def unprocessed(docs: DataFrame, uploads: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with neither a completed upload nor a chunk. Null keys are kept: nothing says they were processed."""
    return docs.join(uploads.where("status = 'completed'").select(key), key, "left_anti").join(chunks.select(key), key, "left_anti")


def with_content(uploads: DataFrame, blobs: DataFrame, key: str = "doc_id") -> DataFrame:
    """uploads (content_type, filename) joined with their blobs (content), and the extractor each takes or its error."""
    handler = extractor(F.col("content_type"), F.col("filename"))
    error = F.when(handler.isNull(), F.concat(F.lit("Unsupported content type: "), F.coalesce("content_type", F.lit(""))))
    return uploads.join(blobs.select(key, "content"), key).withColumns({"extractor": handler, "extract_error": error})


def merge_payload(fixed: Column, metadata: Column) -> Column:
    """Both maps as one; keys of the metadata win. A null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    fixed, metadata = F.coalesce(fixed, empty), F.coalesce(metadata, empty)
    return F.map_concat(F.map_filter(fixed, lambda k, v: ~F.map_contains_key(metadata, k)), metadata)


def retry_candidates(failures: DataFrame, max_retries: int = 3) -> DataFrame:
    return failures.where((F.col("status") == "pending_retry") & (F.col("retry_count") < max_retries))


def replay(events: DataFrame) -> DataFrame:
    """Failed events with the retry count raised, ready to be appended to the source."""
    return events.where("status = 'failed'").withColumn("retry_count", F.coalesce("retry_count", F.lit(0)) + 1).withColumn("is_retry", F.lit(True))


def attachment_error(name: Column, size: Column, url: Column, allowed: str, max_bytes: int, enabled: bool = True) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    ok = F.array_contains(F.transform(F.split(F.lit(allowed), ","), lambda s: F.trim(s)), suffix)
    return F.when(F.lit(not enabled), "download disabled").when(size > max_bytes, "file too large").when(~ok, "file type not allowed").when(F.coalesce(url, F.lit("")) == "", "no download url")


def attachment_paths(df: DataFrame, base: str) -> DataFrame:
    """Path below base, with _1, _2 ... before the suffix of names met before; every part is made safe."""
    safe = df.withColumn("safe", safe_name(F.col("name")))
    w = Window.partitionBy("account_id", "email_id", "safe").orderBy("pos")
    n = F.row_number().over(w) - 1
    stem, suffix = F.regexp_replace("safe", r"\.[^.]*$", ""), F.regexp_extract("safe", r"(\.[^.]*)$", 1)
    return safe.withColumn("n", n).select("*", F.concat_ws("/", F.lit(base), safe_name(F.col("account_id")), safe_name(F.col("email_id")), F.when(F.col("n") == 0, F.col("safe")).otherwise(F.concat(stem, F.lit("_"), F.col("n").cast("string"), suffix))).alias("file_path"))


def routed(events: DataFrame) -> DataFrame:
    """The handler of each event: by topic, else by type, else the dead-letter table."""
    by_type = by_extension(F.col("filename"), {e: e[1:] for e in CONTENT_TYPES})
    return events.withColumn("handler", F.coalesce(by_type, F.lit("dead_letter")))
