"""The two ingestion flows as single plans: files to indexed chunks, e-mail events to documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import Options
from ..functions import scalars as S
from ..operators import chunkers, logs, numbering, tables


def ingest(uploads: DataFrame, processed: DataFrame, max_bytes: int, strategy: str = "character", options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(uploads with their status, chunks of those that are new). uploads: doc_id, text; processed: doc_id."""
    u = uploads.select("doc_id", "text", F.octet_length("text").alias("file_size"), S.quick_hash(F.lit("doc.md"), F.col("text").cast("binary")).alias("quick_hash"))
    u = tables.mark_duplicates(u).join(processed.select("doc_id", F.lit(True).alias("done")).distinct(), "doc_id", "left")
    status = F.when(F.col("file_size") > max_bytes, "failed").when(F.col("status") == "duplicate", "duplicate").when(F.col("done"), "skipped").otherwise("completed")
    u = u.withColumn("status", status)
    return u, chunkers.chunk(u.where("status = 'completed'"), strategy, **(chunkers.sizes(options, strategy) if options else {}))


def index(chunks: DataFrame, embeddings: DataFrame, content_type: str = "pdf") -> DataFrame:
    """Vector rows of the chunks that have an embedding; embeddings without a chunk are dropped and not counted.

    payload: what a search gives back with a vector, keys of chunk_metadata (if there is such a column) before fixed ones."""
    joined = embeddings.join(chunks, ["doc_id", "chunk_index"])
    preview = F.substring("text_content", 1, 200)
    parts = {"chunk_id": F.col("chunk_id"), "document_id": F.col("doc_id"), "chunk_index": F.col("chunk_index"), "text_preview": preview, "content_type": F.lit(content_type)}
    fixed = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("string"))])
    metadata = F.col("chunk_metadata") if "chunk_metadata" in chunks.columns else F.lit(None).cast("map<string,string>")
    return joined.select("doc_id", "chunk_index", "chunk_id", "embedding", preview.alias("text_preview"), tables.merge_payload(fixed, metadata).alias("payload"), F.lit("completed").alias("embedding_status"))


def quarantine(failed: DataFrame, chunks: DataFrame) -> DataFrame:
    return failed.join(chunks.select("doc_id", "chunk_index", "chunk_id"), ["doc_id", "chunk_index"]).select("doc_id", "chunk_id", F.size("embedding").cast("long").alias("vector_size"), F.lit(0).cast("long").alias("retry_count"), F.lit("pending_retry").alias("status"))


def emails(events: DataFrame) -> DataFrame:
    """Flat e-mail documents of JSON events (column value); nested nulls give defaults."""
    e = events.select(F.from_json("value", schemas.EMAIL_EVENT).alias("e")).select("e.event_id", "e.account_id", F.posexplode("e.response_data.value").alias("pos", "m"))
    return e.select(
        S.email_document_id(F.col("m.id")).alias("document_id"), F.col("m.id").alias("email_id"), "account_id", "event_id", "pos",
        F.coalesce("m.subject", F.lit("")).alias("subject"), F.coalesce("m.from_address.emailAddress.address", F.lit("")).alias("sender"), F.col("m.received_date_time").alias("received_datetime"),
        F.coalesce("m.body.content", F.lit("")).alias("content"), F.coalesce("m.is_read", F.lit(False)).alias("is_read"), F.coalesce("m.has_attachments", F.lit(False)).alias("has_attachments"),
        F.coalesce("m.importance", F.lit("normal")).alias("importance"), F.coalesce("m.keywords", F.array().cast("array<string>")).alias("keywords"), _attachments(F.col("m.attachments")).alias("attachments"), F.lit("processing").alias("status"),
    )


def _attachments(a: Column) -> Column:
    """name, size and url of each, as mail.attachment_rows takes them."""
    return F.transform(F.coalesce(a, F.array().cast("array<struct<id:string,name:string,contentType:string,size:long,contentLocation:string>>")), lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size"), x["contentLocation"].alias("url")))


def process_emails(events: DataFrame, done: DataFrame, batch: int = 20, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Skips completed events, flattens, keeps the first of each e-mail id, batches by account and embeds non-empty bodies.

    embed: adds embedding_status by content, as embedding.embed does. A mail has failed if its embedding has; without embed all are completed."""
    e = emails(events).join(done.select("event_id").distinct(), "event_id", "left_anti")
    e = tables.first_wins(e, "email_id", "event_id", "pos")
    e = numbering.batched(e, batch, "account_id", "event_id", "pos", "email_id").withColumn("embeds", F.length("content") > 0)
    if embed is None:
        return e.withColumn("status", F.lit("completed"))
    return embed(e).withColumn("status", F.when(F.col("embedding_status") == "failed", "failed").otherwise("completed"))


def log_emails(events: DataFrame, processed: DataFrame, started: Column, ended: Column) -> DataFrame:
    """The log of JSON e-mail events: a start with the number of mails; an end, failed if one of its processed mails is, for those that have some."""
    e = events.select(F.from_json("value", schemas.EMAIL_EVENT).alias("e")).select("e.event_id", F.col("e.response_data.value").alias("mails"))
    outcome = processed.groupBy("event_id").agg(F.count_if(F.col("status") == "failed").alias("bad"))
    error = F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" e-mails failed")))
    return logs.email_started(e, started).unionByName(logs.finished(outcome, "email", "event_id", ended, error))
