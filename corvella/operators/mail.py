"""E-mails with their attachments and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import attachment_id, embedding_id
from . import tables
from .embedding import in_order, timed

Fetcher = Callable[[str], tuple[int, bytes]]


def fetch(rows: DataFrame, fetcher: Fetcher, url: str = "url", at_once: int = 8, timeout: float | None = 30.0) -> DataFrame:
    """rows with content and fetch_error. Only an answer of 200 gives content; another status, an error of the fetcher, or no
    answer within timeout seconds is the row's error. Null and empty urls are not fetched and are errors. A task has at most
    at_once fetches in flight and holds twice as many answers; rows keep their order."""
    kept = rows.drop("content", "fetch_error")
    schema = kept.withColumns({"content": F.lit(None).cast("binary"), "fetch_error": F.lit(None).cast("string")}).schema

    def one(address: str | None) -> tuple[bytes | None, str | None]:
        if not address:
            return None, "no download url"
        try:
            status, body = timed(lambda: fetcher(address), timeout)
        except Exception as e:  # any error of the service is the row's error
            return None, str(e)
        return (body, None) if status == 200 else (None, f"HTTP {status}")

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = ((record.slice(at, 1), u) for record in records for at, u in enumerate(record.column(url).to_pylist()))
        for (part, _), (content, error) in in_order(single, lambda x: one(x[1]), at_once):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*part.schema.names, "content", "fetch_error"])

    return kept.mapInArrow(run, schema)


def attachment_rows(mails: DataFrame, base: str, allowed: str, max_bytes: int, fetched: Column | None = None) -> DataFrame:
    """One row for each element of attachments (name, size, url) of each mail (email_id, account_id), with its path or its error.

    fetched is the error of the fetch, null where it worked; nothing is fetched where it is left out. Mails without
    attachments give no rows."""
    rows = mails.select("email_id", "account_id", F.posexplode("attachments").alias("pos", "a")).select("email_id", "account_id", "pos", "a.name", "a.size", "a.url")
    error = tables.attachment_error(F.col("name"), F.col("size"), F.col("url"), allowed, max_bytes)
    error = error if fetched is None else F.coalesce(error, fetched)
    placed = tables.attachment_paths(rows.withColumn("error", error), base)
    return placed.select(
        attachment_id(F.col("email_id"), F.concat_ws(":", "pos", "name")).alias("attachment_id"), "email_id", "account_id", "pos", "name", "size",
        F.when(F.col("error").isNull(), F.col("file_path")).alias("file_path"), "error", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"))


def back_references(embedded: DataFrame) -> DataFrame:
    """The embedding id that each embedded mail refers to, to be upserted on document_id."""
    return embedded.where("embedding_status = 'completed'").select("document_id", embedding_id(F.col("document_id")).alias("embedding_id"))


def push_ids(mails: DataFrame, attachments: DataFrame, key: str = "email_id") -> DataFrame:
    """mails with attachment_ids: those they had, then those of their attachment rows in order, each once."""
    new = attachments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "attachment_id"))).alias("_new"))
    none = F.array().cast("array<string>")
    had = F.coalesce("attachment_ids", none) if "attachment_ids" in mails.columns else none
    out = mails.join(new, key, "left")
    return out.withColumn("attachment_ids", F.array_distinct(F.concat(had, F.coalesce(F.col("_new.attachment_id"), none)))).drop("_new")


def hydrate(mails: DataFrame, vectors: DataFrame, attachments: DataFrame, key: str = "email_id") -> DataFrame:
    """Every mail with its vector (null if none) and its attachments in order (empty if none). vectors: one row a key."""
    a = attachments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "status"))).alias("attachments"))
    none = F.array().cast("array<struct<pos:int,name:string,status:string>>")
    out = mails.drop("attachments").join(vectors.select(key, "embedding"), key, "left").join(a, key, "left")
    return out.withColumn("attachments", F.coalesce(F.col("attachments").cast("array<struct<pos:int,name:string,status:string>>"), none))


def roll_up(mails: DataFrame, attachments: DataFrame, *by: str) -> DataFrame:
    """Mails, and attachments that were kept and that failed, of each batch."""
    a = attachments.groupBy("email_id").agg(F.count_if(F.col("status") == "completed").alias("ok"), F.count_if(F.col("status") == "failed").alias("bad"))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return mails.join(a, "email_id", "left").groupBy(*by).agg(F.count("*").alias("emails"), zero("ok").alias("attachments_saved"), zero("bad").alias("attachments_failed"))
