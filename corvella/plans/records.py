"""Queries of records in and out: blobs, lookups, fetches, messages, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunkers, embedding, mail, routing, stats, tables
from ..sources.files import table
from ..streaming import microbatch
from .catalogue import _BATCHES, _HASH, _NAME, CHARACTER, LOGS, _files, _hashed, docs, logs, query
from .flows import _BAD, _embedded, _mails, probe


def _uploads(spark, d) -> DataFrame:
    kind = F.expr("CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' ELSE 'application/octet-stream' END")
    return _files(spark, d).select(F.col("page_id").alias("doc_id"), F.col("name").alias("filename"), kind.alias("content_type"))


@query(f"""SELECT page_id AS doc_id, k AS content_type, cast(octet_length(encode(text)) AS bigint) AS n_bytes, CASE WHEN k = 'application/pdf' OR ends_with(lower(name), '.pdf') THEN 'pdf' WHEN k = 'text/markdown' OR ends_with(lower(name), '.md') THEN 'markdown' END AS extractor,
 CASE WHEN k = 'application/octet-stream' AND NOT (ends_with(lower(name), '.pdf') OR ends_with(lower(name), '.md')) THEN 'Unsupported content type: ' || k END AS extract_error
 FROM (SELECT page_id, {_NAME} AS name, CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' ELSE 'application/octet-stream' END AS k FROM pages) JOIN documents ON doc_id = page_id""")
def upload_blobs(spark, d):
    blobs = docs(spark, d).select("doc_id", F.col("text").cast("binary").alias("content"))
    t = tables.with_content(_uploads(spark, d), blobs)
    return t.select("doc_id", "content_type", F.octet_length("content").cast("long").alias("n_bytes"), "extractor", "extract_error")


@query(_HASH + "SELECT doc_id, n FROM h WHERE quick_hash IN (SELECT quick_hash FROM h WHERE doc_id % 100 = 0)")
def upload_lookup_hash(spark, d):
    """The uploads that have the hash of one of the stated documents: every hundredth id."""
    h = _hashed(spark, d)
    return h.join(h.where("doc_id % 100 = 0").select("quick_hash"), "quick_hash", "left_semi").select("doc_id", "n")


@query(CHARACTER + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM chunks WHERE chunk_index = 2)")
def unprocessed_documents(spark, d):
    u = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    t = docs(spark, d)
    return tables.unprocessed(t, u, chunkers.chunk(t).where("chunk_index = 2")).select("doc_id")


def answer(url: str) -> tuple[int, bytes]:
    """A service that SQL can follow: it breaks down on urls of a length that 7 divides, and has none that 5 divides."""
    if len(url) % 7 == 0:
        raise OSError("connection lost")
    return (404, b"") if len(url) % 5 == 0 else (200, url.encode())


@query("SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'no download url' WHEN length(url) % 7 = 0 THEN 'connection lost' WHEN length(url) % 5 = 0 THEN 'HTTP 404' END AS fetch_error, CASE WHEN page_id % 11 <> 0 AND length(url) % 7 <> 0 AND length(url) % 5 <> 0 THEN cast(octet_length(encode(url)) AS bigint) END AS n_bytes FROM pages")
def attachment_fetch(spark, d):
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 11 != 0, F.col("url")).alias("url"))
    return mail.fetch(p, answer).select("page_id", "fetch_error", F.octet_length("content").cast("long").alias("n_bytes"))


@query("SELECT conv_id || ':' || turn AS email_id, CASE WHEN turn % 2 = 0 THEN substring(sha256('attach:' || conv_id || ':' || turn || ':0:' || role || '.txt'), 1, 16) || '|' || substring(sha256('attach:' || conv_id || ':' || turn || ':1:b.exe'), 1, 16) ELSE '' END AS ids FROM conversations")
def attachment_push(spark, d):
    m, a = _mails(spark, d)
    return mail.push_ids(m, a).select("email_id", F.array_join("attachment_ids", "|").alias("ids"))


@query("SELECT document_id, substring(sha256('emb:' || document_id), 1, 16) AS embedding_id FROM (SELECT conv_id || ':' || turn AS document_id, text FROM conversations) WHERE length(text) > 0 AND length(text) % 13 <> 0")
def email_back_references(spark, d):
    m = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("document_id"), "text")
    return mail.back_references(embedding.embed(m, probe, "text", batch=20, attempts=2))


@query("""SELECT 'document.uploaded' AS topic, cast(doc_id AS varchar) AS key, '{"event_type":"document.uploaded","document_id":"' || doc_id || '","content_type":"text/markdown","file_size":' || octet_length(encode(text)) || ',"uploaded_at":"2024-01-01T00:00:00.000000"}' AS value FROM documents""")
def publish_uploaded(spark, d):
    u = docs(spark, d).select(
        F.lit("document.uploaded").alias("event_type"), F.col("doc_id").cast("string").alias("document_id"), F.lit("text/markdown").alias("content_type"), F.octet_length("text").alias("file_size"), F.make_timestamp_ntz(*[F.lit(x) for x in (2024, 1, 1, 0, 0, 0)]).alias("uploaded_at"))
    return routing.messages(u, F.col("event_type"), "document_id", "event_type", "document_id", "content_type", "file_size", "uploaded_at")


@query("""SELECT user_id % 4 AS "partition", event_id AS "offset", cast(user_id AS varchar) AS key, props AS value, epoch_us(ts) AS ts_us FROM events ORDER BY 1, 2 LIMIT 50""")
def dead_letter_scan(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))
    return routing.browse(e).withColumn("ts_us", F.unix_micros("timestamp")).drop("timestamp")


@query(LOGS + "SELECT event_id, topic FROM logs WHERE status = 'failed' AND started_at >= (SELECT max(ts) - INTERVAL 48 HOUR FROM events)")
def failed_since(spark, d):
    as_of = logs(spark, d).agg(F.max("started_at")).scalar()
    return stats.since(logs(spark, d), as_of, 48, "failed").select("event_id", "topic")


@query(CHARACTER + f"SELECT doc_id, cast(ceil(count(*) / 300.0) AS bigint) AS batches, count(*) AS total_chunks, count(*) FILTER (NOT {_BAD}) AS embedded, count(*) FILTER ({_BAD}) AS embedding_errors, 'character' AS strategy FROM chunks GROUP BY doc_id")
def document_stats(spark, d):
    return embedding.document_stats(_embedded(spark, d), "character")


@query(_BATCHES + "SELECT user_id, cast(sum(n) AS bigint) AS emails, count(*) AS batches, round(sum(n) / count(*), 6) AS average_batch_size, CASE WHEN arg_max(n, b) < 5 THEN arg_max(n, b) ELSE 0 END AS current_batch_size FROM (SELECT user_id, b, count(*) AS n FROM r GROUP BY ALL) GROUP BY user_id")
def batcher_stats(spark, d):
    return stats.running(microbatch.batches(table(spark, d, "events"), 5, 48 * 3600), 5, "user_id")


@query(_BATCHES + ", k AS (SELECT r.user_id, b, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM r JOIN events USING (event_id) GROUP BY ALL) SELECT user_id % 4 AS consumer, cast(sum(n) AS bigint) AS total_events, cast(sum(bad) AS bigint) AS failed_events, count(*) AS total_batches FROM k GROUP BY 1")
def consumer_counters(spark, d):
    e = table(spark, d, "events")
    b = microbatch.batches(e, 5, 48 * 3600).join(e.select("event_id", "event_type"), "event_id")
    return stats.counters(b.withColumn("consumer", F.col("user_id") % 4), F.col("event_type") == "error", "consumer")
