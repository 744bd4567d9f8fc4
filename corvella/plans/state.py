"""Queries of state: tables changed at rest, sinks that take a batch once, streams that close, de-duplicate and watch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions import scalars as S
from ..operators import chunkers, embedding, stats
from ..operators import logs as L
from ..operators.at_rest import Table
from ..sources import files, sinks
from ..sources.files import table
from ..sources.streams import events_stream, shared_folder
from ..streaming import microbatch
from . import pipelines
from .catalogue import _BATCHES, _HASH, CHARACTER, LOGS, _mail_events, docs, query
from .flows import _BAD, probe


def _saved(spark, d) -> Table:
    """Chunks saved as pending, then embedded in two rounds, the first of which comes twice; every third document is still to come."""
    chunks = chunkers.chunk(docs(spark, d)).select("chunk_id", "doc_id", "chunk_index", "text_content")
    saved = embedding.pending(chunks)
    t = Table(shared_folder(spark), "chunk_id", saved.schema, 16).create(spark)
    t.change(saved, 1)
    for version, part in ((2, 0), (3, 1), (2, 0)):
        waiting = t.read(spark).where(f"doc_id % 3 = {part} AND embedding_status = 'pending'").select("chunk_id", "text_content")
        t.change(embedding.outcomes(embedding.embed(waiting, probe, batch=30, attempts=1)), version)
    return t


@query(CHARACTER + f"SELECT CASE WHEN doc_id % 3 = 2 THEN 'pending' WHEN {_BAD} THEN 'failed' ELSE 'completed' END AS embedding_status, count(*) AS n, count(*) FILTER (doc_id % 3 < 2 AND NOT ({_BAD})) AS with_id, count(*) FILTER (doc_id % 3 < 2 AND {_BAD}) AS with_error FROM chunks GROUP BY 1")
def chunk_status_at_rest(spark, d):
    return _saved(spark, d).read(spark).groupBy("embedding_status").agg(F.count("*").alias("n"), F.count("embedding_id").alias("with_id"), F.count("embedding_error").alias("with_error"))


@query(CHARACTER + "SELECT doc_id, chunk_index, substring(sha256(doc_id || '|character|' || chunk_index), 1, 24) AS chunk_id, substring(text_content, 1, 200) AS text_preview, 'text/markdown' AS content_type, 'character' AS strategy, cast(length(text_content) AS varchar) AS size FROM chunks JOIN embeddings ON vec_id = doc_id AND chunk_index = vec_id % 3")
def chunk_payloads(spark, d):
    """What is stored with each vector: fixed keys and the chunk's metadata, which wins."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3).alias("chunk_index"), "embedding")
    chunks = chunkers.with_metadata(chunkers.chunk(docs(spark, d)), "character", Options(), content_type=F.lit("text/markdown"))
    p = pipelines.index(chunks, e)
    return p.select("doc_id", "chunk_index", *[F.col("payload")[k].alias(n) for k, n in (("chunk_id", "chunk_id"), ("text_preview", "text_preview"), ("content_type", "content_type"), ("chunking_strategy", "strategy"), ("chunk_size", "size"))])


@query(_HASH + "SELECT doc_id, n AS file_size, quick_hash, CASE WHEN doc_id % 10 = 0 THEN 'again' ELSE 'first' END AS seen FROM h WHERE doc_id % 10 <> 1")
def blobs_at_rest(spark, d):
    """Blobs saved with their metadata; every tenth saved again later, and others deleted."""
    content = F.col("text").cast("binary")
    b = docs(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("n"), S.quick_hash(F.lit("doc.md"), content).alias("quick_hash"), content.alias("content")).select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.col("n").alias("file_size"), "quick_hash", "content", F.lit("first").alias("seen"))
    path = shared_folder(spark)
    files.save(spark, b, path, 1, 8)
    files.save(spark, b.where("doc_id % 10 = 0").withColumn("seen", F.lit("again")), path, 2, 8)
    t = Table(path, "document_id", b.schema, 8)
    t.delete(b.where("doc_id % 10 = 1"), 3)
    return t.read(spark).where("octet_length(content) = file_size").select("doc_id", "file_size", "quick_hash", "seen")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, 1::bigint AS batches FROM events GROUP BY event_type")
def stream_sink_once(spark, d):
    """The sink after two runs from the start, as after a lost checkpoint."""
    e, out = events_stream(spark, d).select("event_id", "event_type"), shared_folder(spark)
    for run in ("first", "second"):
        sinks.stream_once(e, f"{out}/sink", "events", f"{out}/{run}")
    return sinks.committed(spark, f"{out}/sink", e.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.countDistinct("batch").alias("batches"))


@query(_BATCHES + """SELECT user_id, b AS batch_no, count(*) AS n, arg_min(event_id, rn) AS first_id, CASE WHEN count(*) >= 5 THEN 'full' WHEN b < max(b) OVER (PARTITION BY user_id) OR any_value(f) // 1000 + 172800000 < (SELECT epoch_ms(max(ts)) FROM events) THEN 'timeout' ELSE 'shutdown' END AS reason
 FROM r GROUP BY user_id, b""")
def stream_closed_batches(spark, d):
    """All batches: full ones, those closed by the timer, and those that the end of the stream closes."""
    out = shared_folder(spark)
    source = events_stream(spark, d).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("closing"))
    spark.createDataFrame([], source.schema).write.parquet(f"{out}/closing")
    run = lambda: microbatch.once(microbatch.closed_batches(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{out}/closing")), 5, 48 * 3600, "0 seconds"), f"{out}/rows", f"{out}/state")
    run()
    end = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 SECOND")).first()[0]
    microbatch.close_open(spark, f"{out}/state", F.lit(end)).write.mode("append").parquet(f"{out}/closing")
    run()
    return spark.read.schema(microbatch.CLOSED).parquet(f"{out}/rows")


@query("SELECT event_type, count(*) AS n, cast(sum(event_id) AS bigint) AS ids FROM events GROUP BY event_type")
def stream_deduplicated(spark, d):
    """Each event is delivered three times and counted once."""
    out = shared_folder(spark)
    e = events_stream(spark, d).select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("delivery"))
    microbatch.once(microbatch.deduplicated(e).select("event_id", "event_type"), f"{out}/rows", f"{out}/state")
    return spark.read.schema("event_id long, event_type string").parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_WINDOWS = LOGS + """, w AS (SELECT *, (epoch_us(started_at) // 3600000000 - k) * 3600000000 AS s FROM logs, (SELECT unnest([0, 1, 2]) AS k)),
 h AS (SELECT s AS window_start, group_id, max(event_id) AS last_event, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM w GROUP BY s, group_id) """


def _watched(spark, d) -> DataFrame:
    """Windows of three hours, one each hour, as a stream has written them."""
    out = shared_folder(spark)
    w = stats.health_windows(stats.event_logs(events_stream(spark, d)), "3 hours", "1 hour", "3 hours")
    sinks.stream_once(w, f"{out}/sink", "health", f"{out}/state", "update")
    return sinks.latest(spark, f"{out}/sink", w.schema, "window_start", "group_id")


@query(_WINDOWS + "SELECT *, CASE WHEN completed > 0 THEN 'healthy' ELSE 'degraded' END AS health FROM h")
def stream_health_windows(spark, d):
    return _watched(spark, d).withColumn("window_start", F.unix_micros("window_start")).drop("window_end")


@query(_WINDOWS + ", l AS (SELECT group_id, max(window_start) AS last, arg_max(completed, window_start) AS c FROM h GROUP BY group_id) SELECT group_id, last + 10800000000 AS last_seen, last < (SELECT max(last) FROM l) AS silent, CASE WHEN last < (SELECT max(last) FROM l) OR c = 0 THEN 'degraded' ELSE 'healthy' END AS health FROM l")
def stream_health_now(spark, d):
    return stats.silent(_watched(spark, d)).withColumn("last_seen", F.unix_micros("last_seen"))


@query("""SELECT conv_id || ':' || turn % 3 AS email_id, cast(turn AS integer) AS pos, CASE WHEN turn % 4 = 0 THEN 'high' ELSE 'normal' END AS importance, CASE WHEN turn % 2 = 0 THEN role || ',k' ELSE '' END AS keywords, CASE WHEN turn % 3 = 0 THEN role || '.pdf=' || length(text) ELSE '' END AS files FROM conversations""")
def email_fields(spark, d):
    e = pipelines.emails(_mail_events(spark, d))
    return e.select("email_id", "pos", "importance", F.array_join("keywords", ",").alias("keywords"), F.array_join(F.transform("attachments", lambda a: F.concat_ws("=", a["name"], a["size"].cast("string"))), ",").alias("files"))


def _processed(spark, d) -> tuple[DataFrame, DataFrame]:
    events = _mail_events(spark, d)
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("event_id"))
    return events, pipelines.process_emails(events, done, embed=lambda e: embedding.embed(e, probe, "content", batch=20, attempts=1, at_once=3))


_MAILS = """WITH e AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)),
 m AS (SELECT conv_id, CASE WHEN length(text) > 0 AND length(text) % 13 = 0 THEN 'failed' ELSE 'completed' END AS status FROM e WHERE n = 1) """


@query(_MAILS + "SELECT cast(conv_id % 5 AS varchar) AS account_id, status, count(*) AS n FROM m GROUP BY ALL")
def email_status(spark, d):
    return _processed(spark, d)[1].groupBy("account_id", "status").agg(F.count("*").alias("n"))


@query(_MAILS + """, o AS (SELECT conv_id, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'completed' END AS s FROM m GROUP BY conv_id), c AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY conv_id)
 SELECT coalesce(s, 'processing') AS status, count(*) AS n, cast(sum(k) AS bigint) AS emails FROM c LEFT JOIN o USING (conv_id) GROUP BY 1""")
def email_event_stats(spark, d):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    return L.email_stats(pipelines.log_emails(*_processed(spark, d), at(1), at(2)))
