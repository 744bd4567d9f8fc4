"""Queries of the flows: embedding with failures, logs, routing, mails with attachments, batches closed by a timer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunkers, embedding, mail, routing
from ..operators import logs as L
from ..sources.files import table
from ..streaming import microbatch
from .catalogue import _BATCHES, CHARACTER, docs, query


def probe(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can follow: length and number of spaces. It refuses calls with a text whose length 13 divides."""
    if any(len(t) % 13 == 0 for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def _embedded(spark, d) -> DataFrame:
    return embedding.embed(chunkers.chunk(docs(spark, d)), probe, batch=30, attempts=2)


_BAD = "length(text_content) % 13 = 0"


@query(CHARACTER + f"SELECT doc_id, chunk_index, CASE WHEN {_BAD} THEN 'failed' ELSE 'completed' END AS embedding_status, CASE WHEN {_BAD} THEN 'refused' END AS embedding_error, CASE WHEN NOT {_BAD} THEN length(text_content) END AS n_chars, CASE WHEN NOT {_BAD} THEN length(text_content) - length(replace(text_content, ' ', '')) END AS n_spaces FROM chunks")
def embed_chunks(spark, d):
    x = F.col("embedding")
    return _embedded(spark, d).select("doc_id", "chunk_index", "embedding_status", "embedding_error", x[0].cast("long").alias("n_chars"), x[1].cast("long").alias("n_spaces"))


@query(CHARACTER + f"SELECT doc_id, chunk_index, substring(sha256(doc_id || '|character|' || chunk_index), 1, 24) AS chunk_id, 'refused' AS error, 0::bigint AS retry_count, 'pending_retry' AS status FROM chunks WHERE {_BAD}")
def embed_failures(spark, d):
    return embedding.failures(_embedded(spark, d))


@query(CHARACTER + f", g AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (NOT {_BAD}) AS embedded, count(*) FILTER ({_BAD}) AS embedding_errors FROM chunks GROUP BY doc_id) SELECT *, embedding_errors > 0 AS has_partial_failure, CASE WHEN embedded = 0 AND embedding_errors > 0 THEN 'failed' ELSE 'completed' END AS status FROM g")
def embed_document_status(spark, d):
    return embedding.document_status(_embedded(spark, d))


@query()
def chunk_coverage_all(spark, d):
    t = docs(spark, d)
    return reduce(DataFrame.unionByName, [chunkers.coverage_of(chunkers.chunk_arrays(t, s, contents=False)).withColumn("strategy", F.lit(s)) for s in chunkers.STRATEGIES])


def _event_log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(ts) + F.round(F.abs("value") * 1_000_000).cast("long"))
    error = F.when(F.col("event_type") == "error", "handler failed")
    return L.started(e, "event", "event_id", ts, event_type=F.col("event_type")).unionByName(L.finished(e.where("event_type <> 'view'"), "event", "event_id", end, error))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'completed' END AS status, CASE event_type WHEN 'error' THEN 'handler failed' END AS error, epoch_us(ts) AS started_us,
 CASE WHEN event_type <> 'view' THEN epoch_us(ts) + cast(round(abs(value) * 1000000) AS bigint) END AS ended_us FROM events""")
def event_log_current(spark, d):
    c = L.current(_event_log(spark, d))
    return c.select(F.col("key").cast("long").alias("event_id"), "status", "error", F.unix_micros("started_at").alias("started_us"), F.unix_micros(F.coalesce("completed_at", "failed_at")).alias("ended_us"))


@query("""WITH b AS (SELECT user_id % 4 AS g, event_id // 20 AS k, min(ts) AS s, max(ts) AS e, count(*) AS c, count(*) FILTER (event_type = 'error') > 1 AS bad FROM events GROUP BY ALL)
 SELECT CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, count(*) AS n, cast(sum(c) AS bigint) AS processed, round(avg(CASE WHEN NOT bad THEN (epoch_us(e) - epoch_us(s)) / 1000000 END), 6) AS avg_seconds FROM b GROUP BY bad""")
def batch_log_stats(spark, d):
    key = F.concat_ws(":", (F.col("user_id") % 4).cast("string"), F.expr("event_id div 20").cast("string"))
    ts = F.col("ts").cast("timestamp")
    b = table(spark, d, "events").groupBy(key.alias("batch_id")).agg(F.min(ts).alias("s"), F.max(ts).alias("e"), F.count("*").alias("c"), (F.count_if(F.col("event_type") == "error") > 1).alias("bad"))
    log = L.started(b, "batch", "batch_id", F.col("s")).unionByName(L.finished(b, "batch", "batch_id", F.col("e"), F.when(F.col("bad"), "too many errors"), processed_count=F.col("c")))
    return L.batch_stats(log)


@query("SELECT doc_id, 'uploaded>processing>' || CASE WHEN octet_length(encode(text)) > 20000 THEN 'failed' ELSE 'completed' END AS states FROM documents")
def document_lifecycle(spark, d):
    t = docs(spark, d).select("doc_id", (F.octet_length("text") > 20000).alias("large"))
    at = lambda s: F.timestamp_seconds(F.lit(s))
    log = L.entries(t, "document", "doc_id", F.lit("uploaded"), at(0)).unionByName(L.started(t, "document", "doc_id", at(1))).unionByName(L.finished(t, "document", "doc_id", at(2), F.when(F.col("large"), "file too large")))
    return L.history(log.unionByName(log)).select(F.col("key").cast("long").alias("doc_id"), F.array_join("states", ">").alias("states"))


_ROUTED = """WITH e AS (SELECT event_id, props, CASE event_type WHEN 'purchase' THEN 'document.uploaded' ELSE event_type END AS topic, user_id % 3 AS t FROM events),
 r AS (SELECT *, CASE WHEN topic IN ('click', 'view') THEN topic || 's' WHEN topic = 'document.uploaded' AND t = 0 THEN 'pdf' WHEN topic = 'document.uploaded' AND t = 1 THEN 'markdown' ELSE 'dead_letter' END AS handler FROM e) """


def _routed(spark, d) -> DataFrame:
    topic = F.when(F.col("event_type") == "purchase", "document.uploaded").otherwise(F.col("event_type"))
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("markdown"), F.lit("other")), (F.col("user_id") % 3 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", "props", topic.alias("topic"), kind.alias("event_type"))
    return routing.route(e, {"click": "clicks", "view": "views"}, {"pdf": "pdf", "markdown": "markdown"})


@query(_ROUTED + "SELECT handler, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY handler")
def event_routing(spark, d):
    return _routed(spark, d).groupBy("handler").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(_ROUTED + "SELECT cast(event_id AS varchar) AS key, topic, props AS value, 'No handler registered for topic: ' || topic AS error, 0::bigint AS retry_count FROM r WHERE handler = 'dead_letter'")
def routing_dead_letters(spark, d):
    return routing.dead_letters(_routed(spark, d), "event_id", F.col("props"))


def _mails(spark, d) -> tuple[DataFrame, DataFrame]:
    file = lambda name, size: F.struct(name.alias("name"), size.cast("long").alias("size"), F.lit("u").alias("url"))
    pair = F.array(file(F.concat("role", F.lit(".txt")), F.length("text")), file(F.lit("b.exe"), F.lit(1)))
    c = table(spark, d, "conversations")
    m = c.select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("email_id"), (F.col("conv_id") % 5).cast("string").alias("account_id"), F.when(F.col("turn") % 2 == 0, pair).alias("attachments"))
    return m, mail.attachment_rows(m, "base", "pdf, txt", 200)


_SAVED = "turn % 2 = 0 AND length(text) <= 200"


@query(f"SELECT conv_id || ':' || turn AS email_id, cast(len(embedding) AS bigint) AS vector_size, CASE WHEN turn % 2 = 0 THEN role || '.txt=' || CASE WHEN {_SAVED} THEN 'completed' ELSE 'failed' END || '|b.exe=failed' ELSE '' END AS files FROM conversations LEFT JOIN embeddings ON vec_id = conv_id AND turn = 0")
def email_hydrate(spark, d):
    m, a = _mails(spark, d)
    v = table(spark, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("email_id"), "embedding")
    h = mail.hydrate(m, v, a)
    return h.select("email_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("vector_size"), F.array_join(F.transform("attachments", lambda x: F.concat_ws("=", x["name"], x["status"])), "|").alias("files"))


@query(f"SELECT cast(conv_id % 5 AS varchar) AS account_id, count(*) AS emails, count(*) FILTER ({_SAVED}) AS attachments_saved, cast(sum(CASE WHEN turn % 2 = 0 THEN CASE WHEN {_SAVED} THEN 1 ELSE 2 END ELSE 0 END) AS bigint) AS attachments_failed FROM conversations GROUP BY 1")
def email_attachment_roll_up(spark, d):
    return mail.roll_up(*_mails(spark, d), "account_id")


@query(_BATCHES + """SELECT user_id, batch_no, n, first_id, reason FROM (SELECT user_id, b AS batch_no, count(*) AS n, arg_min(event_id, rn) AS first_id, CASE WHEN count(*) >= 5 THEN 'full' ELSE 'timeout' END AS reason, any_value(f) AS f, max(b) OVER (PARTITION BY user_id) AS last FROM r GROUP BY user_id, b)
 WHERE n >= 5 OR batch_no < last OR f // 1000 + 172800000 < (SELECT epoch_ms(max(ts)) FROM events)""")
def stream_batch_timeout(spark, d):
    from ..sources.streams import events_once

    return events_once(spark, d, lambda s: microbatch.closed_batches(s, 5, 48 * 3600, "0 seconds"), microbatch.CLOSED)


from . import intake, records, state  # noqa: E402, F401  add their queries
