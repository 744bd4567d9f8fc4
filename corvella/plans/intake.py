"""Queries of what comes in: JSON streams, pages and bytes to text, supported files, skipped and dispatched events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import routing
from ..sources import files, sinks
from ..sources.files import table
from ..sources.streams import events_stream, shared_folder
from ..streaming import microbatch
from .catalogue import _NAME, _files, docs, query
from .flows import _ROUTED, _routed


@query("SELECT event_type, count(*) AS n, cast(sum(event_id) AS bigint) AS ids, count(DISTINCT cast(json_extract(props, '$.k') AS bigint)) AS kinds FROM events GROUP BY event_type")
def json_stream_events(spark, d):
    """The events as JSON lines that arrive in a folder, with broken lines between them."""
    out = shared_folder(spark)
    e = table(spark, d, "events")
    line = F.to_json(F.struct("event_id", "event_type", F.from_json("props", "k long").alias("props")))
    broken = e.where("event_id % 10 = 0").select(F.substring(line, 1, 9).alias("value"))
    e.select(line.alias("value")).unionByName(broken).write.text(f"{out}/in")
    schema = "event_id long, event_type string, props struct<k:long>"
    microbatch.once(files.json_stream(spark, f"{out}/in", schema).where("event_id IS NOT NULL"), f"{out}/rows", f"{out}/state")
    return spark.read.schema(schema).parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.countDistinct("props.k").alias("kinds"))


@query(r"""SELECT cast(doc_id AS varchar) AS document_id, regexp_replace(string_agg('[Page ' || n || ']' || chr(10) || x || chr(10) || chr(10), '' ORDER BY n), '^\s+|\s+$', '', 'g') AS text
 FROM (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE x <> '' GROUP BY doc_id""")
def page_texts(spark, d):
    """Each line of a document as a page."""
    p = docs(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "page_text"))
    return files.page_text(p.select("document_id", (F.col("n") + 1).alias("page_no"), "page_text"))


@query(r"""SELECT cast(doc_id AS varchar) AS document_id, sha256(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') ELSE text END, '^\s+|\s+$', '', 'g')) AS text_hash FROM documents""")
def markdown_decode(spark, d):
    """Texts from their bytes: every third in Latin-1, the others in UTF-8."""
    content = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    t = files.markdown_text(docs(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), content.alias("content")))
    return t.select("document_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


@query(f"""SELECT ext AS extension, CASE ext WHEN '.pdf' THEN 'pdf' ELSE 'markdown' END AS event, CASE ext WHEN '.pdf' THEN 'application/pdf' ELSE 'text/markdown' END AS content_type, count(*) AS n, cast(sum(length(html)) AS bigint) AS size
 FROM (SELECT html, lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)) AS ext FROM pages) WHERE ext IN ('.pdf', '.md') GROUP BY ext""")
def supported_files(spark, d):
    """The files of supported types, by type; .markdown and .json do not occur."""
    f = _files(spark, d).withColumn("extension", S.extension(F.col("name")))
    return f.join(files.supported_types(spark), "extension").groupBy("extension", "event", "content_type").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels) GROUP BY event_type")
def stream_skip_processed(spark, d):
    """The events that no label names as done, each once though all come twice."""
    out = shared_folder(spark)
    e = events_stream(spark, d).select("event_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    done = lambda: table(spark, d, "labels").select(F.col("doc_id").alias("event_id"))
    microbatch.idempotent(e, done, lambda batch, number: sinks.write_once(batch, number, f"{out}/sink", "events"), f"{out}/state")
    return sinks.committed(spark, f"{out}/sink", e.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(_ROUTED + "SELECT handler, CASE handler WHEN 'clicks' THEN event_id % 7 WHEN 'views' THEN event_id % 5 ELSE 0 END AS part, count(*) AS n FROM r WHERE handler <> 'dead_letter' GROUP BY ALL")
def dispatch_events(spark, d):
    """Each handler's own work on its own events."""
    part = lambda n: lambda e: e.withColumn("part", F.col("event_id") % n)
    done = routing.dispatch(_routed(spark, d), {"clicks": part(7), "views": part(5), "pdf": part(1), "markdown": part(1)})
    return reduce(DataFrame.unionByName, done.values()).groupBy("handler", "part").agg(F.count("*").alias("n"))
