"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Each response gives two records that refer to its record id: a metadata record (application/warc-fields) with
the source's HTTP status, headers, digests, title and outlinks, and a conversion record (text/plain) with the
text of the page. Both keep the source's target URI, date and payload digest. Only DataFrame expressions.

The first Content-Type stands in source-content-type; every other header line of the response, repeated ones too, is
a source-header line, in order and as it was but for folded lines, which are joined by a space. Where the records
have a column warc_header (the lines of the source's own WARC header), each is a source-warc-header line.

Rows: a null body is an empty body, a null URI an empty one; equal responses get equal records, each row its
own; responses without a header end have no body; an empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CONTENT_TYPE = r"(?i)^Content-Type[ \t]*:[ \t]*"
# The entities that are replaced, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based id: the same source always gives the same derivatives."""
    h = F.sha2(F.concat_ws("|", F.lit(kind), *parts).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records: source, record_id, target_uri, date, block."""
    uri, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").alias("source"), record_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), F.concat(F.lit(HTTP), body).alias("block"))


def plain_text(html: Column) -> Column:
    out = html
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<head[^>]*>.*?</head>"):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, r"(?i)</?(p|br|div|h[1-6]|li|ul|ol|table|tr|article|nav|section)[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def header_lines(head: Column) -> Column:
    """The lines of a header that are not empty, folded ones joined."""
    return F.filter(F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n"), lambda x: x != "")


def derive(records: DataFrame) -> DataFrame:
    """Two rows a response: warc_type, record_id, refers_to, the kept headers, digests, block and the whole record."""
    warc_header = F.coalesce("warc_header", F.lit("")) if "warc_header" in records.columns else F.lit("")
    r = records.select("source", F.col("record_id").alias("refers_to"), "target_uri", "date", "block", warc_header.alias("warc_header"))
    end = F.instr("block", CRLF + CRLF)
    r = r.withColumn("head", F.when(end > 0, F.substring("block", F.lit(1), end - 1)).otherwise(F.col("block"))).withColumn("body", F.when(end > 0, F.substring("block", end + 4, F.length("block"))).otherwise(F.lit("")))
    r = r.withColumn("source_digest", digest(F.col("block"))).withColumn("payload_digest", digest(F.col("body")))
    links = F.regexp_extract_all("body", F.lit('(?i)href="([^"]*)"'), F.lit(1))
    title = F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title>", 1)
    lines = header_lines(F.regexp_replace("head", r"^HTTP/[^\r\n]*", ""))
    kind = F.array_position(F.transform(lines, lambda x: x.rlike(CONTENT_TYPE)), F.lit(True))
    others = F.filter(lines, lambda x, k: k + 1 != kind)
    named = lambda name, values: F.array_join(F.transform(values, lambda x: F.concat(F.lit(f"{name}: "), x, F.lit(CRLF))), "")
    fields = F.concat(
        F.lit("source-status: "), F.regexp_extract("head", r"^HTTP/[0-9.]+ ([0-9]+)", 1), F.lit(CRLF),
        F.lit("source-content-type: "), F.regexp_replace(F.coalesce(F.try_element_at(lines, F.nullif(kind, F.lit(0)).cast("int")), F.lit("")), CONTENT_TYPE, ""), F.lit(CRLF),
        named("source-header", others), named("source-warc-header", header_lines(F.col("warc_header"))),
        F.lit("source-block-digest: "), F.col("source_digest"), F.lit(CRLF),
        F.lit("title: "), F.regexp_replace(title, r"\s+", " "), F.lit(CRLF),
        named("outlink", links),
    )
    two = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("text")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("body")).alias("text")),
    )
    d = r.select("source", "refers_to", "target_uri", "date", "payload_digest", F.inline(two)).withColumnRenamed("text", "block")
    d = d.withColumn("record_id", record_id("derived", F.col("refers_to"), F.col("warc_type"))).withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    header = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), F.col(c)) for name, c in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"))],
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return d.withColumn("record", F.concat(header, F.lit(CRLF + CRLF), F.col("block"), F.lit(CRLF + CRLF)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive(responses(table(spark, sf_dir, "pages")))
    return d.select(F.col("source").alias("page_id"), "warc_type", "record_id", "refers_to", "payload_digest", "block_digest", "content_length", digest(F.col("record")).alias("record_digest"), "block")


def _uuid(expr: str) -> str:
    return f"(SELECT '<urn:uuid:' || substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) || '>' FROM (SELECT sha256({expr}) AS h))"


def _text_sql(c: str) -> str:
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<head[^>]*>.*?</head>"):
        c = f"regexp_replace({c}, '{pattern}', ' ', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '(?i)</?(p|br|div|h[1-6]|li|ul|ol|table|tr|article|nav|section)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, char in ENTITIES:
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


_NL = "(chr(13) || chr(10))"
OP2_SQL = rf"""
WITH r AS (SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS body, 'HTTP/1.1 200 OK' || {_NL} || 'Content-Type: text/html; charset=utf-8' || {_NL} || {_NL} || coalesce(html, '') AS b,
 {_uuid("'response|' || coalesce(cast(page_id AS varchar), '') || '|' || coalesce(url, '')")} AS refers_to FROM pages),
d AS (SELECT page_id, uri, refers_to, 'sha256:' || sha256(body) AS payload_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
 'source-status: 200' || {_NL} || 'source-content-type: text/html; charset=utf-8' || {_NL} || 'source-block-digest: sha256:' || sha256(b) || {_NL} || 'title: ' || regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g') || {_NL}
 || coalesce(array_to_string(list_transform(regexp_extract_all(body, '(?i)href="([^"]*)"', 1), lambda x: 'outlink: ' || x || {_NL}), ''), '') AS block FROM r
 UNION ALL SELECT page_id, uri, refers_to, 'sha256:' || sha256(body), 'conversion', 'text/plain; charset=utf-8', {_text_sql("body")} FROM r),
i AS (SELECT *, {_uuid("'derived|' || refers_to || '|' || warc_type")} AS record_id, 'sha256:' || sha256(block) AS block_digest, cast(octet_length(encode(block)) AS bigint) AS content_length FROM d)
SELECT page_id, warc_type, record_id, refers_to, payload_digest, block_digest, content_length, block,
 'sha256:' || sha256('WARC/1.1' || {_NL} || 'WARC-Type: ' || warc_type || {_NL} || 'WARC-Record-ID: ' || record_id || {_NL} || 'WARC-Refers-To: ' || refers_to || {_NL} || 'WARC-Target-URI: ' || uri || {_NL} || 'WARC-Date: 2024-01-01T00:00:00Z' || {_NL}
 || 'WARC-Payload-Digest: ' || payload_digest || {_NL} || 'WARC-Block-Digest: ' || block_digest || {_NL} || 'Content-Type: ' || content_type || {_NL} || 'Content-Length: ' || content_length || {_NL} || {_NL} || block || {_NL} || {_NL}) AS record_digest FROM i
"""
