"""Column expressions: ids, hashes, names, texts, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_EDGE = 10 * 1024
# Content types by file extension, and the event each starts.
CONTENT_TYPES = {".pdf": "application/pdf", ".md": "text/markdown", ".markdown": "text/markdown", ".json": "application/json"}
EVENTS = {".pdf": "pdf", ".md": "markdown", ".markdown": "markdown", ".json": "json"}
# Lines that begin a section.
BOUNDARIES = (r"^#{1,6}\s+", r"^\d+\.\s+", r"^[A-Z][A-Z\s]{2,}$", r"^\[Page \d+\]", r"^Chapter \d+", r"^Section \d+")
# Words whose full stop ends no sentence.
ABBREVIATIONS = "Mr|Mrs|Dr|Ms|Prof|Sr|Jr|Inc|Ltd|Corp|Co|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def short_sha(prefix: str, length: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(prefix), *parts).cast("binary"), 256), 1, length)


def email_document_id(email_id: Column) -> Column:
    return short_sha("email:", 24, email_id)


def embedding_id(document_id: Column) -> Column:
    return short_sha("emb:", 16, document_id)


def attachment_id(email_id: Column, attachment: Column) -> Column:
    return short_sha("attach:", 16, email_id, F.lit(":"), attachment)


def chunk_id(document_id: Column, strategy: str, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", document_id, F.lit(strategy), index.cast("string")).cast("binary"), 256), 1, 24)


def quick_hash(filename: Column, content: Column) -> Column:
    """sha256 of name, size and the first and last 10 KiB; of the whole content up to 20 KiB."""
    n = F.octet_length(content)
    head = F.when(n <= 2 * HASH_EDGE, content).otherwise(F.substring(content, 1, HASH_EDGE))
    tail = F.when(n <= 2 * HASH_EDGE, F.lit("").cast("binary")).otherwise(F.substring(content, -HASH_EDGE, HASH_EDGE))
    return F.sha2(F.concat(filename.cast("binary"), n.cast("string").cast("binary"), head, tail), 256)


def safe_name(name: Column) -> Column:
    out = F.regexp_replace(name, r"[^A-Za-z0-9.\-_]", "_")
    return F.when(out == "", "attachment").otherwise(out)


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot; empty for none or for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def extractor(content_type: Column, name: Column) -> Column:
    """pdf or markdown, by content type or by suffix; null for what neither names."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    kind = F.coalesce(content_type, F.lit(""))
    pdf = (kind == CONTENT_TYPES[".pdf"]) | lower.endswith(".pdf")
    markdown = (kind == CONTENT_TYPES[".md"]) | lower.endswith(".md") | lower.endswith(".markdown")
    return F.when(pdf, "pdf").when(markdown, "markdown")


def by_extension(name: Column, values: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(table, extension(name))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def size_bytes(c: Column) -> Column:
    """'10MB' to bytes; KB, MB, GB or a plain number."""
    unit = F.upper(F.regexp_extract(c, r"^\s*\d+\s*([KMG]B)?\s*$", 1))
    number = F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("long")
    return number * F.when(unit == "KB", 1024).when(unit == "MB", 1024**2).when(unit == "GB", 1024**3).otherwise(1).cast("long")


def duration_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000


def decoded(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not valid UTF-8."""
    return strip(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1")))


def is_boundary(line: Column) -> Column:
    return line.rlike("|".join(f"(?:{b})" for b in BOUNDARIES))


def sentences(text: Column) -> Column:
    """Split after a terminator followed by white space; the terminator stays."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Split at blank lines, of any number; what is empty is left out."""
    parts = F.split(F.regexp_replace(text, r"\n\s*\n+", "\n\n"), "\n\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def careful_sentences(text: Column) -> Column:
    """Split between a terminator and a capital, but not after titles, company suffixes and months."""
    gap = rf"(?U)(?<=[.!?])(?<!\b(?:{ABBREVIATIONS})\.)\s+(?=[A-Z])"
    return F.filter(F.transform(F.split(text, gap), strip), lambda s: s != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def blended(cos: Column, entities: Column, topics: Column) -> Column:
    return F.when(cos > 0, 0.5 * cos + 0.25 * entities + 0.25 * topics).otherwise(0.5 * entities + 0.5 * topics)


def estimates(n: Column) -> dict[str, Column]:
    """Expected number of chunks of a text of n characters, by strategy."""
    tokens = F.floor(n / 4)
    return {
        "character": F.when(n == 0, 0).otherwise(F.floor(n / 900) + 1),
        "token": F.when(tokens == 0, 0).otherwise(F.floor(tokens / 450) + 1),
        "semantic": F.floor(n / (1500 * 0.7)) + 1,
        "recursive": F.when(n == 0, 0).otherwise(F.floor(n / 1200) + 1),
        "embedding": F.floor(n / (1500 * 0.6)) + 1,
        "linguistic": F.floor(n / 1250) + 1,
    }
