"""Sources: tables, file folders, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.at_rest import Table
from ..functions.scalars import CONTENT_TYPES, EVENTS, by_extension, decoded, quick_hash, strip


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def uploads(spark: SparkSession, folder: str, max_bytes: int = 50 * 1024 * 1024, metadata: str = "{}") -> DataFrame:
    """Files as upload rows: rejected ones carry an error instead of a status of success."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = by_extension(name, CONTENT_TYPES)
    error = F.when(kind.isNull(), "unsupported file type").when(F.col("length") > max_bytes, "file too large").when(F.try_parse_json(F.lit(metadata)).isNull(), "bad metadata")
    return files.select(
        F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 24).alias("document_id"), name.alias("filename"), kind.alias("content_type"), F.col("length").alias("file_size"),
        F.from_json(F.lit(metadata), "map<string,string>").alias("metadata"), F.when(error.isNull(), "uploaded").otherwise("failed").alias("status"), F.col("modificationTime").alias("uploaded_at"),
        quick_hash(name, F.col("content")).alias("quick_hash"), error.alias("error_message"), "content",
    )


def save(spark: SparkSession, uploads: DataFrame, path: str, version: int, buckets: int = 64) -> list[int]:
    """Puts uploads with their content into the table at path; a later version of a document takes the place of the earlier one."""
    table = Table(path, "document_id", uploads.schema, buckets)
    table.create(spark)
    return table.change(uploads, version, staged=False)


def markdown_text(files: DataFrame) -> DataFrame:
    return files.select("document_id", decoded(F.col("content")).alias("text"))


def page_text(pages: DataFrame) -> DataFrame:
    """document_id, page_no, page_text to one text: a marker and the text of each page that is not empty, in order."""
    marked = pages.where("page_text <> ''").select("document_id", F.struct("page_no", F.concat(F.lit("[Page "), F.col("page_no").cast("string"), F.lit("]\n"), F.col("page_text"), F.lit("\n\n")).alias("t")).alias("p"))
    joined = marked.groupBy("document_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return joined.select("document_id", strip(F.array_join(F.col("ps.t"), "")).alias("text"))


def supported_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, EVENTS[e], c) for e, c in CONTENT_TYPES.items()], "extension string, event string, content_type string")


def json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Events from JSON files as they arrive; the same rows that a message queue's value column would give."""
    return spark.readStream.format("text").load(folder).select(F.from_json("value", schema).alias("e")).select("e.*")
