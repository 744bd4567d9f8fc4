"""A sink that takes each micro-batch once: a folder for each batch of a query, and a mark that it is whole.

A batch that comes again under its number replaces what was there; readers see marked batches only. So a run that was
cut off at any point, and one that begins again from the start, leave each row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

KEYS = [StructField("query", StringType()), StructField("batch", LongType())]


def write_once(rows: DataFrame, number: int, path: str, query: str) -> None:
    """Writes a batch, then its mark."""
    rows.write.mode("overwrite").parquet(f"{path}/rows/query={query}/batch={number}")
    rows.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/marks/query={query}/batch={number}")


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all marked batches, with query and batch."""
    if not _exists(spark, f"{path}/marks"):
        return spark.createDataFrame([], StructType([*schema.fields, *KEYS]))
    rows = spark.read.schema(StructType([*schema.fields, *KEYS])).parquet(f"{path}/rows")
    marks = spark.read.schema(StructType([StructField("id", LongType()), *KEYS])).parquet(f"{path}/marks").select("query", "batch")
    return rows.join(marks, ["query", "batch"], "left_semi")


def stream_once(stream: DataFrame, path: str, query: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Runs a stream over what has arrived into the sink. The checkpoint numbers the batches; each: a last step on every batch."""

    def take(batch: DataFrame, number: int) -> None:
        write_once(each(batch) if each else batch, number, path, query)

    stream.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, schema: StructType, *keys: str) -> DataFrame:
    """Of a sink in update mode: each key's row of the last batch that has it."""
    rows = committed(spark, path, schema)
    names = [f.name for f in schema.fields]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col("batch")).alias("r")).select("r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
