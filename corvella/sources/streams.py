"""Streams over tables of events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming.microbatch import once


def shared_folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file:///tmp/corvella-scratch"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


#: Files of a micro-batch: what bounds the rows that a task holds of one key.
FILES = 64


def events_stream(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """The events table as a stream, at most so many files a micro-batch."""
    path = f"{folder}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(_glob(path))


def events_once(spark: SparkSession, folder: str, transform: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Reads the events table as a stream, runs transform over all that is there, and returns what the sink has."""
    out = shared_folder(spark)
    once(transform(events_stream(spark, folder)), f"{out}/rows", f"{out}/state")
    return spark.read.schema(schema).parquet(f"{out}/rows")


def _glob(path: str) -> str:
    """The file source takes folders or globs: a glob that matches the table alone."""
    return path.replace("/events.parquet", "/events.parque[t]")
