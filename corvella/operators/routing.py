"""Events to handlers: by topic, else by type on the topics that carry one, else to the dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEAD_LETTER = "dead_letter"


def _lookup(values: dict[str, str], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def route(events: DataFrame, topics: dict[str, str], types: dict[str, str] | None = None, typed_topic: str = "document.uploaded") -> DataFrame:
    """events (topic, event_type) with handler and routing_error. Unknown and null topics and types go to the dead letters."""
    topic = F.coalesce("topic", F.lit(""))
    by_type = F.when(topic == typed_topic, _lookup(types or {}, F.coalesce("event_type", F.lit(""))))
    handler = F.coalesce(_lookup(topics, topic), by_type)
    error = F.when(handler.isNull(), F.concat(F.lit("No handler registered for topic: "), topic))
    return events.withColumns({"handler": F.coalesce(handler, F.lit(DEAD_LETTER)), "routing_error": error})


def skip_processed(events: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Drops events whose key is among the done ones. Null keys are kept: nothing says they were processed."""
    return events.join(done.select(key).distinct(), key, "left_anti")


def dead_letters(routed: DataFrame, key: str, payload: Column) -> DataFrame:
    """key, topic, value, error and retry_count of the events that no handler takes, ready to be appended."""
    rows = routed.where(F.col("handler") == DEAD_LETTER)
    return rows.select(F.col(key).cast("string").alias("key"), "topic", payload.alias("value"), F.col("routing_error").alias("error"), F.lit(0).cast("long").alias("retry_count"))


def messages(events: DataFrame, topic: Column, key: str, *fields: str) -> DataFrame:
    """topic, key and value: the fields as JSON, times as ISO strings in the session's zone; null fields are left out."""
    kinds = {f.name: f.dataType.typeName() for f in events.schema}
    iso = lambda f: F.date_format(f, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f) if kinds[f].startswith("timestamp") else F.col(f)
    return events.select(topic.alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[iso(f) for f in fields])).alias("value"))


def produce(rows: DataFrame, kind: str = "parquet", **options: str) -> None:
    """Appends messages to a sink of Spark; a stream goes through write_branches. Ids in the values make repeats harmless."""
    rows.write.format(kind).options(**options).mode("append").save()


def browse(letters: DataFrame, n: int = 50) -> DataFrame:
    """The first n dead letters by partition and offset."""
    return letters.select("partition", "offset", "key", "value", "timestamp").orderBy("partition", "offset").limit(n)


def dispatch(routed: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Each handler's result on its own events; handlers run apart, so that one's failure leaves the others' writes alone."""
    return {name: f(routed.where(F.col("handler") == name)) for name, f in handlers.items()}


def write_branches(stream: DataFrame, checkpoint: str, writers: dict[str, Callable[[DataFrame, int], None]]) -> None:
    """Runs a routed stream over what has arrived; each micro-batch is handed to the writers by handler and batch number."""

    def each(batch: DataFrame, number: int) -> None:
        for name, write in writers.items():
            write(batch.where(F.col("handler") == name), number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
