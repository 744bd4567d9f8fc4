"""Count-or-timeout micro-batches: a batch opens with its first event and closes at n events or after a wait."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "user_id long, event_id long, batch_no long"
CLOSED = "user_id long, batch_no long, n long, first_id long, reason string"


def step(state: tuple[int, int, int] | None, ts: int, n: int, wait: int) -> tuple[int, int, int]:
    """(batch number, events in it, time of its first) after one more event."""
    if state is None:
        return 0, 1, ts
    no, count, first = state
    return (no + 1, 1, ts) if count >= n or ts - first >= wait else (no, count + 1, first)


def batches(events: DataFrame, n: int, wait_seconds: float) -> DataFrame:
    """The batch of each event. Keys are dealt out and sorted, and a pass over each partition keeps one state."""
    wait = int(wait_seconds * 1_000_000)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, None
        for f in frames:
            numbers = []
            for u, t in zip(f["user_id"].tolist(), f["t"].tolist(), strict=True):
                if u != user:
                    user, state = u, None
                state = step(state, t, n, wait)
                numbers.append(state[0])
            yield pd.DataFrame({"user_id": f["user_id"], "event_id": f["event_id"], "batch_no": numbers})

    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInPandas(run, OUT)


def stream_batches(events: DataFrame, n: int, wait_seconds: float) -> DataFrame:
    """The same over a stream with columns user_id, event_id, ts; each user's state is three numbers."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    wait = int(wait_seconds * 1_000_000)

    def run(key, frames, state):
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        numbers = []
        for t in rows["t"].tolist():
            now = step(now, t, n, wait)
            numbers.append(now[0])
        if now is not None:
            state.update(now)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "batch_no": numbers})

    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.groupBy("user_id").applyInPandasWithState(run, OUT, "no long, count long, first long", "append", GroupStateTimeout.NoTimeout)


def _in_order(frames: list[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The values of the columns, row by row, ordered by the last column, then the first ones. There are many small groups, so no frame is made."""
    values = [np.concatenate([f[c].to_numpy() for f in frames]) for c in columns]
    order = np.lexsort((*values[-2::-1], values[-1]))
    return zip(*(v[order].tolist() for v in values), strict=True)


STATE = "no long, count long, first long, first_id long"


def closed_batches(events: DataFrame, n: int, wait_seconds: float, delay: str = "10 minutes", clock: str = "event") -> DataFrame:
    """Batches of a stream (user_id, event_id, ts) as they close: 'full' at n events, 'timeout' once the wait has passed, 'shutdown' when told.

    A timer closes a batch for which no later event comes. clock 'event': the wait is counted on ts, and delay says how late events
    may be: later ones are dropped by the watermark, like any at the epoch or before. clock 'processing': it is counted
    from the arrival of the first event, on the wall clock. A row whose column closing is true is no event: it closes
    what is open for its user. Batches that are still open when the stream stops stay in the state: close_open lists them,
    and the next run goes on with them."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    wait = int(wait_seconds * 1_000_000)
    wall = clock == "processing"

    def run(key, frames, state):
        no, count, first, first_id = tuple(state.get) if state.exists else (0, 0, 0, 0)
        out = []
        if state.hasTimedOut:
            if count:
                out.append((key[0], no, count, first_id, "timeout"))
                no, count = no + 1, 0
        else:
            now = state.getCurrentProcessingTimeMs() * 1000
            for t, i, closing in _in_order(list(frames), "t", "event_id", "closing"):
                t = now if wall else t
                if count and not closing and t - first >= wait:
                    out.append((key[0], no, count, first_id, "timeout"))
                    no, count = no + 1, 0
                if closing:
                    if count:
                        out.append((key[0], no, count, first_id, "shutdown"))
                        no, count = no + 1, 0
                    continue
                if not count:
                    first, first_id = t, i
                count += 1
                if count == n:
                    out.append((key[0], no, count, first_id, "full"))
                    no, count = no + 1, 0
        state.update((no, count, first, int(first_id)))
        if count and wall:
            state.setTimeoutDuration(max(1, (first + wait - state.getCurrentProcessingTimeMs() * 1000) // 1000))
        elif count:
            state.setTimeoutTimestamp(max((first + wait) // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(dict(zip(("user_id", "batch_no", "n", "first_id", "reason"), zip(*out, strict=True), strict=True)))

    closing = F.coalesce(F.col("closing"), F.lit(False)) if "closing" in events.columns else F.lit(False)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows if wall else rows.withWatermark("ts", delay)
    rows = rows.select("user_id", F.coalesce("event_id", F.lit(0).cast("long")).alias("event_id"), "ts", F.unix_micros("ts").alias("t"), closing.alias("closing"))
    timer = GroupStateTimeout.ProcessingTimeTimeout if wall else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("user_id").applyInPandasWithState(run, CLOSED, STATE, "append", timer)


def close_open(spark: SparkSession, checkpoint: str, ts: Column) -> DataFrame:
    """For each user with an open batch in the state of a stopped stream of closed_batches: the row that closes it, to be put into its source.

    ts must lie beyond the watermark."""
    state = spark.read.format("statestore").load(checkpoint)
    held = state.select("key.user_id", F.col("value.groupState.count").alias("count"))
    return held.where("count > 0").select("user_id", F.lit(None).cast("long").alias("event_id"), ts.alias("ts"), F.lit(True).alias("closing"))


def deduplicated(events: DataFrame, key: str = "event_id", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drops events whose key came before, within the delay of the first one; what is older leaves the state. In a batch all are held."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what has arrived and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def idempotent(stream: DataFrame, done, write, checkpoint: str) -> None:
    """In each micro-batch, skips events that done() lists as completed, then writes by batch id.

    The checkpoint keeps what was read over a restart; a batch that was cut off comes again under its number."""

    def each(batch: DataFrame, number: int) -> None:
        write(batch.join(done().select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"]), number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
