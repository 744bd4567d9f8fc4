"""Embeddings of texts by a batch embedder that may fail or hang: several calls at once, retries, then one text at a time, errors as rows."""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.scalars import embedding_id

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
Job, Result = TypeVar("Job"), TypeVar("Result")
ADDED = ("embedding", "embedding_status", "embedding_error", "attempts")
_TYPES = (pa.list_(pa.float64()), pa.string(), pa.string(), pa.int32())
#: After so many single texts in a row without an answer in time, the rest of a batch is not sent.
GIVE_UP = 3


class _Caller:
    """A thread that makes one call after the other; it ends with its holder."""

    def __init__(self) -> None:
        self.calls: queue.SimpleQueue = queue.SimpleQueue()
        threading.Thread(target=_serve, args=(self.calls,), daemon=True).start()

    def __del__(self) -> None:
        self.calls.put(None)


def _serve(calls: queue.SimpleQueue) -> None:
    while (job := calls.get()) is not None:
        call, answers = job
        try:
            answers.put((call(), None))
        except BaseException as e:  # handed to the caller
            answers.put((None, e))
        del job, call, answers  # what they hold is not kept while no call comes


_own = threading.local()


def timed(call: Callable[[], Result], timeout: float | None) -> Result:
    """The call's answer, or TimeoutError after so many seconds. A call that is given up ends unheard, in a thread that no other call gets."""
    if timeout is None:
        return call()
    answers: queue.SimpleQueue = queue.SimpleQueue()
    if getattr(_own, "caller", None) is None:
        _own.caller = _Caller()
    _own.caller.calls.put((call, answers))
    try:
        value, error = answers.get(timeout=timeout)
    except queue.Empty:
        _own.caller = None
        raise TimeoutError(f"no answer within {timeout:g} s") from None
    if error is not None:
        raise error
    return value


def in_order(jobs: Iterable[Job], work: Callable[[Job], Result], at_once: int) -> Iterator[tuple[Job, Result]]:
    """Each job with its result, in the order of the jobs. At most at_once run at a time, at most twice as many are held."""
    with ThreadPoolExecutor(at_once) as pool:
        held: deque = deque()
        for job in jobs:
            if len(held) == 2 * at_once:
                first, result = held.popleft()
                yield first, result.result()
            held.append((job, pool.submit(work, job)))
        while held:
            first, result = held.popleft()
            yield first, result.result()


def _call(embedder: Embedder, texts: list[str], timeout: float | None) -> list[list[float]]:
    vectors = timed(lambda: embedder(texts), timeout)
    if len(vectors) != len(texts):
        raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    return [[float(x) for x in v] for v in vectors]


def embed_batch(texts: list[str], embedder: Embedder, attempts: int, pause: float, timeout: float | None = None) -> list[tuple]:
    """(vector, status, error, attempts) of each text. The batch is tried a number of times, with longer and longer pauses, then each text once."""
    for i in range(attempts):
        try:
            return [(v, "completed", None, i + 1) for v in _call(embedder, texts, timeout)]
        except Exception:  # any error of the service leads to the next try
            time.sleep(pause * 2**i)
    out: list[tuple] = []
    late = 0
    for t in texts:
        if late == GIVE_UP:
            out.append((None, "failed", out[-1][2], attempts))
            continue
        try:
            out.append((_call(embedder, [t], timeout)[0], "completed", None, attempts + 1))
            late = 0
        except Exception as e:
            late = late + 1 if isinstance(e, TimeoutError) else 0
            out.append((None, "failed", str(e), attempts + 1))
    return out


def _filled(texts: list[str | None], embedder: Embedder, attempts: int, pause: float, timeout: float | None) -> list[tuple]:
    """embed_batch of the texts that are not empty; the others are 'skipped'."""
    rows: list[tuple] = [(None, "skipped", None, 0)] * len(texts)
    sent = [i for i, t in enumerate(texts) if t]
    if sent:
        for i, row in zip(sent, embed_batch([texts[i] for i in sent], embedder, attempts, pause, timeout), strict=True):
            rows[i] = row
    return rows


def embed_texts(texts: list[str | None], embedder: Embedder, batch: int = 300, attempts: int = 3, pause: float = 0.0, at_once: int = 7, timeout: float | None = 30.0) -> list[tuple]:
    """(vector, status, error, attempts) of each text; they are sent in batches, several at once."""
    parts = (texts[a : a + batch] for a in range(0, len(texts), batch))
    return [row for _, rows in in_order(parts, lambda p: _filled(p, embedder, attempts, pause, timeout), at_once) for row in rows]


def embed(chunks: DataFrame, embedder: Embedder, text: str = "text_content", batch: int = 300, attempts: int = 3, pause: float = 0.0, at_once: int = 7, timeout: float | None = 30.0) -> DataFrame:
    """chunks with embedding, embedding_status, embedding_error and attempts; columns of these names are replaced.

    A task has at most at_once calls of at most batch texts in flight; a call that gives no answer within timeout seconds
    counts as failed, and a batch that waits for its next try does not hold up others. Rows keep their order. Empty and null
    texts are not sent: they are 'skipped' with no vector. No row is lost when the embedder fails."""
    kept = chunks.drop(*ADDED)
    added = [StructField("embedding", ArrayType(DoubleType())), StructField("embedding_status", StringType()), StructField("embedding_error", StringType()), StructField("attempts", IntegerType())]

    def answer(part: pa.RecordBatch) -> list[tuple]:
        return _filled(part.column(text).to_pylist(), embedder, attempts, pause, timeout)

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (record.slice(at, batch) for record in records for at in range(0, record.num_rows, batch))
        for part, rows in in_order(parts, answer, at_once):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *ADDED])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *added]))


def vectors(embedded: DataFrame) -> DataFrame:
    """Vector rows of what was embedded, with ids that a replay gives again."""
    return embedded.where("embedding_status = 'completed'").withColumn("embedding_id", embedding_id(F.col("chunk_id")))


def pending(chunks: DataFrame) -> DataFrame:
    """Chunks as they are saved before anything is embedded."""
    return chunks.withColumns({"embedding_status": F.lit("pending"), "embedding_id": F.lit(None).cast("string"), "embedding_error": F.lit(None).cast("string")})


def outcomes(embedded: DataFrame) -> DataFrame:
    """What embedding changes in saved chunks: status, id of the vector, error."""
    ok = F.col("embedding_status") == "completed"
    return embedded.select("chunk_id", "embedding_status", F.when(ok, embedding_id(F.col("chunk_id"))).alias("embedding_id"), F.when(~ok, F.col("embedding_error")).alias("embedding_error"))


def failures(embedded: DataFrame) -> DataFrame:
    """Quarantine rows of what was not."""
    return embedded.where("embedding_status = 'failed'").select("doc_id", "chunk_index", "chunk_id", F.col("embedding_error").alias("error"), F.lit(0).cast("long").alias("retry_count"), F.lit("pending_retry").alias("status"))


def document_status(embedded: DataFrame) -> DataFrame:
    """Per document: chunks by status; failed if none was embedded, else completed, with a mark for partial failure."""
    st = F.col("embedding_status")
    g = embedded.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(st == "completed").alias("embedded"), F.count_if(st == "failed").alias("embedding_errors"))
    return g.withColumn("has_partial_failure", F.col("embedding_errors") > 0).withColumn("status", F.when((F.col("embedded") == 0) & (F.col("embedding_errors") > 0), "failed").otherwise("completed"))


def document_stats(embedded: DataFrame, strategy: str, batch: int = 300) -> DataFrame:
    """Per document: chunks, vectors, errors, how many batches of chunks were saved, and the strategy that cut them."""
    d = document_status(embedded)
    return d.select("doc_id", F.ceil(F.col("n_chunks") / batch).alias("batches"), F.col("n_chunks").alias("total_chunks"), "embedded", "embedding_errors", F.lit(strategy).alias("strategy"))
