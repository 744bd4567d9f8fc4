"""What a task holds and how often work is done: bounds that the size of the input does not move."""

import threading

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from corvella.operators import chunkers as C
from corvella.operators import embedding
from corvella.operators.at_rest import Table
from corvella.streaming import microbatch
from pyspark.sql import functions as F


def test_texts_are_cut_in_pieces_of_bounded_bytes():
    texts = ["a" * 300_000] * 9 + [None, "b" * 3_000_000, ""]
    got = list(C._pieces(iter([pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], names=["k", "t"])])))
    assert sum(p.num_rows for p in got) == 12 and [k for p in got for k in p.column(0).to_pylist()] == list(range(12))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) < 2 * C.PIECE for p in got if "b" * 3_000_000 not in p.column(1).to_pylist())
    assert len(got) >= 3


@pytest.mark.parametrize("strategy", C.STRATEGIES)
def test_chunks_do_not_depend_on_the_pieces(spark, small, monkeypatch, strategy):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(40)
    whole = sorted(map(str, C.chunk(docs, strategy).collect()))
    places = sorted(map(str, C.coverage_of(C.chunk_arrays(docs, strategy)).collect()))
    assert sorted(map(str, C.coverage_of(C.chunk_arrays(docs, strategy, contents=False)).collect())) == places
    assert "text_content" not in C.chunk_arrays(docs, strategy, contents=False).schema.simpleString()
    monkeypatch.setattr(C, "PIECE", 2000)
    assert sorted(map(str, C.chunk(docs, strategy).collect())) == whole


def test_calls_with_a_time_limit_share_a_thread():
    seen = {embedding.timed(threading.get_ident, 5.0) for _ in range(20)}
    assert len(seen) == 1
    hang = threading.Event()
    with pytest.raises(TimeoutError):
        embedding.timed(hang.wait, 0.05)
    assert embedding.timed(lambda: 1, 5.0) == 1 and embedding.timed(threading.get_ident, 5.0) not in seen  # the hung thread gets no call
    hang.set()


def test_changes_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(k):
        made.add(1)
        return f"v{k}"

    rows = spark.range(50).select(F.col("id").cast("string").alias("key"), costly(F.col("id")).alias("value"))
    t = Table(str(tmp_path / "t"), "key", rows.schema, 4).create(spark)
    t.change(rows, 1)
    assert made.value == 50 and t.read(spark).count() == 50
    t.change(rows, 2, staged=False)
    assert sorted(r.value for r in t.read(spark).collect()) == sorted(f"v{k}" for k in range(50))


def test_rows_of_a_group_are_ordered_without_frames(monkeypatch):
    """As pandas orders them: events before what closes, by time and id, times that are missing last."""
    r = np.random.default_rng(3)
    frames = [pd.DataFrame({"t": r.integers(0, 5, 40), "event_id": r.integers(0, 9, 40), "closing": r.integers(0, 2, 40) > 0}) for _ in range(3)]
    frames.append(pd.DataFrame({"t": [2.0, np.nan], "event_id": [7, 7], "closing": [False, False]}))
    want = pd.concat(frames).sort_values(["closing", "t", "event_id"])
    want = list(zip(want["t"].tolist(), want["event_id"].tolist(), want["closing"].tolist(), strict=True))
    monkeypatch.setattr(pd, "concat", None)
    assert str(list(microbatch._in_order(frames, "t", "event_id", "closing"))) == str(want)
