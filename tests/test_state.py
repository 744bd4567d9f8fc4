"""Tables at rest, sinks that take a batch once, streams with timers, de-duplication and windows."""

import os
import time

import pytest
from pyspark.sql import functions as F

from corvella.operators import routing, stats
from corvella.operators.at_rest import Table
from corvella.sources import files, sinks
from corvella.streaming import microbatch


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, "pending", None, f"t{i}") for i in range(100)], "id long, status string, error string, text string")
    t = Table(str(tmp_path / "t"), "id", rows.schema, 8).create(spark)
    assert t.read(spark).count() == 0
    assert t.change(rows, 1) == list(range(8))
    return t


def test_a_change_rewrites_only_its_buckets(spark, table):
    before = files_of(table.path)
    touched = table.change(spark.createDataFrame([(3, "completed")], "id long, status string"), 2)
    after = files_of(table.path)
    assert len(touched) == 1 and len(before.keys() - after.keys()) >= 1
    assert all(after[f] == m for f, m in before.items() if f in after) and len(before.keys() & after.keys()) >= 7
    assert [tuple(r) for r in table.read(spark).where("id = 3").collect()] == [(3, "completed", None, "t3")]
    assert table.read(spark).count() == 100 and table.read(spark).where("status = 'pending'").count() == 99


def test_a_change_that_comes_again_changes_nothing(spark, table):
    done = spark.createDataFrame([(3, "failed", "no"), (4, "completed", None)], "id long, status string, error string")
    assert table.change(done, 2)
    table.change(spark.createDataFrame([(3, "completed", None)], "id long, status string, error string"), 3)
    before = files_of(table.path)
    assert table.change(done, 2) == [] and files_of(table.path) == before
    assert sorted(map(tuple, table.read(spark).where("id in (3, 4)").collect())) == [(3, "completed", None, "t3"), (4, "completed", None, "t4")]


def test_a_change_cut_off_is_finished_by_the_next_try(spark, table, monkeypatch):
    """Half of the buckets are written, as by a commit that broke off; the change is then made again."""
    done = spark.createDataFrame([(i, "completed") for i in range(100)], "id long, status string")
    write = Table._write
    monkeypatch.setattr(Table, "_write", lambda self, rows: write(self, rows.where(F.col(self._bucket) < 4)))
    table.change(done, 2)
    n = table.read(spark).where("status = 'completed'").count()
    assert 0 < n < 100
    monkeypatch.setattr(Table, "_write", write)
    assert table.change(done, 2) == [4, 5, 6, 7]
    assert table.read(spark).where("status = 'completed'").count() == table.read(spark).count() == 100


def test_new_null_repeated_and_guarded_keys(spark, table):
    rows = spark.createDataFrame([(200, "b"), (200, "a"), (None, "x"), (5, "c")], "id long, status string")
    table.change(rows, 2, when=F.col("status") == "other")
    got = {r.id: tuple(r)[1:] for r in table.read(spark).where("id >= 200 or id = 5 or id is null").collect()}
    assert got == {200: ("b", None, None), 5: ("pending", None, "t5")}
    assert table.change(rows.limit(0), 3) == []


def test_deleted_rows_stay_deleted(spark, table):
    gone = spark.createDataFrame([(i,) for i in (7, 8, 500)], "id long")
    assert table.delete(gone, 2) and table.read(spark).count() == 98
    assert table.delete(gone, 2) == [] and table.delete(gone, 3) == []
    table.change(spark.createDataFrame([(7, "late")], "id long, status string"), 1)
    assert table.read(spark).where("id = 7").count() == 0
    table.change(spark.createDataFrame([(7, "again")], "id long, status string"), 4)
    assert [tuple(r) for r in table.read(spark).where("id = 7").collect()] == [(7, "again", None, None)]


def test_blobs_are_saved_with_their_metadata(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_bytes(b"one")
    (folder / "b.md").write_bytes(b"two")
    path = str(tmp_path / "blobs")
    files.save(spark, files.uploads(spark, str(folder), metadata='{"k": "v"}'), path, 1, 4)
    (folder / "a.md").write_bytes(b"three")
    u = files.uploads(spark, str(folder))
    assert files.save(spark, u, path, 2, 4) and files.save(spark, u, path, 2, 4) == []
    got = Table(path, "document_id", u.schema, 4).read(spark).collect()
    assert sorted((r.filename, bytes(r.content), r.file_size) for r in got) == [("a.md", b"three", 5), ("b.md", b"two", 3)]


def test_text_of_markdown_files(spark):
    rows = spark.createDataFrame([("1", b" # T\n"), ("2", "é".encode("latin-1")), ("3", b""), ("4", None)], "document_id string, content binary")
    assert {r.document_id: r.text for r in files.markdown_text(rows).collect()} == {"1": "# T", "2": "é", "3": "", "4": None}


def test_supported_types(spark):
    got = {r.extension: (r.event, r.content_type) for r in files.supported_types(spark).collect()}
    assert got[".md"] == ("markdown", "text/markdown") and got[".pdf"] == ("pdf", "application/pdf") and ".exe" not in got


# -- sinks


def source(spark, folder, *parts):
    for rows in parts:
        spark.createDataFrame(rows, "user_id long, event_id long, s long").selectExpr("user_id", "event_id", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema("user_id long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_batch_cut_off_after_its_write_is_there_once(spark, tmp_path):
    stream = source(spark, tmp_path / "in", [(1, 1, 10)], [(1, 2, 20), (2, 3, 30)])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    cut = []

    def breaks(batch, number):
        sinks.write_once(batch, number, out, "q")
        if number == 1 and not cut:
            cut.append(number)
            raise RuntimeError("lost between write and checkpoint")

    with pytest.raises(Exception, match="lost between"):
        stream.writeStream.foreachBatch(breaks).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    sinks.stream_once(stream, out, "q", state)
    assert cut == [1] and sorted(r.event_id for r in sinks.committed(spark, out, stream.schema).collect()) == [1, 2, 3]


def test_a_batch_without_its_mark_is_not_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id long")
    assert sinks.committed(spark, str(tmp_path), rows.schema).count() == 0
    sinks.write_once(rows, 0, str(tmp_path), "q")
    rows.write.parquet(f"{tmp_path}/rows/query=q/batch=1")
    assert [tuple(r) for r in sinks.committed(spark, str(tmp_path), rows.schema).collect()] == [("q", 0, 1)]
    sinks.write_once(rows, 1, str(tmp_path), "other")
    assert sinks.committed(spark, str(tmp_path), rows.schema).count() == 2


def test_branches_are_handed_to_their_writers(spark, tmp_path):
    stream = source(spark, tmp_path / "in", [(1, 1, 10), (2, 2, 10)], [(1, 3, 20)])
    routed = stream.withColumn("handler", F.when(F.col("user_id") == 1, "one").otherwise("dead_letter"))
    seen = []
    writers = {name: (lambda b, n, name=name: seen.extend((name, n, r.event_id) for r in b.collect())) for name in ("one", "dead_letter")}
    for _ in range(2):
        routing.write_branches(routed, str(tmp_path / "state"), writers)
    assert sorted(seen) == [("dead_letter", 0, 2), ("one", 0, 1), ("one", 1, 3)]


# -- batches that close


def test_shutdown_closes_what_is_open_and_the_stream_goes_on(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    empty = spark.sql("SELECT 1L AS user_id, 1L AS event_id, timestamp_seconds(0) AS ts, true AS closing").limit(0)
    empty.write.parquet(str(tmp_path / "closing"))

    def run():
        stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(folder)).withColumn("closing", F.lit(False))
        both = stream.unionByName(spark.readStream.schema(empty.schema).parquet(str(tmp_path / "closing")))
        microbatch.once(microbatch.closed_batches(both, 3, 100, "0 seconds"), out, state)
        return sorted(map(tuple, spark.read.schema(microbatch.CLOSED).parquet(out).collect()))

    source(spark, folder, [(1, 1, 1000), (1, 2, 1001), (1, 3, 1002), (1, 4, 1003), (2, 5, 1003)])
    assert run() == [(1, 0, 3, 1, "full")]
    assert sorted(r.user_id for r in microbatch.close_open(spark, state, F.timestamp_seconds(F.lit(1003))).collect()) == [1, 2]
    microbatch.close_open(spark, state, F.timestamp_seconds(F.lit(1004))).write.mode("append").parquet(str(tmp_path / "closing"))
    closed = [(1, 0, 3, 1, "full"), (1, 1, 1, 4, "shutdown"), (2, 0, 1, 5, "shutdown")]
    assert run() == closed and microbatch.close_open(spark, state, F.timestamp_seconds(F.lit(1003))).count() == 0
    source(spark, folder, [(1, 6, 1005), (1, 7, 1006), (1, 8, 1007)])
    assert run() == sorted([*closed, (1, 2, 3, 6, "full")])


def test_the_wall_clock_closes_a_batch(spark, tmp_path):
    stream = source(spark, tmp_path / "in", [(1, 1, 5), (2, 2, 9), (2, 3, 7)])
    q = microbatch.closed_batches(stream, 2, 2.0, clock="processing").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        deadline = time.time() + 60
        rows: list = []
        while len(rows) < 2 and time.time() < deadline:
            time.sleep(1)
            if os.path.isdir(tmp_path / "out" / "_spark_metadata"):
                rows = sorted(map(tuple, spark.read.schema(microbatch.CLOSED).parquet(str(tmp_path / "out")).collect()))
    finally:
        q.stop()
    assert rows == [(1, 0, 1, 1, "timeout"), (2, 0, 2, 3, "full")]


# -- de-duplication and windows


def test_repeated_events_of_later_batches_are_dropped_and_the_state_is_bounded(spark, tmp_path):
    parts = [[(1, 100 * k + i, 1000 * k + 9000) for i in range(5)] + ([(1, 100 * (k - 1), 1000 * k + 9000)] if k else []) for k in range(6)]
    stream = source(spark, tmp_path / "in", *parts)
    q = microbatch.deduplicated(stream, delay="1500 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [100 * k + i for k in range(6) for i in range(5)]
    assert max(held) <= 20 < len(got)


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    parts = [[(1, 1, 0), (2, 2, 100)], [(1, 3, 400), (1, 4, 900)], [(1, 5, 1500)]]
    stream = source(spark, tmp_path / "in", *parts)

    def log(e):
        return e.select("event_id", F.col("user_id").alias("group_id"), F.when(F.col("event_id") == 3, "failed").otherwise("completed").alias("status"), F.col("ts").alias("started_at"))

    w = stats.health_windows(log(stream), "10 minutes", "5 minutes", "1 hour")
    sinks.stream_once(w, str(tmp_path / "out"), "health", str(tmp_path / "state"), "update")
    got = sinks.latest(spark, str(tmp_path / "out"), w.schema, "window_start", "group_id")
    want = stats.health_windows(log(spark.read.parquet(str(tmp_path / "in"))), "10 minutes", "5 minutes", "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 9
    now = {r.group_id: (r.silent, r.health) for r in stats.silent(got).collect()}
    assert now == {1: (False, "healthy"), 2: (True, "degraded")}
