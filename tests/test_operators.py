import hashlib

from pyspark.sql import functions as F

from corvella.config import Options
from corvella.functions import scalars as S
from corvella.operators import chunkers, embedding, logs, mail, routing, tables, vectors
from corvella.sources import files
from corvella.streaming import microbatch


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_quick_hash_edges(spark):
    for n in (0, 20480, 20481):
        b = bytes(i % 251 for i in range(n))
        want = hashlib.sha256(b"f" + str(n).encode() + (b if n <= 20480 else b[:10240] + b[-10240:])).hexdigest()
        df = spark.createDataFrame([(bytearray(b),)], "b binary")
        assert df.select(S.quick_hash(F.lit("f"), F.col("b"))).first()[0] == want


def test_scalars(spark):
    assert one(spark, S.safe_name(F.lit("a b/é😀.txt"))) == "a_b___.txt"
    assert one(spark, S.safe_name(F.lit(""))) == "attachment"
    assert one(spark, S.extension(F.lit("A.PDF"))) == ".pdf" and one(spark, S.extension(F.lit(".pdf"))) == ""
    assert one(spark, S.size_bytes(F.lit("10MB"))) == 10 * 1024**2 and one(spark, S.size_bytes(F.lit("7"))) == 7
    assert one(spark, S.decoded(F.lit("é".encode("latin-1")))) == "é"
    assert one(spark, S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_upsert_delete_latest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.id for r in tables.delete(old, new, "id").collect()] == [1]
    log = spark.createDataFrame([("x", "pending", 1), ("x", "completed", 3), ("x", "failed", 2)], "k string, status string, t int")
    assert tables.latest(log, "k", "status", "t").first().status == "completed"


def test_duplicates_known_and_in_batch(spark):
    new = spark.createDataFrame([(5, "h"), (6, "h"), (7, "g")], "doc_id int, quick_hash string")
    known = spark.createDataFrame([(1, "g")], "doc_id int, quick_hash string")
    got = {r.doc_id: (r.existing_id, r.status) for r in tables.mark_duplicates(new, known).collect()}
    assert got == {5: (None, "uploaded"), 6: (5, "duplicate"), 7: (1, "duplicate")}


def test_attachment_errors_in_order(spark):
    rows = [("a.exe", 99, None), ("a.exe", 1, None), ("a.TXT", 1, None), ("a.txt", 1, "u"), ("noext", 1, "u")]
    df = spark.createDataFrame(rows, "n string, s int, u string")
    got = [r[0] for r in df.select(tables.attachment_error(F.col("n"), F.col("s"), F.col("u"), "pdf, txt", 10)).collect()]
    assert got == ["file too large", "file type not allowed", "no download url", None, "file type not allowed"]


def test_top_k_bounds(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in vectors.top_k(v, [1.0, 0.0], 2).collect()] == [1, 2]
    assert vectors.top_k(v, [1.0, 0.0], 0).count() == 0 and vectors.top_k(v.where("vec_id > 9"), [1.0, 0.0], 5).count() == 0


def test_uploads_and_pages(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b" hi ")
    (tmp_path / "b.exe").write_bytes(b"x")
    got = {r.filename: r.status for r in files.uploads(spark, str(tmp_path)).select("filename", "status").collect()}
    assert got == {"a.md": "uploaded", "b.exe": "failed"}
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), ("d", 3, " ")], "document_id string, page_no int, page_text string")
    assert files.page_text(pages).first().text == "[Page 1]\none\n\n[Page 2]\ntwo\n\n[Page 3]"
    bare = spark.createDataFrame([("d", 1, "one"), ("d", 2, ""), ("d", 3, None)], "document_id string, page_no int, page_text string")
    assert files.page_text(bare).first().text == "[Page 1]\none"


def test_batch_step():
    state, out = None, []
    for t in (0, 1, 2, 10, 11, 30):
        state = microbatch.step(state, t, 3, 9)
        out.append(state[0])
    assert out == [0, 0, 0, 1, 1, 2]


def test_options(spark):
    spark.conf.set("spark.corvella.chunk_size", "77")
    assert Options.of(spark).chunk_size == 77
    spark.conf.unset("spark.corvella.chunk_size")
    try:
        Options(email_batch=0)
    except ValueError:
        return
    raise AssertionError


def test_upsert_keeps_the_last_version(spark):
    old = spark.createDataFrame([(1, "a", 0)], "id int, v string, n int")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "d", 1)], "id int, v string, n int")
    assert sorted(map(tuple, tables.upsert(old, new, "id", "n").collect())) == [(1, "b", 2), (2, "d", 1)]
    assert tables.upsert(old, new, "id").count() == 2


def test_embed_retries_then_single_texts(spark):
    def picky(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, 0, "x", "good"), (1, 1, "y", "bad"), (2, 0, "z", ""), (3, 0, "w", None)], "doc_id long, chunk_index long, chunk_id string, text_content string").coalesce(1)
    out = embedding.embed(df, picky, attempts=2)
    got = {r.chunk_id: (r.embedding, r.embedding_status, r.embedding_error, r.attempts) for r in out.collect()}
    assert got == {"x": ([4.0], "completed", None, 3), "y": (None, "failed", "no", 3), "z": (None, "skipped", None, 0), "w": (None, "skipped", None, 0)}
    assert [r.chunk_id for r in embedding.failures(out).collect()] == ["y"]
    assert embedding.embed(df.where("doc_id > 9"), picky).count() == 0


def test_log_of_a_retried_event(spark):
    e = spark.createDataFrame([(7, 0), (None, 0)], "event_id long, s int")
    at = lambda n: F.timestamp_seconds(F.lit(n))
    log = logs.started(e, "event", "event_id", at(1)).union(logs.finished(e, "event", "event_id", at(2), F.lit("no"))).union(logs.started(e, "event", "event_id", at(3))).union(logs.finished(e, "event", "event_id", at(3)))
    row = logs.current(log.union(log)).collect()
    assert len(row) == 1 and (row[0].status, row[0].error) == ("completed", None)
    assert logs.history(log.union(log)).first().states == ["processing", "failed", "processing", "completed"]


def test_routing_without_topic(spark):
    e = spark.createDataFrame([(1, None, None), (2, "t", None), (3, "document.uploaded", "pdf"), (4, "document.uploaded", "x")], "id int, topic string, event_type string")
    r = routing.route(e, {"t": "h"}, {"pdf": "p"})
    assert {x.id: x.handler for x in r.collect()} == {1: "dead_letter", 2: "h", 3: "p", 4: "dead_letter"}
    assert routing.dead_letters(r, "id", F.lit("{}")).count() == 2
    assert [x.id for x in routing.dispatch(r, {"p": lambda d: d})["p"].collect()] == [3]


def test_timer_closes_a_batch_without_a_later_event(spark, tmp_path):
    import time

    t = lambda s: f"timestamp_seconds({s})"
    for rows in ([(1, 1, 1000), (2, 2, 1000)], [(2, 3, 1100)]):
        spark.createDataFrame(rows, "user_id long, event_id long, s long").selectExpr("user_id", "event_id", f"{t('s')} AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    microbatch.once(microbatch.closed_batches(stream, 3, 9, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, 0, 1, 1, "timeout"), (2, 0, 1, 2, "timeout")]


def test_idempotent_skips_and_resumes(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (2,)], "event_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long").parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        microbatch.idempotent(stream, lambda: spark.createDataFrame([(1,)], "event_id long"), lambda b, n: seen.extend(r.event_id for r in b.collect()), str(tmp_path / "state"))
    assert seen == [2]


def test_sentences_in_columns_equal_those_in_python(spark):
    text = "On 3 May. Then Dr. Who left.  He paid 3.5. ok? Yes! Xsep. No"
    want = ["On 3 May. Then Dr. Who left.", "He paid 3.5. ok?", "Yes!", "Xsep.", "No"]
    assert chunkers.careful_sentences(text) == want and one(spark, S.careful_sentences(F.lit(text))) == want


def test_boundaries_and_extractors(spark):
    lines = {"OK": False, "OKAY": True, "# ": True, "#": False, "Chapter 1": True, " Chapter 1": False, "[Page 3] x": True}
    assert {k: one(spark, S.is_boundary(F.lit(k))) for k in lines} == lines
    assert one(spark, S.extractor(F.lit(None), F.lit("a.PDF"))) == "pdf" and one(spark, S.extractor(F.lit("text/markdown"), F.lit(None))) == "markdown" and one(spark, S.extractor(F.lit(""), F.lit("a.txt"))) is None


def test_coverage_sees_losses_inside(spark):
    d = spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string")
    c = spark.createDataFrame([(1, 0, 40), (1, 30, 50), (1, 90, 100)], "doc_id long, char_start long, char_end long")
    row = chunkers.coverage(c, d).first()
    assert (row.covered, row.spanned, row.last_end, row.lossy) == (70, 60, 100, True)


def test_top_k_each_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    q = v.selectExpr("vec_id AS query_id", "embedding AS query_vector")
    whole = sorted(map(tuple, vectors.top_k_each(v, q, 2).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 2)
    assert sorted(map(tuple, vectors.top_k_each(v, q, 2).collect())) == whole and len(whole) == 18


def test_sizes_of_options(spark):
    d = spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string")
    assert chunkers.chunk(d, "character", **chunkers.sizes(Options(chunk_size=20, chunk_overlap=0), "character")).count() == 3


def test_extractor_takes_a_bare_suffix(spark):
    rows = spark.createDataFrame([(None, ".md"), ("", "a.PDF"), ("application/pdf", None), ("text/plain", "a.md.txt"), (None, None)], "k string, n string")
    assert [r[0] for r in rows.select(S.extractor(F.col("k"), F.col("n"))).collect()] == ["markdown", "pdf", "pdf", None, None]


def test_fetch_keeps_every_row(spark):
    def service(url):
        if url == "down":
            raise OSError("down")
        return (200, b"x") if url == "ok" else (500, b"page of an error")

    rows = spark.createDataFrame([(1, "ok"), (2, "down"), (3, "other"), (4, ""), (5, None), (1, "ok")], "id int, url string").withColumn("content", F.lit("old"))
    got = [(r.id, bytes(r.content) if r.content else None, r.fetch_error) for r in mail.fetch(rows, service).orderBy("id").collect()]
    assert got == [(1, b"x", None), (1, b"x", None), (2, None, "down"), (3, None, "HTTP 500"), (4, None, "no download url"), (5, None, "no download url")]


def test_push_keeps_what_was_there(spark):
    m = spark.createDataFrame([("a", ["9"]), ("b", None), ("c", ["1"])], "email_id string, attachment_ids array<string>")
    a = spark.createDataFrame([("a", 1, "8"), ("a", 0, "9"), ("b", 0, "7")], "email_id string, pos int, attachment_id string")
    assert {r.email_id: r.attachment_ids for r in mail.push_ids(m, a).collect()} == {"a": ["9", "8"], "b": ["7"], "c": ["1"]}


def test_messages_reach_a_sink(spark, tmp_path):
    rows = spark.sql("SELECT 't' AS topic, 1 AS id, timestamp_ntz'2024-01-02 03:04:05.5' AS at, cast(NULL AS string) AS note")
    routing.produce(routing.messages(rows, F.col("topic"), "id", "id", "at", "note"), path=str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("t", "1", '{"id":1,"at":"2024-01-02T03:04:05.500000"}')]


def test_json_stream_reads_what_arrives(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"event_id": 1, "kind": "x"}\nnot json\n')
    microbatch.once(files.json_stream(spark, str(folder), "event_id long, kind string"), str(tmp_path / "rows"), str(tmp_path / "state"))
    (folder / "b.json").write_text('{"event_id": 2, "kind": "y"}\n')
    microbatch.once(files.json_stream(spark, str(folder), "event_id long, kind string"), str(tmp_path / "rows"), str(tmp_path / "state"))
    assert sorted(str(r.event_id) for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == ["1", "2", "None"]


def test_payload_of_null_maps(spark):
    got = spark.sql("SELECT map('a', '1') AS x, cast(NULL AS map<string,string>) AS y").select(tables.merge_payload(F.col("x"), F.col("y")), tables.merge_payload(F.col("y"), F.col("x"))).first()
    assert got[0] == got[1] == {"a": "1"}


def test_numbers_within_groups_of_any_size(spark):
    import random

    from corvella.operators import numbering

    r = random.Random(4)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, i long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x.g, x.t, x.i): x.row_no for x in numbering.numbered(df, "g", "t", "i").collect()}
        cut = {(x.g, x.i): x.batch_no for x in numbering.batched(df, 20, "g", "t", "i").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {x[0] for x in rows}:
        for n, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1:])):
            want[x] = n
    assert got == want and cut == {(g, i): n // 20 for (g, _, i), n in want.items()}
    assert numbering.numbered(df.limit(0), "g", "t", "i").count() == 0


def test_paragraphs(spark):
    assert one(spark, S.paragraphs(F.lit("\n\n a\nb \n \n\n c\n\n\n"))) == ["a\nb", "c"] and one(spark, S.paragraphs(F.lit(""))) == []
