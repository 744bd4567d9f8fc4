"""Embedders and fetchers that are slow, hang or fail."""

import threading
import time

import pytest

from corvella.config import Options
from corvella.operators import embedding, mail


class Service:
    """Counts its calls in flight; may be slow, and hangs on texts that say so."""

    def __init__(self, seconds=0.02):
        self.seconds, self.now, self.most, self.calls, self.lock = seconds, 0, 0, [], threading.Lock()

    def __call__(self, texts):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.calls.append(list(texts))
        try:
            if any("hang" in t for t in texts):
                time.sleep(5)
            time.sleep(self.seconds * (1 + len(self.calls) % 3))
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [[float(t.split()[-1])] for t in texts]
        finally:
            with self.lock:
                self.now -= 1


def test_calls_run_at_once_and_answers_keep_their_order():
    s = Service()
    texts = [f"t {i}" for i in range(200)]
    began = time.time()
    got = embedding.embed_texts(texts, s, batch=5, at_once=7)
    assert [v for v, *_ in got] == [[float(i)] for i in range(200)]
    assert 2 <= s.most <= 7 and len(s.calls) == 40 and time.time() - began < 40 * 0.04


def test_one_call_at_a_time():
    s = Service(0.001)
    embedding.embed_texts([f"t {i}" for i in range(30)], s, batch=3, at_once=1)
    assert s.most == 1


def test_a_hanging_call_times_out_and_holds_up_no_other():
    s = Service(0.01)
    texts = ["hang 0" if i == 4 else None if i == 7 else f"t {i}" for i in range(40)]
    began = time.time()
    got = embedding.embed_texts(texts, s, batch=2, attempts=1, at_once=4, timeout=0.3)
    assert time.time() - began < 3
    assert [st for _, st, *_ in got] == ["failed" if i == 4 else "skipped" if i == 7 else "completed" for i in range(40)]
    assert got[4][2] == "no answer within 0.3 s" and got[5][0] == [5.0] and got[5][3] == 2


def test_a_service_that_never_answers_is_given_up():
    s = Service()
    began = time.time()
    got = embedding.embed_batch([f"hang {i}" for i in range(20)], s, 2, 0.0, 0.1)
    assert time.time() - began < 2 and len(s.calls) == 2 + embedding.GIVE_UP
    assert {x[1:3] for x in got} == {("failed", "no answer within 0.1 s")} and [x[3] for x in got] == [3] * 3 + [2] * 17


def test_pauses_grow_and_do_not_stop_other_batches():
    s = Service(0.0)
    began = time.time()
    got = embedding.embed_texts(["bad 0", *[f"t {i}" for i in range(1, 9)]], s, batch=1, attempts=3, pause=0.2, at_once=2)
    took = time.time() - began
    assert 1.4 <= took < 3 and [x[1] for x in got] == ["failed"] + ["completed"] * 8 and got[0][3] == 4
    order = [c[0] for c in s.calls]
    assert order.index("t 2") < len(order) - 1 - order[::-1].index("bad 0")  # went on while the first waited


def test_wrong_number_of_vectors_is_a_failure():
    assert embedding.embed_batch(["a", "b"], lambda t: [[1.0]], 1, 0.0) == [([1.0], "completed", None, 2)] * 2


def test_embed_keeps_rows_and_their_order(spark):
    def slow(texts):
        time.sleep(0.05 if "3" in texts[0] else 0.0)
        return [[float(t)] for t in texts]

    df = spark.range(0, 500, 1, 2).selectExpr("id", "cast(id AS string) AS t")
    got = embedding.embed(df, slow, "t", batch=10, at_once=5).rdd.glom().collect()
    assert [[r.id for r in part] for part in got] == [list(range(250)), list(range(250, 500))]
    assert all(r.embedding == [float(r.id)] for part in got for r in part)


def test_fetches_at_once_with_time_out(spark):
    def service(url):
        if url == "u3":
            time.sleep(5)
        return 200, url.encode()

    df = spark.range(0, 20, 1, 1).selectExpr("id", "concat('u', id) AS url")
    began = time.time()
    got = mail.fetch(df, service, at_once=4, timeout=0.5).collect()
    assert time.time() - began < 5 and [r.id for r in got] == list(range(20))
    assert {r.id: r.fetch_error for r in got if r.fetch_error} == {3: "no answer within 0.5 s"} and bytes(got[19].content) == b"u19"


def test_options_reach_the_services(spark):
    spark.conf.set("spark.corvella.embedding_calls", "2")
    spark.conf.set("spark.corvella.email_batch", "4")
    o = Options.of(spark)
    assert o.embedder() == {"batch": 300, "attempts": 3, "pause": 1.0, "at_once": 2, "timeout": 30.0}
    assert o.mail_embedder()["batch"] == 4 and o.batcher() == {"n": 4, "wait_seconds": 5.0} and o.fetcher()["at_once"] == 8
    df = spark.createDataFrame([("1",)], "text_content string")
    assert embedding.embed(df, lambda t: [[1.0]] * len(t), **o.embedder()).first().embedding == [1.0]
    assert mail.fetch(df.withColumnRenamed("text_content", "url"), lambda u: (200, b""), **o.fetcher()).first().fetch_error is None
    for name in ("embedding_calls", "email_batch"):
        spark.conf.unset(f"spark.corvella.{name}")


@pytest.mark.parametrize("wrong", [{"email_batch": 101}, {"email_wait_seconds": 61.0}, {"email_batches_at_once": 0}, {"email_batches_at_once": 11}])
def test_options_out_of_range(wrong):
    with pytest.raises(ValueError):
        Options(**wrong)
