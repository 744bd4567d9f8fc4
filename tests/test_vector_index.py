"""The inverted file against exact search."""

import re

import numpy as np
import pytest
from corvella.operators import vector_index, vectors


def clustered(n, dim=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dim))
    return [(i, [float(x) for x in centres[i % 30] + 0.4 * r.normal(size=dim)], i % 3) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    odd = [(9000, None, 0), (None, [1.0] * 16, 0), (9001, [0.0] * 16, 1), (9002, [], 1), (9003, [1.0], 2), (9004, [float("nan")] * 16, 0), (5, clustered(6)[5][1], 2)]
    return spark.createDataFrame(clustered(3000) + odd, "vec_id long, embedding array<float>, label int").cache()


@pytest.fixture(scope="module")
def built(data, tmp_path_factory):
    index = vector_index.train(data, lists=40)
    return vector_index.build(data, index, str(tmp_path_factory.mktemp("index") / "rows")), index


def asked(data):
    return data.where("vec_id % 100 = 0 AND embedding IS NOT NULL AND vec_id < 9000").selectExpr("vec_id AS query_id", "embedding AS query_vector")


def whole(data):
    return data.where("vec_id IS NOT NULL AND size(embedding) = 16 AND NOT isnan(embedding[0])")


def plain(df, queries, k):
    """Cosines by NumPy."""
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    out = {}
    for q, v in queries:
        score = [(-round(float(v @ x) / (np.linalg.norm(v) * np.linalg.norm(x)), 6) if x.any() else 0.0, i) for i, x in rows if i != q]
        out[q] = [i for _, i in sorted(score)[:k]]
    return out


def test_every_row_is_in_a_list(data, built):
    rows, index = built
    usable = whole(data)
    assert rows.count() == usable.count() and rows.select("list").distinct().count() > 20
    assert set(rows.columns) == {"vec_id", "embedding", "label", "code", "near", "list"}
    assert index.sample_recall >= 0.97 and index.lists_asked < 40


def test_recall_of_the_search(data, built):
    rows, index = built
    q = asked(data)
    found = vector_index.search(rows, index, q, 10)
    true = vectors.top_k_each(whole(data), q, 10)
    r = vector_index.recall(found, true).first()
    assert r.queries == 30 and r.recall >= 0.9
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    assert found.join(true, ["query_id", "vec_id"]).where(found["score"] != true["score"]).count() == 0  # re-ranked from the vectors


def test_exact_search_misses_nothing(data, built):
    rows, index = built
    narrow = vector_index.Index(index.centroids, index.books, 1, index.reranked, 0.0)  # few lists at first
    got = {}
    for r in sorted(vector_index.search(rows, narrow, asked(data), 10, exact=True).collect()):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    queries = [(r.query_id, np.array(r.query_vector, float)) for r in asked(data).collect()]
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == plain(whole(data), queries, 10)


def test_only_lists_near_the_queries_are_read(built, data):
    rows, index = built
    plan = vector_index.search(rows, index, asked(data).limit(1), 10)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ (IN|INSET) ", plan)


def test_filtered_and_blocked_searches(data, built, monkeypatch):
    rows, index = built
    only = rows.where("label = 1")
    got = vector_index.search(only, index, asked(data), 5, exact=True)
    assert got.join(data.where("label <> 1 AND vec_id <> 5"), "vec_id").count() == 0
    whole = sorted(map(tuple, vector_index.search(rows, index, asked(data), 5).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(map(tuple, vector_index.search(rows, index, asked(data), 5).collect())) == whole and len(whole) == 150


def test_no_rows_and_no_queries(spark, data, built, tmp_path):
    none = data.limit(0)
    index = vector_index.train(none)
    rows = vector_index.build(none, index, str(tmp_path / "none"))
    assert rows.count() == 0 and vector_index.search(rows, index, asked(data), 5).count() == 0
    assert vector_index.search(*built, asked(none), 5).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    index = vector_index.train(one)
    rows = vector_index.build(one, index, str(tmp_path / "one"))
    q = spark.createDataFrame([(7, [1.0, 2.0]), (8, [0.0, 0.0]), (None, [1.0, 1.0]), (9, None)], "query_id long, query_vector array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in vector_index.search(rows, index, q, 5).collect()) == [(7, 0, 1.0), (8, 0, 0.0)]


def test_recall_on_the_given_embeddings(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vector_index.train(e)
    q = e.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    found = vector_index.search(vector_index.build(e, index, str(tmp_path / "given")), index, q)
    assert vector_index.recall(found, vectors.top_k_each(e, q)).first().recall >= 0.9


def test_exact_search_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [-1.0, 0.0]), (2, [0.0, 5.0]), (9, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [0.0, 0.0]), (52, None), (None, [1.0, 1.0]), (53, [1.0]), (54, [float("inf"), 0.0])], "query_id long, query_vector array<double>")
    got: dict = {}
    for r in vectors.top_k_each(v, q, 3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {1: [(2, 1.0), (2, 0.0), (3, 0.0)], 50: [(2, 1.0), (1, 0.0), (2, 0.0)], 51: [(1, 0.0), (2, 0.0), (2, 0.0)], 53: [(5, 1.0)]}
    assert vectors.top_k_each(v, q.limit(0), 3).count() == vectors.top_k_each(v.limit(0), q, 3).count() == 0


def test_tasks_score_few_queries_at_once_and_ship_the_best_alone(spark, data, built, monkeypatch):
    """What a task holds does not grow with queries times rows: only the best of a batch leave it, in batches of few queries."""
    rows, index = built
    seen = []
    ranked = vector_index.ranked
    monkeypatch.setattr(vector_index, "ranked", lambda found, k: seen.append(found.count()) or ranked(found, k))
    q = data.where("vec_id < 300 AND embedding IS NOT NULL").selectExpr("vec_id AS query_id", "embedding AS query_vector").dropDuplicates(["query_id"])
    wide = vector_index.Index(index.centroids, index.books, 40, 3000, 0.0)
    found = vector_index.search(rows, wide, q, 2).collect()
    assert len(found) == 600 and seen[0] <= 300 * 40 * 4 * 4  # lists, tasks, rows of each; the shortlist would have 900,000
    asked = np.array([(1.0, 0.0)] * 3), np.arange(3)
    batch = vectors.best_batch(asked[1], np.arange(100), asked[0] @ np.stack([np.linspace(-1, 1, 100), np.zeros(100)]), 2)
    assert batch.num_rows == 9 and set(batch.column(1).to_pylist()) == {97, 98, 99}


def test_codes_shorten_long_lists(data, built):
    rows, index = built
    few = vector_index.Index(index.centroids, index.books, 40, 30, 0.0)
    true = vectors.top_k_each(whole(data), asked(data), 10)
    assert vector_index.recall(vector_index.search(rows, few, asked(data), 10), true).first().recall >= 0.9
