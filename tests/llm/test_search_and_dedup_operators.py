"""Impact-ordered search, level-wise doubling and hard negatives against plain versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.llm import hard_negatives, impact_search, queries, substring_dedup
from tests.oracle import rows, sql_rows

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_impact_ordered", "op12_level_doubling", "op13_score_sort"])
def test_against_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    columns, want = sql_rows(small, queries.ORACLE_SQL[name])
    assert sorted(got.columns) == columns and rows(got) == want and len(want)


# -- level-wise doubling


def plain_dedup(texts, window):
    lists = [SPACE.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[a : a + window]) for w in lists for a in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["a", "A", "b", "é", "中文", "x1", "word" * 30]
    texts = [" ".join(r.choices(words, k=r.randrange(60))) for _ in range(40)]
    passage = " ".join(r.choices(words, k=50))
    texts += [passage, passage + " a", "b\n" + passage.replace(" ", "\t"), f"{passage} {passage}", "a " * 200, None, "", " \n", "x\x1fy", "a\xa0b c " * 30]
    return texts + texts[:3]


@pytest.mark.parametrize("window", [1, 2, 3, 8, 9, 10, 35])
def test_doubling_against_brute_force(spark, window, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN_BYTES", 600)  # many runs
    texts = corpus(window)
    docs = spark.createDataFrame([(i, t, "k", [7]) for i, t in enumerate(texts)], "doc_id long, text string, kept string, spans array<int>").repartition(3)
    got = substring_dedup.find(docs, window).collect()
    want = plain_dedup(texts, window)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, sum(b - a for a, b in zip(r.repeated_spans[::2], r.repeated_spans[1::2], strict=True)), r.kept) == want[r.doc_id]
        assert r.spans == [7]


def test_levels_double():
    assert substring_dedup.levels(35) == [9, 18, 35] and substring_dedup.levels(9) == [9] and substring_dedup.levels(1) == [1]
    for n in range(1, 200):
        steps = substring_dedup.levels(n)
        assert steps[-1] == n and all(a < b <= 2 * a for a, b in zip(steps, steps[1:], strict=False))


def test_windows_of_equal_words_have_equal_hashes():
    h = np.random.default_rng(1).integers(0, 1 << 63, 6).astype(np.uint64)
    words = np.concatenate([h[[0, 1] * 20], h[[1, 0] * 20], h[[0, 1] * 20], h[2:]])
    for n in (1, 2, 5, 8, 35):
        got = substring_dedup.window_hash(words, n)[: len(words) - n + 1]
        by = collections.defaultdict(set)
        for a, x in enumerate(got):
            by[tuple(words[a : a + n])].add(int(x))
        assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)


def test_doubling_of_nothing_and_of_all(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.find(none).count() == 0
    alone = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    assert [(r.n_words, r.repeated_spans, r.kept) for r in substring_dedup.find(alone).orderBy("doc_id").collect()] == [(3, [], "one two three"), (0, [], "")]
    text = " ".join(f"w{i}" for i in range(40))
    twice = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, text + "\ntail end", 6)], "doc_id long, text string, column0 int")
    assert sorted(map(tuple, substring_dedup.remove(twice).collect())) == [(1, "", 5), (1, "", 5), (2, "tail end", 6)]


def test_a_very_long_text(spark):
    words = [f"w{i % 70001}" for i in range(140_030)]
    got = substring_dedup.find(spark.createDataFrame([(1, " ".join(words)), (2, "x" * 3_000_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].n_words == 140_030 and got[0].repeated_spans == [0, 140_030] and got[1].kept == "x" * 3_000_000


# -- impact-ordered search


def plain_search(docs, items, k):
    lists = [(i, [w for w in TERM.findall((t or "").translate(UPPER))]) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in lists), sum(len(w) for _, w in lists)
    df = collections.Counter(t for _, w in lists for t in set(w))
    asked = collections.defaultdict(list)
    for name, t in items:
        asked[name] += TERM.findall((t or "").translate(UPPER))
    out = []
    for name, terms in asked.items():
        found = []
        for i, w in lists:
            tf, score = collections.Counter(w), 0
            for t in terms:
                if tf[t]:
                    m = 100 - 25 + (25 * len(w) * n_docs) // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(name, r, x[2], x[3]) for r, x in enumerate(found[:k], 1)]
    return out


def search_case(seed):
    r = random.Random(seed)
    words = [f"t{i}" for i in range(60)] + ["Ärger", "ärger", "中文", "x'y", "A_B"]
    pick = lambda n: " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, pick(r.randrange(1, 80))) for i in range(300)]
    docs += [(1000 - i, docs[5][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, "...")]
    items = [(j, pick(r.randrange(1, 20))) for j in range(12)] + [(3, pick(4)), (None, "t1 t2"), (50, None), (51, "nowhere"), (52, "T1 t1 T1"), (53, "t0 " * 40)]
    return docs, items


@pytest.mark.parametrize("k, parts, block", [(20, 1, 10**6), (3, 5, 10**6), (1, 2, 10), (400, 3, 10**6)])
def test_search_against_brute_force(spark, k, parts, block, monkeypatch):
    monkeypatch.setattr(impact_search, "PIECE_BYTES", 3000)
    docs, items = search_case(k)
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double").repartition(parts)
    got = impact_search.search(d, spark.createDataFrame([(j, t, 0) for j, t in items], "item_id long, text string, rank int"), k, block).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(plain_search(docs, items, k), key=key)


def test_search_stops_before_the_last_posting():
    """With many common postings of low impact, the bound ends the rounds and the scores are completed."""
    r = random.Random(3)
    texts = [" ".join(r.choices(["c1", "c2", "c3"], k=200)) for _ in range(4000)] + ["rare c1 c2"] * 3
    items = impact_search.Items([("q", "rare rare rare rare c1")])
    import pyarrow as pa

    words = impact_search.Words(pa.array(texts), impact_search.ALNUM)
    df = np.bincount(items.postings(words)[1], minlength=len(items.vocabulary))
    weights = impact_search.Weights(len(texts), len(words.hash), df)
    index = impact_search.Index(items, weights, words)
    docs, scores = impact_search.best(index, items.terms[0], weights.of[items.terms[0]] * items.repeats[0], 3, 0, np.zeros(len(items.vocabulary), np.int64))
    want = plain_search(list(enumerate(texts)), [("q", "rare rare rare rare c1")], 3)
    assert sorted(zip(docs.tolist(), scores.tolist(), strict=True)) == [(d, s) for _, _, d, s in want]


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id int, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    assert impact_search.search(docs, items).count() == impact_search.search(some, items).count() == impact_search.search(docs, some.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    got = impact_search.search(some, some.select(F.col("doc_id").alias("item_id"), "text"))
    assert dict(got.dtypes)["item_id"] == "int"


# -- hard negatives


def plain_mine(vectors, n_pos=5, n_neg=5):
    use = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, v, y in vectors if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _, _ in use if i % 100 == 0}):
        y, v = min((y, v) for j, y, v in use if j == i)
        scored = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), j, z) for j, z, u in use if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:n_pos]:
            hard = [(-t, h) for t, h, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:n_neg]
            out += [(i, j, r, h, -s, t) for r, (t, h) in enumerate(hard, 1)]
    return sorted(out)


def vectors_case(seed):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in base[i % 4]], r.randrange(3)) for i in range(350)]
    same = [0.5] * 6
    rows += [(1000 + i, same, i % 3) for i in range(60)]  # ties, with anchors 1000
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2100, [float("nan")] * 6, 1), (2200, [float("inf")] * 6, 1), (2300, same, None), (None, same, 1)]
    rows += [(2400, [], 1), (2500, [1.0, 2.0], 2), (3, rows[3][1], rows[3][2]), (100, rows[100][1], 2), (2600, [-0.5] * 6, 0)]
    return rows


@pytest.mark.parametrize("parts, block", [(1, 2048), (4, 3)])
def test_mining_against_brute_force(spark, parts, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    data = vectors_case(block)
    df = spark.createDataFrame([(i, v, y, 0) for i, v, y in data], "vec_id long, embedding array<double>, label int, rank int").repartition(parts)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == plain_mine(data) and len(got) > 50


def test_mining_of_large_numbers_and_of_nothing(spark):
    big = [(0, [1e5, 1e5], 1), (1, [1e5, 1e5], 1), (2, [1e5, 99999.0], 2), (3, [3e38, 0.0], 2)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.mine(df, F.col("vec_id") == 0).collect()
    square = 25600000**2
    assert [(r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got] == [(1, 2, 2 * square, square + 25600000 * 25599744)]
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df.where("vec_id > 0"), F.col("vec_id") % 100 == 0).count() == 0
