"""Ranked lexical search, score at a time over postings grouped by exact impact.

A first pass sums over the corpus what the weights need. In a second one each task indexes its documents, some MB at a
time: a term's postings ordered by impact, highest first, cut into groups of one impact each. For an item the groups of
all its terms are taken in the order of what they add to a score. After each round the largest remaining addition of
every term bounds what a document may still gain; once no document that has not been met can reach the k-th best score
known to the task, and completing what was met is cheaper than going on, the scores of those that can still reach it are
completed from the documents' own lists of terms. A task keeps its k best for each item, so that later pieces stop
sooner, and Spark merges the tasks' best in two steps.

The items are a stated query set. They pass through the driver in blocks of at most block_words words, each with its own
passes over the documents; only a block's words and their counts are sent to the tasks.

Rows: null and empty texts have no terms, do not count and match nothing; repeated rows are each a document; a null
doc_id comes after all others; items of one item_id are one item with the terms of all its rows, those of a null one
too; items without terms and terms that no document has give nothing; an empty table gives an empty result. Columns but
the ids and text are ignored. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .wordhash import ALNUM, Words, pieces

PIECE_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max
SALTS = 32


class Items:
    """Terms of a block of items: their hashes, and the terms of each item with how often it has them."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        self.names = [n for n, _ in rows]
        words = Words(pa.array([t for _, t in rows], pa.string()), ALNUM)
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        each = [np.unique(ids[a:b], return_counts=True) for a, b in zip(words.first, words.first[1:], strict=False)]
        self.terms = [t for t, _ in each]
        self.repeats = [n.astype(np.int64) for _, n in each]

    def postings(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of the block's terms, by document and term."""
        size = len(self.vocabulary)
        if not size:
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), size - 1)
        known = self.vocabulary[at] == words.hash
        pairs, tf = np.unique(words.doc[known] * size + at[known], return_counts=True)
        return pairs // size, pairs % size, tf.astype(np.int64)


class Weights:
    """N documents with L terms in all, and the weight of each term that some document has."""

    def __init__(self, documents: int, length: int, df: np.ndarray):
        self.documents, self.length = documents, length
        self.of = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a posting adds for each unit of its term's weight."""
        m = 75 + (25 * n * self.documents) // max(1, self.length)
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Index:
    """Documents of one piece: own lists of terms, and for each term its postings in groups of one impact."""

    def __init__(self, items: Items, weights: Weights, words: Words):
        self.rows = len(words.count)
        self.doc, self.term, tf = items.postings(words)
        self.impact = weights.impacts(tf, words.count[self.doc])
        self.own = np.searchsorted(self.doc, np.arange(self.rows + 1))
        order = np.lexsort((-self.impact, self.term))
        self.met, term, impact = self.doc[order], self.term[order], self.impact[order]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(impact) != 0)])) if len(term) else np.zeros(0, np.int64)
        self.begin = np.concatenate([head, [len(term)]])  # of each group, among met
        self.group_impact = impact[head]
        self.groups = np.searchsorted(term[head], np.arange(len(items.vocabulary) + 1))  # of each term


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def best(index: Index, terms: np.ndarray, weight: np.ndarray, k: int, known: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, exact scores) of all that may be among the k best; known: a score that k documents reach. units: zeros, by term."""
    a, b = index.groups[terms], index.groups[terms + 1]
    keep = (b > a) & (weight > 0)
    terms, weight, a, size = terms[keep], weight[keep], a[keep], (b - a)[keep]
    group = _ranges(a, size)
    adds = index.group_impact[group] * np.repeat(weight, size)
    which = np.repeat(np.arange(len(terms)), size)
    order = np.argsort(-adds, kind="stable")
    group, which = group[order], which[order]
    first = np.cumsum(size) - size
    begin, count = index.begin[group], index.begin[group + 1] - index.begin[group]
    ends = np.cumsum(count)  # postings up to each group
    score, done, met, left = np.zeros(index.rows, np.int64), 0, 0, np.zeros(len(terms), np.int64)
    rest, floor, step = 0, known, 512
    while done < len(group):
        end = min(len(group), int(np.searchsorted(ends, met + step)) + 1)
        part = slice(done, end)
        np.add.at(score, index.met[_ranges(begin[part], count[part])], np.repeat(adds[order[part]], count[part]))
        left += np.bincount(which[part], minlength=len(terms))
        done, met, step = end, int(ends[end - 1]), 2 * step
        open_ = left < size
        rest = int(adds[(first + left)[open_]].sum())
        if index.rows > k:
            floor = max(known, int(np.partition(score, index.rows - k)[index.rows - k]))
        if rest < floor:
            candidates = int(np.count_nonzero(score >= floor - rest))
            if candidates * len(index.doc) <= (ends[-1] - met) * index.rows:
                break
    docs = np.flatnonzero(score >= max(1, floor - rest))
    if rest:  # completed from the documents' own lists
        units[terms] = weight
        size = index.own[docs + 1] - index.own[docs]
        at = _ranges(index.own[docs], size)
        total = np.concatenate([[0], np.cumsum(units[index.term[at]] * index.impact[at])])
        units[terms] = 0
        return docs, total[np.cumsum(size)] - total[np.cumsum(size) - size]
    return docs, score[docs]


def _totals(docs: DataFrame, items: Items) -> Weights:
    size = len(items.vocabulary)

    def count(batches):
        df, documents, length = np.zeros(size, np.int64), 0, 0
        for batch in pieces(batches, 1, PIECE_BYTES):
            words = Words(batch.column(1), ALNUM)
            df += np.bincount(items.postings(words)[1], minlength=size)
            documents += int((words.count > 0).sum())
            length += len(words.hash)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some]), pa.int64()), pa.array(np.concatenate([[documents, length], df[some]]), pa.int64())], names=["term", "n"])

    df, rest = np.zeros(size, np.int64), {-2: 0, -1: 0}
    for term, n in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each word of the block
        if term < 0:
            rest[term] = n
        else:
            df[term] = n
    return Weights(rest[-2], rest[-1], df)


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    weights = _totals(docs, items)

    def run(batches):
        ids = [np.zeros(0, np.int64)] * len(items.names)
        scores = [np.zeros(0, np.int64)] * len(items.names)
        units = np.zeros(len(items.vocabulary), np.int64)
        for batch in pieces(batches, 1, PIECE_BYTES):
            names = batch.column(0).fill_null(NO_ID).to_numpy()
            index = Index(items, weights, Words(batch.column(1), ALNUM))
            for i, (terms, repeats) in enumerate(zip(items.terms, items.repeats, strict=True)):
                known = int(scores[i][-1]) if len(scores[i]) == k else 0
                docs, found = best(index, terms, weights.of[terms] * repeats, k, known, units)
                every, of = np.concatenate([scores[i], found]), np.concatenate([ids[i], names[docs]])
                first = np.lexsort((of, -every))[:k]
                scores[i], ids[i] = every[first], of[first]
        out = [(items.names[i], None if d == NO_ID else d, s) for i in range(len(ids)) for d, s in zip(ids[i].tolist(), scores[i].tolist(), strict=True)]
        columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    found = docs.mapInArrow(run, "item_id string, doc_id long, score long").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "salt"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame, block_words: int) -> Iterator[Items]:
    block, held = [], 0
    whole = items.where("text IS NOT NULL").groupBy("item_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    for name, text in whole.toLocalIterator():
        block.append((name, text))
        held += len(text) // 2 + 1
        if held >= block_words:
            yield Items(block)
            block, held = [], 0
    if block:
        yield Items(block)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_words: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) of each item (item_id, text), ties by doc_id."""
    kind = items.schema["item_id"].dataType
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    out, last = None, None
    for block in _blocks(asked, block_words):
        if last is not None:  # written, so that the plan holds one block
            last = stored(last, "ranked")
            out = last if out is None else out.unionByName(last)
        last = _search(texts, block, k)
    if last is None:
        last = _search(texts, Items([]), k)
    out = last if out is None else out.unionByName(last)
    return out.withColumn("item_id", F.col("item_id").cast(kind))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
g AS (SELECT cast(count(*) AS bigint) AS n_docs, cast(sum(len(w)) AS bigint) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1))) AS bigint) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
i AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS impact FROM p, g),
s AS (SELECT item_id, doc_id, cast(sum(repeats * weight * impact) AS bigint) AS score FROM q JOIN f USING (t) JOIN i USING (t) GROUP BY ALL)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS integer) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""
