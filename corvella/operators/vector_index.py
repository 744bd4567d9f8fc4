"""Approximate vector search: an inverted file of lists around centroids, with product codes and exact re-ranking.

train() fits centroids, code books and the number of lists to look at on a bounded sample (SAMPLE rows by hash of the id)
and build() then puts every row into the list of its centroid, in a table partitioned by list. search() reads only the
lists near a query; a task orders a list's rows by their codes, where a batch has more of them than are to be re-ranked, and
scores the first ones (else all) from their vectors, as top_k_each does over all rows, so that only the best of each batch are
shuffled. search(exact=True) then also reads the lists that may still hold a better row (a list's radius
bounds the cosine of all its rows), so that nothing is missed; how much that saves depends on the data.

Vectors are compared by cosine; a zero vector has 0 with all. Rows with a null id or vector, with a null, infinite or
undefined component, or of another length than most of the sample are in no list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import AT_ONCE, FOUND, best_batch, matrix, query_blocks, ranked

SAMPLE = 20_000  # rows that an index is trained on: the bound of the fit
CODES = 256
ASKED = 200  # sample rows that the number of lists is chosen by
ROWS = 2048  # rows that a task puts into lists at once


@dataclass
class Index:
    """What was learned: unit centroids, code books of the residuals by part, how many lists a search looks at and rows it re-ranks."""

    centroids: np.ndarray
    books: np.ndarray  # part, code, dimension within the part
    lists_asked: int
    reranked: int
    sample_recall: float

    def codes(self, unit: np.ndarray, of: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        rest = _padded(unit - self.centroids[of], parts * width).reshape(len(unit), parts, width)
        return np.stack([_nearest(rest[:, p], self.books[p]) for p in range(parts)], axis=1).astype(np.uint8)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """For each query, what each code of each part adds to the inner product."""
        parts, _, width = self.books.shape
        return np.einsum("qpw,pcw->qpc", _padded(unit, parts * width).reshape(len(unit), parts, width), self.books)


def _units(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm == 0, 1.0, norm)


def _padded(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * rows @ centres.T, axis=1) if len(rows) else np.zeros(0, np.int64)


def _means(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means of a sample; centres that lose all their rows move to rows drawn anew."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        of = _nearest(rows, centres)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rows[rng.integers(len(rows), size=k)])
    return centres


def _usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    whole = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    return whole if width is None else whole.where(F.size("embedding") == width)


def train(vectors: DataFrame, k: int = 10, recall: float = 0.97, lists: int | None = None, part_width: int = 4, rounds: int = 10, sample: int = SAMPLE, seed: int = 42) -> Index:
    """An index of vectors (vec_id, embedding). lists: the square root of the number of rows if not given, at most a quarter of the sample.

    The number of lists to look at and of rows to re-rank is the least, in steps, by which searches for rows of the sample find
    the share recall of their k nearest sample rows."""
    rows = _usable(vectors)
    total = rows.count()
    picked = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()["embedding"]
    width = max(Counter(len(v) for v in picked).items(), key=lambda x: (x[1], x[0]), default=(1, 0))[0] or 1
    x = matrix(pa.array([list(v) for v in picked if len(v) == width], pa.list_(pa.float64())), width)[0]
    if not len(x):
        return Index(np.zeros((1, 1)), np.zeros((1, CODES, 1)), 1, k, 1.0)
    n = max(1, min(lists or int(total**0.5), len(x) // 4 or 1))
    centroids = _units(_means(x, n, rounds, seed))
    of = np.argmax(x @ centroids.T, axis=1)
    parts = -(-width // part_width)
    rest = _padded(x - centroids[of], parts * part_width).reshape(len(x), parts, part_width)
    books = np.stack([_means(rest[:, p], CODES, rounds, seed + p) for p in range(parts)])
    index = Index(centroids, books, n, len(x), 1.0)
    asked = np.random.default_rng(seed).choice(len(x), min(ASKED, len(x)), replace=False)
    true = x[asked] @ x.T
    true[np.arange(len(asked)), asked] = -2
    best = np.argsort(-true, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    codes, near, tables = index.codes(x, of), np.argsort(-(x[asked] @ centroids.T), axis=1), index.tables(x[asked])
    guess = np.stack([(x[q] @ centroids.T)[of] + t[np.arange(parts), codes].sum(axis=1) for q, t in zip(asked, tables, strict=True)])
    guess[np.arange(len(asked)), asked] = -9
    steps = [(kept, share) for kept in (10, 30, 100) for share in (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)]
    for kept, share in steps:
        probes, found = max(1, int(np.ceil(share * n))), []
        for q in range(len(asked)):
            open_ = np.flatnonzero(np.isin(of, near[q, :probes]))
            first = open_[np.argsort(-guess[q, open_], kind="stable")[: k * kept]]
            found.append(np.isin(best[q], first).mean() if best.shape[1] else 1.0)
        # Of more rows than the sample has, more are re-ranked, in proportion.
        index.lists_asked, index.reranked, index.sample_recall = probes, int(k * kept * max(1.0, total / len(x))), float(np.mean(found))
        if index.sample_recall >= recall:
            break
    return index


def build(vectors: DataFrame, index: Index, path: str) -> DataFrame:
    """Writes every row of vectors (vec_id, embedding and what else they have) to path, partitioned by list, with its code and its cosine with the centroid."""
    width = index.centroids.shape[1]
    kept = _usable(vectors, width).drop("list", "code", "near")
    at = kept.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(x, ROWS) for b in batches for x in range(0, b.num_rows, ROWS)):
            unit = matrix(b.column(at), width)[0]
            cosines = unit @ index.centroids.T
            of = np.argmax(cosines, axis=1) if len(unit) else np.zeros(0, np.int64)
            near = cosines[np.arange(len(unit)), of]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in index.codes(unit, of)], pa.binary()), pa.array(near), pa.array(of.astype(np.int32))], names=[*b.schema.names, "code", "near", "list"])

    schema = kept.withColumns({"code": F.lit(b""), "near": F.lit(0.0), "list": F.lit(0)}).schema
    # A list that holds many of the rows is split among writers.
    kept.mapInArrow(run, schema).hint("rebalance", "list").write.partitionBy("list").mode("overwrite").parquet(path)
    return kept.sparkSession.read.schema(schema).parquet(path)


def _within(rows: DataFrame, index: Index, ids: np.ndarray, unit: np.ndarray, places: np.ndarray, k: int, keep: int | None = None) -> DataFrame:
    """The k best rows of each query in its lists (places, by query and list). keep: rows of a list and a batch that are scored for a query, the first by code; all if not given."""
    asked, width = _asked(places), unit.shape[1]

    def first(q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The keep first rows for each query, as booleans; the list's own share is the same for all of them."""
        guess = sum(np.take(t, c, axis=1) for t, c in zip(index.tables(unit[q]).transpose(1, 0, 2), codes.T, strict=True))
        out = np.zeros(guess.shape, bool)
        np.put_along_axis(out, np.argpartition(-guess, keep - 1, axis=1)[:, :keep], True, axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, of, x = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), matrix(b.column(1), width)[0]
            for one in np.unique(of).tolist():
                own = np.flatnonzero(of == one)
                some = keep is not None and len(own) > keep
                codes = np.frombuffer(b"".join(b.column(3).take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1) if some else None
                for at in range(0, len(asked[one]), AT_ONCE):
                    q = asked[one][at : at + AT_ONCE]
                    scores = unit[q] @ x[own].T
                    yield best_batch(ids[q], vec[own], np.where(first(q, codes), scores, -np.inf) if some else scores, k)

    read = rows.where(F.col("list").isin(sorted(asked))).select(F.col("vec_id").cast("long"), "embedding", "list", "code")
    return ranked(read.mapInArrow(run, FOUND), k)


def _asked(places: np.ndarray) -> dict[int, np.ndarray]:
    """Places of queries by list, from a table of booleans (query, list)."""
    return {int(k): np.flatnonzero(places[:, k]) for k in np.flatnonzero(places.any(axis=0))}


def search(rows: DataFrame, index: Index, queries: DataFrame, k: int = 10, exact: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest rows (of build) of each query (query_id, query_vector), itself left out; ties by vec_id.

    The queries are a stated set; they pass through the driver in blocks. Scores are rounded as by top_k_each. Queries of
    another length than the index's vectors find nothing."""
    out = None
    for ids, lists in query_blocks(queries):
        unit, good = matrix(lists, index.centroids.shape[1])
        ids, unit = ids[good], unit[good]
        near = unit @ index.centroids.T
        first = np.zeros(near.shape, bool)
        np.put_along_axis(first, np.argsort(-near, axis=1)[:, : index.lists_asked], True, axis=1)
        if exact:
            best = _exactly(rows, index, ids, unit, near, first, k)
        else:
            best = _within(rows, index, ids, unit, first, k, index.reranked + 1)  # one of them may be the query itself
        out = best if out is None else out.unionByName(best)
    return out if out is not None else ranked(rows.sparkSession.createDataFrame([], FOUND), k)


def _exactly(rows: DataFrame, index: Index, ids: np.ndarray, unit: np.ndarray, near: np.ndarray, first: np.ndarray, k: int) -> DataFrame:
    """Every row of the lists that may hold one of the k nearest: first those asked anyway, then those whose radius reaches what these found."""
    found = _within(rows, index, ids, unit, first, k)
    least = {r.query_id: r.score for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}  # a number for each query of the block
    radius = np.full(near.shape[1], -1.0)
    for r in rows.groupBy("list").agg(F.min("near").alias("near")).collect():  # a number for each list
        radius[r["list"]] = np.arccos(np.clip(r.near, -1, 1))
    angle = np.arccos(np.clip(near, -1, 1))
    reach = np.cos(np.maximum(angle - radius, 0))  # no row of the list is nearer
    floor = np.array([least.get(int(i), -2.0) for i in ids])
    more = ~first & (radius >= 0) & (np.maximum(reach, 0.0) >= floor[:, None] - 1e-5)  # a zero vector scores 0 wherever it lies
    if not more.any():
        return found
    return ranked(found.unionByName(_within(rows, index, ids, unit, more, k)).drop("rank"), k)


def recall(found: DataFrame, true: DataFrame, k: int = 10) -> DataFrame:
    """One row: how many queries there are, and the share of their true nearest rows (query_id, vec_id) that were found."""
    hits = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
