"""Vector search and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine


def scored(vectors: DataFrame, query: list[float] | DataFrame) -> DataFrame:
    """vectors with their cosine (score) to one vector, given by its numbers or as a table of one row and column."""
    if isinstance(query, DataFrame):
        one = F.broadcast(query.limit(1).toDF("_query"))  # one row
        return vectors.crossJoin(one).withColumn("score", cosine(F.col("embedding"), F.col("_query"))).drop("_query")
    return vectors.withColumn("score", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))


def top_k(vectors: DataFrame, query: list[float] | DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine search for one vector; ties by id. Filter vectors before the call."""
    return scored(vectors, query).orderBy(F.desc(F.round("score", 9)), "vec_id").limit(k)


#: Queries, and numbers of their vectors, that are sent to the tasks at once.
BLOCK, NUMBERS = 4096, 2_000_000
#: Queries that a task scores at once against a batch of rows.
AT_ONCE = 256


def matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of one width with norm 1 or 0, which of the lists are such vectors); the others have zeros."""
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    whole = flat.null_count == 0
    good = size == width
    out = np.zeros((len(lists), width))
    if whole and good.all():
        out = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    else:
        for k in np.flatnonzero(good).tolist():
            own = lists[k].as_py()
            good[k] = None not in own
            out[k] = own if good[k] else 0.0
    good &= np.isfinite(out).all(axis=1)
    out = np.where(good[:, None], out, 0.0)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm == 0, 1.0, norm), good


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Blocks (ids, vectors) of queries (query_id, query_vector) that have both, read through the driver one after the other."""
    ids, lists, held = [], [], 0
    for r in queries.select("query_id", "query_vector").where("query_id IS NOT NULL AND query_vector IS NOT NULL").toLocalIterator():
        ids.append(r.query_id)
        lists.append(list(r.query_vector))
        held += len(lists[-1])
        if len(ids) == BLOCK or held >= NUMBERS:
            yield np.array(ids, np.int64), pa.array(lists, pa.list_(pa.float64()))
            ids, lists, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), pa.array(lists, pa.list_(pa.float64()))


FOUND = "query_id long, vec_id long, score double"


def best_batch(ids: np.ndarray, vec: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """FOUND rows of the k best of each query (ids, the rows of scores) but itself, and of all that rounding may bring level with them; -inf is no score."""
    n = scores.shape[1]
    least = np.partition(scores, n - k - 1, axis=1)[:, n - k - 1] if n > k + 1 else np.full(len(scores), -np.inf)  # one may be the query's own row
    q, row = np.nonzero((scores >= least[:, None] - 2e-6) & np.isfinite(scores))
    other = vec[row] != ids[q]
    q, row = q[other], row[other]
    return pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(vec[row], pa.int64()), pa.array(scores[q, row], pa.float64())], names=["query_id", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, scores rounded to six places; ties by vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact search for a stated set of query vectors (query_id, query_vector): query_id, vec_id, score, rank, the query's own row left out.

    The queries are sent to the tasks in blocks, each with a pass of its own over the vectors; a task scores a batch of rows by
    matrix products, AT_ONCE queries a time, and only the best of each batch are shuffled. Rows without an id, and vectors that are null, of another
    length than the query's or hold what is no number, are no neighbours; a zero vector has cosine 0 with all."""
    rows, out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL"), None
    for ids, lists in query_blocks(queries):
        best = _block(rows, ids, lists, k)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else _block(rows, np.zeros(0, np.int64), pa.array([], pa.list_(pa.float64())), k)


def _block(rows: DataFrame, ids: np.ndarray, lists: pa.Array, k: int) -> DataFrame:
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    groups = []
    for width in np.unique(sizes):
        own = np.flatnonzero(sizes == width)
        unit, good = matrix(lists.take(pa.array(own)), int(width))
        groups.append((int(width), ids[own[good]], unit[good]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(0).to_numpy()
            for width, asked, unit in groups:
                x, usable = matrix(b.column(1), width)
                for q in range(0, len(asked), AT_ONCE):
                    yield best_batch(asked[q : q + AT_ONCE], vec[usable], unit[q : q + AT_ONCE] @ x[usable].T, k)

    return ranked(rows.mapInArrow(run, FOUND), k)


def hashed(codes: Column, dims: int = 64) -> Column:
    """Entries (dim, x) of a unit vector from the 16-bit codes of a text's words: a code's slot, and its top bit as the sign.

    Slots that no word has are left out; where the signs cancel everywhere, x is null."""

    @F.arrow_udf("array<struct<dim:long,x:double>>")
    def fold(lists: pa.Array) -> pa.Array:
        n = len(lists)
        code = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64) * dims + code % dims
        sums = np.bincount(slot, np.where(code >= 32768, 1.0, -1.0), n * dims).reshape(n, dims)
        seen = np.bincount(slot, minlength=n * dims).reshape(n, dims) > 0
        norm = np.sqrt((sums * sums).sum(axis=1))
        row, dim = np.nonzero(seen)
        x = sums[row, dim] / np.where(norm == 0, 1.0, norm)[row]
        ends = np.concatenate([[0], np.cumsum(seen.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(dim.astype(np.int64)), pa.array(x, mask=(norm == 0)[row])], names=["dim", "x"]))

    return fold(codes)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    return vectors.select(by, F.posexplode("embedding").alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
