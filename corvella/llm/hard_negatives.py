"""Hard negatives by a full sort of each anchor's scores.

Anchors are a stated set. They pass through the driver in blocks of at most BLOCK; each block takes one pass over the
rows for its positives and one for its negatives. A task scores its rows against the block as integers, some thousand
at a time, and sorts each anchor's scores with the ids by lexsort. The first pass keeps the first rows of the
anchor's label. In the second the upper limit of each positive is searched in the sorted scores of the other labels,
and the first rows from there on that reach the lower limit are kept. Spark merges what the parts kept, at most
as many as asked for of each, so that no anchor's scores meet in one task.

Rows: those without id or label, and those with a null vector or a null, infinite or undefined component take
no part. An anchor's other rows are those with another id; of repeated rows each is a row, but only one is an
anchor: that with the smallest label, then vector. Missing components of shorter vectors count as 0; components
beyond 131,072 count as that, so that sums fit 64 bits. Columns but vec_id, embedding and label are ignored.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

BLOCK = 2048
ROWS = 8192
MOST = 1 << 25
POSITIVES = "anchor_id long, vec_id long, score long"
NEGATIVES = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the whole-number components v of the rows that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(256 * c.cast("double")))).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good).select("vec_id", "label", whole.alias("v"))


class Anchors:
    """Ids, labels and components of a block of anchors."""

    def __init__(self, rows: list[tuple[int, int, list[int]]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        self.matrix = np.zeros((len(rows), max([1, *(len(r[2]) for r in rows)])), np.int64)
        for k, r in enumerate(rows):
            self.matrix[k, : len(r[2])] = r[2]
        self.top = int(np.abs(self.matrix).max(initial=0))

    def scores(self, lists: pa.Array) -> np.ndarray:
        """Inner products, one row for each anchor; in floating point where that is exact."""
        width, size = self.matrix.shape[1], pc.list_value_length(lists).to_numpy()
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        inside = place < width
        own = np.zeros((len(lists), width), np.int64)
        own[np.repeat(np.arange(len(lists)), size)[inside], place[inside]] = pc.list_flatten(lists).to_numpy()[inside]
        if width * self.top * int(np.abs(own).max(initial=0)) < 1 << 53:
            return (self.matrix.astype(float) @ own.T.astype(float)).astype(np.int64)
        return self.matrix @ own.T


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), part.column("v")


def _batch(kind: str, found: list[tuple]) -> pa.RecordBatch:
    """The found pieces, each a tuple of numbers or arrays of one length, below each other."""
    names = [c.split()[0] for c in kind.split(", ")]
    pieces = [np.broadcast_arrays(*x) for x in found]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pieces]) if pieces else [], pa.int64()) for k in range(len(names))], names=names)


def _positives(rows: DataFrame, anchors: Anchors, n: int) -> DataFrame:
    def run(batches):
        for ids, labels, v in _parts(batches):
            scores, found = anchors.scores(v), []
            for a, name in enumerate(anchors.ids):
                same = np.flatnonzero((labels == anchors.labels[a]) & (ids != name))
                first = same[np.lexsort((ids[same], -scores[a, same]))[:n]]
                found.append((name, ids[first], scores[a, first]))
            yield _batch(POSITIVES, found)

    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    return rows.mapInArrow(run, POSITIVES).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def _negatives(rows: DataFrame, anchors: Anchors, positives: dict[int, list[tuple[int, int, int]]], n: int, least: int) -> DataFrame:
    def run(batches):
        for ids, labels, v in _parts(batches):
            scores, found = anchors.scores(v), []
            for a, name in enumerate(anchors.ids.tolist()):
                other = np.flatnonzero((labels != anchors.labels[a]) & (ids != name))
                order = other[np.lexsort((ids[other], -scores[a, other]))]
                down = -scores[a, order]
                for place, positive, limit in positives.get(name, ()):
                    begin = np.searchsorted(down, -limit)
                    some = order[begin : begin + n]
                    some = some[scores[a, some] >= -(-least * limit // 100)]
                    found.append((name, place, positive, limit, ids[some], scores[a, some]))
            yield _batch(NEGATIVES, found)

    w = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = rows.mapInArrow(run, NEGATIVES).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _blocks(anchors: DataFrame) -> Iterator[Anchors]:
    block = []
    for row in anchors.toLocalIterator():
        block.append((row.vec_id, row.r.label, row.r.v))
        if len(block) == BLOCK:
            yield Anchors(block)
            block = []
    if block:
        yield Anchors(block)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """For each anchor and each of its first positives, the first rows of other labels that score at most what the positive does
    and at least a share (least, in hundredths) of it: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = usable(vectors)
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    out, last = None, None
    for block in _blocks(anchors):
        if last is not None:  # written, so that the plan holds one block
            last = stored(last, "negatives")
            out = last if out is None else out.unionByName(last)
        known: dict[int, list[tuple[int, int, int]]] = {}
        for r in _positives(rows, block, positives).collect():
            known.setdefault(r.anchor_id, []).append((r.place, r.vec_id, r.score))
        last = _negatives(rows, block, known, negatives, least)
    if last is None:
        last = _negatives(rows, Anchors([]), {}, negatives, least)
    return last if out is None else out.unionByName(last)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, cast(list_inner_product(a.v, r.v) AS bigint) AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS integer) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""
