"""Substring deduplication by level-wise doubling: words in a window that occurs elsewhere go.

Documents are packed into runs of some MB, written once. On the first level the hashes of all short windows of
a run are sorted, dealt out by ranges of hashes, and those that two runs have come back to their runs as bits. A
window of the next level, of twice the length (the last one of the length asked for, so that its halves overlap),
is a candidate only if both halves are repeated; only candidates are hashed and dealt out again, until none is
left or the length is reached. Short levels compare as many bits of a hash as the corpus needs, which may add
candidates and loses none; the last one compares all 64 bits.

A run names each of its hashes once, so that a window with thousands of copies is no larger than another. Nothing is
held by the driver but sums; ranges of hashes are as many as the words ask for.

Rows: null and empty texts have no words; texts shorter than a window lose nothing; repeated rows lose all
that a window covers, first ones too; an empty table gives an empty one. Other columns are kept as they are;
columns named like a result column are replaced. Word sequences are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import discard, stored, table
from .wordhash import NON_SPACE, Words, pieces, scramble

RESULT = "n_words long, repeated_spans array<int>, kept string"
NAMES = ["n_words", "repeated_spans", "kept"]
RUN_BYTES = 8 << 20
#: Words of a range of hashes, which one task sorts.
RANGE_WORDS = 1 << 22
DEALT = "run long, bucket int, bits binary"
STATE = -1  # the bucket of a row that holds a run's candidates


def levels(window: int, least: int = 9) -> list[int]:
    """Lengths from the first of about least words to the window, each at most twice the one before."""
    out = [window]
    while out[0] > least:
        out.insert(0, -(-out[0] // 2))
    return out


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows that begin at each word, from those of their halves; the last ones mean nothing."""
    if size == 1:
        return words
    half = -(-size // 2)
    h = window_hash(words, half)
    out = np.zeros(len(h), np.uint64)
    n = max(0, len(h) - (size - half))
    out[:n] = scramble(h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[size - half :] + np.uint64(size))
    return out


def _combined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for piece in pieces(batches, column, RUN_BYTES):
        n = piece.column(column).nbytes
        if held and size + n > RUN_BYTES:
            yield _combined(held)
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield _combined(held)


def _packed(docs: DataFrame, column: int) -> DataFrame:
    """Runs of documents with all their columns, each compressed into one row."""

    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(_runs(batches, column)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            n = len(Words(batch.column(column), NON_SPACE, lower=False).hash)
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([n]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["run", "n", "rows"])

    return stored(docs.mapInArrow(pack, "run long, n long, rows binary"), "runs")


def _unpacked(rows: bytes) -> pa.RecordBatch:
    return _combined(list(pa.ipc.open_stream(rows)))


class Level:
    """What a run's windows of one length are compared by: some first bits of their hashes, dealt out by ranges."""

    def __init__(self, size: int, bits: int, buckets: int):
        self.size, self.bits, self.buckets = size, bits, buckets

    def values(self, words: Words, at: np.ndarray) -> np.ndarray:
        return window_hash(words.hash, self.size)[at] >> np.uint64(64 - self.bits)

    def cuts(self, values: np.ndarray) -> np.ndarray:
        """Where each bucket's values begin among sorted ones."""
        bucket = ((values >> np.uint64(self.bits - 32)) * np.uint64(self.buckets)) >> np.uint64(32)
        return np.searchsorted(bucket, np.arange(self.buckets + 1).astype(np.uint64))


def _fitting(words: Words, size: int) -> np.ndarray:
    """Whether a window of a document begins at each word."""
    at = np.arange(len(words.hash))
    return at + size <= words.first[1:][words.doc]


def _press(values: np.ndarray, codec) -> bytes:
    """Sorted values as byte planes of their differences."""
    return codec.compress(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _pressed(data: bytes, codec) -> np.ndarray:
    planes = np.frombuffer(codec.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1))


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _repeated(words: Words, level: Level, notes: dict[int, bytes], first: bool) -> np.ndarray:
    """Whether a window of the level that begins at each word is repeated; notes: what came back, by bucket."""
    if first:
        candidates = _fitting(words, level.size)
    else:
        candidates = _bits(notes[STATE], len(words.hash)) if STATE in notes else np.zeros(len(words.hash), bool)
    at = np.flatnonzero(candidates)
    values, which, counts = np.unique(level.values(words, at), return_inverse=True, return_counts=True)
    found, cuts = counts > 1, level.cuts(values)
    for bucket, bits in notes.items():
        if bucket != STATE:
            found[cuts[bucket] : cuts[bucket + 1]] |= _bits(bits, cuts[bucket + 1] - cuts[bucket])
    out = np.zeros(len(words.hash), bool)
    out[at[found[which]]] = True
    return out


def _notes(batch: pa.RecordBatch, row: int) -> dict[int, bytes]:
    notes = batch.column("notes")[row].as_py()
    return {x["bucket"]: x["bits"] for x in notes or []}


def _deal(source: DataFrame, steps: list[Level], column: int) -> DataFrame:
    """DEALT rows of the last of steps: the hashes of each run's candidates, and the candidates themselves beyond the first."""

    def run(batches):
        import zstandard

        codec, new = zstandard.ZstdCompressor(level=1), steps[-1]
        for batch in batches:
            for row in range(batch.num_rows):
                name, words = batch.column("run")[row].as_py(), Words(_unpacked(batch.column("rows")[row].as_py()).column(column), NON_SPACE, lower=False)
                candidates, out = _fitting(words, new.size), []
                if len(steps) > 1:
                    old = _repeated(words, steps[-2], _notes(batch, row), len(steps) == 2)
                    step = new.size - steps[-2].size
                    candidates &= old
                    candidates[: len(old) - step] &= old[step:]
                    if candidates.any():
                        out.append((STATE, np.packbits(candidates).tobytes()))
                values = np.unique(new.values(words, np.flatnonzero(candidates)))
                cuts = new.cuts(values)
                out += [(k, _press(values[a:b], codec)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                for at in range(0, len(out), 64):
                    part = out[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.int64()), pa.array([k for k, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], names=["run", "bucket", "bits"])

    return source.mapInArrow(run, DEALT)


def _shared(dealt: DataFrame, buckets: int) -> DataFrame:
    """For each run and bucket, which of its values another run has too; nothing where none is shared."""

    def judge(runs: list[int], blobs: list[bytes]) -> list[tuple[int, bytes]]:
        import zstandard

        codec = zstandard.ZstdDecompressor()
        values = [_pressed(b, codec) for b in blobs]
        every = np.sort(np.concatenate(values))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for name, own in zip(runs, values, strict=True):
            found = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own if len(twice) else np.zeros(1, bool)
            if found.any():
                out.append((name, np.packbits(found).tobytes()))
        return out

    def run(batches):
        now, runs, blobs = None, [], []
        for bucket, name, bits in (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("bucket", "run", "bits")), strict=True)):
            if bucket != now and runs:
                yield from rows(now, judge(runs, blobs))
                runs, blobs = [], []
            now = bucket
            runs.append(name)
            blobs.append(bits)
        if runs:
            yield from rows(now, judge(runs, blobs))

    def rows(bucket, found):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([bucket] * len(found), pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["run", "bucket", "bits"])

    return dealt.where(F.col("bucket") != STATE).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, DEALT)


def _judged(source: DataFrame, last: Level, only: bool, column: int, schema: StructType) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                docs = _unpacked(batch.column("rows")[row].as_py())
                words = Words(docs.column(column), NON_SPACE, lower=False)
                begins = _repeated(words, last, _notes(batch, row), only)
                edge = np.zeros(len(begins) + last.size + 1, np.int64)
                edge[: len(begins)] += begins
                edge[last.size : last.size + len(begins)] -= begins
                gone = np.cumsum(edge)[: len(begins)] > 0
                counts, spans, kept = words.count, [], []
                for text, a, b in zip(docs.column(column).to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    mask = gone[a:b]
                    spans.append(np.flatnonzero(np.diff(mask, prepend=False, append=False)).astype(np.int32))
                    own = (text or "").encode().split()  # at the same bytes as NON_SPACE
                    kept.append(b" ".join(compress(own, ~mask) if len(spans[-1]) else own))
                new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*docs.columns, *new], names=schema.names)

    return source.mapInArrow(run, schema)


def find(docs: DataFrame, window: int = 35) -> DataFrame:
    """The documents with the columns of RESULT: words, spans of repeated ones (begin, end, begin, ...), and the others joined by a space."""
    docs = docs.drop(*NAMES)
    column = docs.columns.index("text")
    schema = StructType(docs.schema.fields + _parse_datatype_string(RESULT).fields)
    runs = _packed(docs, column)
    n = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_WORDS))
    some = min(64, max(40, int(n).bit_length() + 8))
    sizes = levels(window)
    steps = [Level(s, 64 if s == window else some, buckets) for s in sizes]
    rows = runs.select("run", "rows")
    source, old = rows.withColumn("notes", F.lit(None).cast("array<struct<bucket:int,bits:binary>>")), []
    for k in range(len(steps)):
        dealt = _deal(source, steps[: k + 1], column)
        dealt = stored(dealt, "dealt") if k else dealt  # read twice
        shared = stored(_shared(dealt, buckets), "shared")
        for x in old:
            discard(x)
        old = [shared, dealt] if k else [shared]
        notes = shared.unionByName(dealt.where(F.col("bucket") == STATE)) if k else shared
        notes = notes.groupBy("run").agg(F.collect_list(F.struct("bucket", "bits")).alias("notes"))
        source = rows.join(notes.hint("shuffle_hash"), "run", "left")
        if k and dealt.isEmpty():  # no candidates are left: later levels have none either
            break
    return _judged(source, steps[-1], len(steps) == 1, column, schema)


def remove(docs: DataFrame, window: int = 35) -> DataFrame:
    """The documents with their kept words as texts, joined by a space; other columns are kept, whatever their names."""
    plain = docs.toDF(*["text" if c == "text" else f"column{k}" for k, c in enumerate(docs.columns)])
    found = find(plain, window)
    return found.select(*[F.col("kept").alias(c) if c == "text" else F.col(c) for c in plain.columns]).toDF(*docs.columns)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    removed = F.aggregate("repeated_spans", F.lit(0), lambda s, x: x - s)
    return find(docs).select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
p AS (SELECT doc_id, a, array_to_string(list_slice(w, a, a + 34), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS a FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, a FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 35)) AS q FROM r),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(len(w) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
