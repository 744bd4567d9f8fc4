"""Token-id files: fixed-size blocks of ids, transposed into bit or byte planes, each plane compressed with zstandard.

A file: MAGIC, then the planes of block after block, then the chunk index, then a footer. The index holds,
for each block, its offset, its count of ids and the size of each plane (0: all zero, not stored), and the
ids and token counts of the documents in the file, so that a block or a document is read without the rest.

Rows: a null text is the empty text (its ids are the end id alone); a null doc_id is kept and sorts first;
repeated doc_ids follow each other, ordered by text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_by_worker, open_fs, scratch, unit_keys, unit_text

MAGIC = b"CBPF0002"
INDEX = struct.Struct("<QQBQ")  # blocks, documents, planes of a block, bytes of the compressed table of blocks
FOOTER = struct.Struct("<QQQI8s")  # index offset and size, ids in the file, ids in a block, MAGIC
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 22
MARKS = ".,;:!?$%#*&|<>()+=_-"  # behind a word
MANIFEST = "shard int, part int, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """32 bit planes or 4 byte planes of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    cells = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(cells[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        cells = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                cells[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(cells, axis=1, bitorder="little")
    return raw.view("<u4").reshape(-1)


class Writer:
    """Builds one file in memory, which holds at most about file_ids ids, compressed."""

    def __init__(self, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3):
        import zstandard

        self.press = zstandard.ZstdCompressor(level=level)
        self.block_ids, self.bits = block_ids, bits
        self.body, self.size, self.index, self.rest, self.held = [MAGIC], len(MAGIC), [], [], 0
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.counts: list[int] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for i in range(0, end, self.block_ids):
            block = ids[i : min(i + self.block_ids, end)]
            planes = [b"" if not any(p) else self.press.compress(p) for p in to_planes(block, self.bits)]
            self.index.append((self.size, len(block), [len(p) for p in planes]))
            self.body += planes
            self.size += sum(map(len, planes))
        self.rest, self.held = [ids[end:]], len(ids) - end

    def close(self) -> bytes:
        self._flush(True)
        n, planes = len(self.index), 32 if self.bits else 4
        table = np.array([[o, c, *sizes] for o, c, sizes in self.index], "<u8").reshape(n, 2 + planes)
        docs = np.array([self.docs, self.counts, self.nulls], "<i8").reshape(3, -1)
        blocks = self.press.compress(table.tobytes())
        index = INDEX.pack(n, docs.shape[1], planes, len(blocks)) + blocks + self.press.compress(docs.tobytes())
        return b"".join([*self.body, index, FOOTER.pack(self.size, len(index), self.n_ids, self.block_ids, MAGIC)])


class Reader:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        import zstandard

        self.data, self.press = memoryview(data), zstandard.ZstdDecompressor()
        at, size, self.n_ids, self.block_ids, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC or bytes(self.data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a file of bit planes")
        index = bytes(self.data[at : at + size])
        n, n_docs, self.planes, size = INDEX.unpack(index[: INDEX.size])
        blocks, docs = index[INDEX.size : INDEX.size + size], index[INDEX.size + size :]
        self.table = np.frombuffer(self.press.decompress(blocks), "<u8").reshape(n, 2 + self.planes) if n else np.zeros((0, 6), "<u8")
        self.docs = np.frombuffer(self.press.decompress(docs), "<i8").reshape(3, -1) if n_docs else np.zeros((3, 0), "<i8")

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.table[k])
        planes: list[bytes | None] = []
        for s in sizes:
            planes.append(self.press.decompress(self.data[at : at + s]) if s else None)
            at += s
        return from_planes(planes, n, self.planes == 32)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the file; only the blocks that hold them are read."""
        if n <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's place in the file, ids), block by block."""
        at, k, rest = 0, 0, np.zeros(0, "<u4")
        for doc, n, null in self.docs.T.tolist():
            while len(rest) < n:
                rest, k = np.concatenate([rest, self.block(k)]), k + 1
            yield (None if null else doc), at, rest[:n]
            rest, at = rest[n:], at + n


class Units(dict):
    """Ids of text units as bytes. A new unit gets an empty place, which is filled when the library has encoded it.

    new: the units whose places are empty yet.
    older: the units of the generation before; those that are asked for again outlive the change.
    """

    def __init__(self, older: dict[str, bytes]):
        super().__init__()
        self.older, self.new = older, {}

    def __missing__(self, key: str) -> bytes | bytearray:
        got = self.older.get(key) or self._apart(key)
        if got is None:
            got = self.new[key] = bytearray()
        self[key] = got
        return got

    def _apart(self, key: str) -> bytes | None:
        """Ids of a known word and of the marks behind it: no match of the pattern holds a letter and such a mark."""
        word = key.rstrip(MARKS)
        if word == key or not (word[-1:].isalpha() and word[-1] < "\u0250"):  # what is a letter beyond depends on the version of Unicode
            return None
        ids, marks = self.get(word) or self.older.get(word), self["\x00" + key[len(word) :]]
        return ids + marks if ids and marks else None

    def fill(self, keys: Iterable[str], raws: Iterable[bytes]) -> None:
        for key, raw in zip(keys, raws, strict=True):
            place = self.new.pop(key)
            place += raw
            self[key] = raw


class LibraryEncoder:
    """The tokenizers library behind a bounded cache of text units, whose ids do not depend on their neighbours.

    literal: the added tokens of the vocabulary are read as plain text; else, as the library does by default, as
    their ids, and texts that hold one are encoded whole.
    """

    def __init__(self, path: str, units: int = 1_000_000, literal: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.encode_special_tokens = literal
        getattr(self.tk.model, "_resize_cache", int)(0)  # units are kept here, and few of those that are new come twice
        self.added = [t.content for t in self.tk.get_added_tokens_decoder().values() if t.content and not (literal and t.special)]
        self.bytes_of = np.array([len(self.tk.id_to_token(i) or "") for i in range(self.tk.get_vocab_size())], np.int64)  # a letter of a piece stands for a byte
        self.units, self.limit = Units({}), units // 2

    def whole(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, keys: list[str]) -> None:
        """Units that begin with a space or a line break are encoded as one text, cut again where their bytes end."""
        alone = [k for k in keys if k[:1] == "\x00"]
        joined = [k for k in keys if k[:1] != "\x00"]
        for i in range(0, len(joined), 500):
            some = joined[i : i + 500]
            text = (" " + " ".join(some)).replace(" \n", "\n")
            ids = np.array(self.tk.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
            size = np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))  # bytes of UTF-8 up to a character's end
            at, ends = np.cumsum(self.bytes_of[ids]), size[np.append(np.flatnonzero((chars == 0x20) | (chars == 0x0A))[1:], 0) - 1]
            cut = np.searchsorted(at, ends)
            if cut[-1] < len(at) and (at[cut] == ends).all():
                self._cut(some, ids, cut + 1)
            else:
                alone += some
        if alone:
            got = self.tk.encode([unit_text(k) for k in alone], is_pretokenized=True, add_special_tokens=False)
            owner = np.array([-1 if w is None else w for w in got.word_ids], np.int64)
            self._cut(alone, np.array(got.ids, "<u4"), np.searchsorted(owner, np.arange(len(alone)), "right"))

    def _cut(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, last = ids.tobytes(), (4 * ends).tolist()
        self.units.fill(keys, map(raw.__getitem__, map(slice, [0, *last], last)))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian bytes."""
        for i in range(0, len(texts), 256):
            some = texts[i : i + 256]
            if self.units.new:  # left empty by texts that failed
                self.units = Units({})
            elif len(self.units) > self.limit:
                self.units.older, self.units = {}, Units(self.units)
            keys = [None if t and any(a in t for a in self.added) else unit_keys(t or "") for t in some]
            found = [list(map(self.units.__getitem__, k or ())) for k in keys]
            self._learn(list(self.units.new))
            for k, f, t in zip(keys, found, some, strict=True):
                yield self.whole(t) if k is None else b"".join(f)


def encoder(path: str, literal: bool = False) -> LibraryEncoder:
    """One for each worker process, so that its cache lasts from task to task."""
    return kept_by_worker(lambda: LibraryEncoder(path, literal=literal), "ids", path, literal)


def write_ids(docs: DataFrame, vocabulary: str, folder: str, *, end_id: int = 0, bits: bool = False, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, literal: bool = False) -> DataFrame:
    """Encodes doc_id, text in ascending doc_id order into files below folder; returns the manifest, a row a file.

    literal: whether added tokens in a text are read as plain text; as in the library they are not by default.

    Ranges of doc_id are dealt to tasks, so no task or the driver holds more than its share. A task writes
    each file under a name of its own try and then moves it to its final name, so that a repeated task
    replaces a file with the same bytes.
    """
    spark = docs.sparkSession

    def write(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        shard, tag = ctx.partitionId(), ctx.taskAttemptId()
        enc = encoder(vocabulary, literal)
        fs, root = open_fs(folder)
        end = np.array([end_id], "<u4").tobytes()
        rows, part, w = [], 0, Writer(block_ids, bits)

        def finish():
            nonlocal part, w
            if w.counts:
                data, name = w.close(), f"{root}/ids-{shard:06d}-{part:06d}.cbp"
                with fs.open_output_stream(f"{root}/_{shard}-{part}-{tag}.tmp") as out:
                    out.write(data)
                fs.move(f"{root}/_{shard}-{part}-{tag}.tmp", name)
                rows.append((shard, part, len(w.counts), w.n_ids, len(data)))
            part, w = part + 1, Writer(block_ids, bits)

        fs.create_dir(root, recursive=True)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                for d, raw in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    w.add(d, np.frombuffer(raw + end, "<u4"))
                    if w.n_ids >= file_ids:
                        finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "part", "n_docs", "n_ids", "n_bytes"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row a document from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard, part = map(int, path.rsplit("/", 1)[1][4:-4].split("-"))
                rows = [(shard, part, doc, at, len(ids), zlib.crc32(ids.tobytes())) for doc, at, ids in Reader(content.as_buffer()).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "part", "doc_id", "at", "n_tokens", "ids_crc32"])

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.cbp").load(folder).select("path", "content")
    docs = files.mapInArrow(read, "shard int, part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # A row a file: few enough for one ordered running sum.
    firsts = manifest.withColumn("first", F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")).select("shard", "part", "first")
    return docs.join(firsts, ["shard", "part"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    folder = scratch(spark, "op7")
    manifest = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_ids(spark, folder, manifest)
