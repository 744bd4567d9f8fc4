"""Benchmark decontamination with suffix arrays over shards of the training texts.

A task cuts its documents into shards, sorts the suffixes of each shard's words, and looks up every test
suffix by binary search. Suffixes that begin with a word that no test text has cannot match one and are
left out of the array. Matches along a diagonal join to the longest verbatim match, with its place.

The test set is a stated query set. It is sent to the tasks in blocks of at most block_words words. All blocks but the
last take a pass over the texts alone, of which only what hits is written (before the next block is read into a set, so
that nothing that grows is broadcast or held by the driver); the last one passes over the rows, and what the others found
is joined to them by the text's MD5. longest_matches looks every test suffix up, the last words of an item too, and
finds its longest verbatim match of any length.

Words are compared by 64-bit hashes. Rows: null and empty texts have no words and are clean; repeated rows
are judged each for itself; test texts that are null or empty match nothing; test rows with the same
item_id are one item, those with a null one too, which has no name among the items; with an empty test set all documents are clean. Other columns of the documents are
kept as they are; columns named like a result column are replaced in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .wordhash import ALNUM, Words, pieces

RESULT = "n_words long, hit_spans array<int>, items array<string>, longest long, longest_item string, longest_at long"
NAMES = ["n_words", "hit_spans", "items", "longest", "longest_item", "longest_at"]


class TestSet:
    """Words of test texts as small ids, and their windows."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.names = [None if i is None else str(i) for i, _ in items]
        words = Words(pa.array([t or "" for _, t in items], pa.string()), ALNUM)
        self.count = words.count
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        self.ids = np.concatenate([ids.astype(np.int64) + 1, np.zeros(window + 64, np.int64)])
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per = max(1, 62 // self.bits)  # one more than the last key must not overflow
        self.n_keys = -(-window // self.per)
        # The suffixes that begin a window, the item of each and the window's length.
        size = np.minimum(words.count, window)
        n_windows = np.where(words.count > 0, words.count - size + 1, 0)
        self.item = np.repeat(np.arange(len(items)), n_windows)
        first = np.repeat(words.first[:-1], n_windows)
        self.at = first + (np.arange(len(self.item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows))
        self.place = self.at - first
        self.size = np.repeat(size, n_windows)

    def keys(self, ids: np.ndarray, at: np.ndarray, size: np.ndarray | None = None, fill: int = 0) -> list[np.ndarray]:
        """The first n_keys * per words from each place, packed; beyond size words all bits are fill."""
        out, pad = [], (1 << self.bits) - 1
        for k in range(self.n_keys):
            key = np.zeros(len(at), np.int64)
            for j in range(k * self.per, (k + 1) * self.per):
                word = ids[at + j] if j < self.window else np.zeros(len(at), np.int64)
                if size is not None:
                    word = np.where(j < size, word, pad * fill)
                key = (key << self.bits) | word
            out.append(key)
        return out

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == hashes, k + 1, 0)


class SuffixArray:
    """Suffixes of one shard, sorted by their first words."""

    def __init__(self, test: TestSet, words: Words):
        self.test = test
        rows = len(words.count)
        ids = np.zeros(len(words.hash) + rows + test.window + 64, np.int64)
        self.where = np.arange(len(words.hash)) + words.doc  # a zero stands between documents
        ids[self.where] = test.word_ids(words.hash)
        self.ids = ids
        begin = np.flatnonzero(ids)
        keys = test.keys(ids, begin)
        order = np.lexsort(keys[::-1])
        self.suffixes, self.keys = begin[order], [k[order] for k in keys]

    def search(self, keys: list[np.ndarray]) -> np.ndarray:
        """How many suffixes are smaller than each key, by binary search of all keys at once."""
        n = len(self.suffixes)
        low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), n)
        for _ in range(int(n).bit_length() + 1):
            going = low < high
            if not going.any():
                break
            mid = np.minimum((low + high) // 2, n - 1)
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for own, asked in zip(self.keys, keys, strict=True):
                less |= same & (own[mid] < asked)
                same &= own[mid] == asked
            low, high = np.where(going & less, mid + 1, low), np.where(going & ~less, mid, high)
        return low

    def range(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 of the suffixes that begin with so many words (a window at most) of the test suffixes at these places."""
        t = self.test
        low = self.search(t.keys(t.ids, at, size))
        return low, self.search([k + (i == t.n_keys - 1) for i, k in enumerate(t.keys(t.ids, at, size, 1))])

    def between(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, place in the shard) of all suffixes in the ranges."""
        n = high - low
        return np.repeat(at, n), self.suffixes[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, window) of all occurrences of the windows."""
        t = self.test
        if not len(self.suffixes) or not len(t.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        window, place = self.between(np.arange(len(t.at)), *self.range(t.at, t.size))
        return place, window


def judge(test: TestSet, words: Words) -> list[tuple]:
    """A row of RESULT for each document of a shard."""
    array = SuffixArray(test, words)
    at, window = array.matches()
    word = np.searchsorted(array.where, at)  # index of the word in the shard
    doc = words.doc[word]
    out = [[int(n), [], [], 0, None, None] for n in words.count]
    if not len(at):
        return out
    word = word - words.first[doc]
    # Covered spans of each document.
    order = np.lexsort((word, doc))
    d, a, b = doc[order], word[order], word[order] + test.size[window[order]]
    lift = np.int64(1) << 40
    reach = np.maximum.accumulate(d * lift + b)
    new = np.concatenate([[True], (d * lift + a)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(d)]]) - 1
    for k, s, e in zip(d[first].tolist(), a[first].tolist(), (reach[last] - d[last] * lift).tolist(), strict=True):
        out[k][1] += [s, e]
    # Items, and the longest match: windows in a row on one diagonal of a document and an item.
    item = test.item[window]
    order = np.lexsort((word, word - test.place[window], item, doc))
    d, i, a, w = doc[order], item[order], word[order], window[order]
    diagonal = a - test.place[w]
    new = np.concatenate([[True], (np.diff(d) != 0) | (np.diff(i) != 0) | (np.diff(diagonal) != 0) | (np.diff(a) > 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(d)]]) - 1
    length = a[last] - a[first] + test.size[w[last]]
    for k, x, s, n in zip(d[first].tolist(), i[first].tolist(), a[first].tolist(), length.tolist(), strict=True):
        out[k][2].append(test.names[x])
        if n > out[k][3]:
            out[k][3:] = [n, test.names[x], s]
    return out


def _merge(old: dict, row: list) -> None:
    """Adds what an earlier pass has found."""
    spans = sorted(zip(old["hit_spans"][::2] + row[1][::2], old["hit_spans"][1::2] + row[1][1::2], strict=True))
    flat: list[int] = []
    for a, b in spans:
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    row[1] = flat
    row[2] = old["items"] + row[2]
    if old["longest"] >= row[3]:
        row[3:] = [old["longest"], old["longest_item"], old["longest_at"]]


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    block, held = [], 0
    for i, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        block.append((i, text or ""))
        held += len(text or "") // 2 + 1
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def find(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """The documents with the columns of RESULT: words in hit spans, items, and the longest match with its place."""
    docs = docs.drop(*NAMES)
    earlier, held = [], []
    for block in _blocks(items, block_words):
        if held:
            earlier.append(stored(_hits(docs, TestSet(held, window)), "hits"))
        held = block
    last = _pass(docs, TestSet(held, window))
    if not earlier:
        return last
    hits = reduce(DataFrame.unionByName, earlier)  # a row a text and block
    hits = hits.groupBy("text_md5").agg(F.collect_list(F.struct("hit_spans", "items", "longest", "longest_item", "longest_at")).alias("hits"))
    key = F.md5(F.col("text").cast("binary"))
    return _merged(last.join(hits, key == F.col("text_md5"), "left").drop("text_md5"), last.schema)


def _arrays(rows: list[list], names: list[str]) -> list[pa.Array]:
    kinds = dict(zip(NAMES, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()), strict=True))
    return [pa.array([r[NAMES.index(n)] for r in rows], kinds[n]) for n in names]


def _hits(docs: DataFrame, test: TestSet) -> DataFrame:
    """What hits: the text's MD5 and the columns of RESULT but n_words; equal texts once."""

    def run(batches):
        for batch in pieces(batches, 0):
            texts = batch.column(0)
            rows = [(k, list(r)) for k, r in enumerate(judge(test, Words(texts, ALNUM))) if r[1]]
            keys = pa.array([hashlib.md5(texts[k].as_py().encode("utf-8", "surrogatepass")).hexdigest() for k, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([keys, *_arrays([r for _, r in rows], NAMES[1:])], names=["text_md5", *NAMES[1:]])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "text_md5 string, " + RESULT.split(", ", 1)[1])
    return found.groupBy("text_md5").agg(F.first(F.struct(*NAMES[1:])).alias("r")).select("text_md5", "r.*")


def _merged(rows: DataFrame, schema) -> DataFrame:
    """The rows with what earlier blocks have found (column hits, null for nothing)."""
    n = len(schema.names) - len(NAMES)

    def run(batches):
        for batch in batches:
            out = [list(r.values()) for r in batch.select(NAMES).to_pylist()]
            for row, found in zip(out, batch.column("hits").to_pylist(), strict=True):
                for old in found or ():
                    _merge(old, row)
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + _arrays(out, NAMES), names=schema.names)

    return rows.mapInArrow(run, schema)


def _pass(docs: DataFrame, test: TestSet) -> DataFrame:
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType(docs.schema.fields + _parse_datatype_string(RESULT).fields)
    column = docs.columns.index("text")

    def run(batches):
        for batch in pieces(batches, column):
            rows = [list(r) for r in judge(test, Words(batch.column(column), ALNUM))]
            yield pa.RecordBatch.from_arrays(batch.columns + _arrays(rows, NAMES), names=schema.names)

    return docs.mapInArrow(run, schema)


MATCH = "item_id string, length long, item_at long, doc_id long, doc_at long"


def longest_matches(docs: DataFrame, items: DataFrame, block_words: int = 1_000_000) -> DataFrame:
    """For each item (item_id) the longest run of its words that stands in a document, of any length, with both places (in words).

    Of equal lengths that with the smallest item_at, then doc_id (a null one last), then doc_at. Items that share no word with any
    document give nothing."""
    kind = items.schema["item_id"].dataType
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in _blocks(items, block_words):
        one = stored(_best(_longest(texts, TestSet(block, 10))), "matches")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = _longest(texts, TestSet([], 10))
    return _best(found).withColumn("item_id", F.col("item_id").cast(kind))


def _best(found: DataFrame) -> DataFrame:
    first = F.struct((-F.col("length")).alias("n"), "item_at", F.col("doc_id").isNull().alias("none"), "doc_id", "doc_at")
    return found.groupBy("item_id").agg(F.min(first).alias("s")).select("item_id", (-F.col("s.n")).alias("length"), "s.item_at", "s.doc_id", "s.doc_at")


def _longest(texts: DataFrame, test: TestSet) -> DataFrame:
    starts = np.concatenate([[0], np.cumsum(test.count)]) if len(test.names) else np.zeros(1, np.int64)
    every = np.arange(int(starts[-1]))
    item = np.repeat(np.arange(len(test.names)), test.count)
    left = starts[1:][item] - every if len(every) else every

    def run(batches):
        for batch in pieces(batches, 1):
            words = Words(batch.column(1), ALNUM)
            array = SuffixArray(test, words)
            n = len(array.suffixes)
            if not n or not len(every):
                continue
            # The neighbours of each test suffix; where they agree with it in a whole window, all that do.
            low, high = array.range(every, np.minimum(left, test.window))
            asked, place = array.between(every, np.maximum(low - 1, 0), np.minimum(high + 1, n))
            length = np.zeros(len(asked), np.int64)
            going = np.arange(len(asked))
            while len(going):
                at = length[going]
                same = (at < left[asked[going]]) & (array.ids[place[going] + at] == test.ids[asked[going] + at])
                going = going[same]
                length[going] += 1
            # The first suffix of each item with the longest match, and all places of that match.
            order = np.lexsort((asked, -length, item[asked]))
            order = order[np.concatenate([[True], np.diff(item[asked[order]]) != 0])]
            suffix, most = asked[order], length[order]
            suffix, most = suffix[most > 0], most[most > 0]
            longest = np.zeros(len(every), np.int64)
            longest[suffix] = most
            long = (length == longest[asked]) & (length >= test.window)
            some = most < test.window
            more = array.between(suffix[some], *array.range(suffix[some], most[some]))
            asked, place = np.concatenate([asked[long], more[0]]), np.concatenate([place[long], more[1]])
            word = np.searchsorted(array.where, place)
            doc, of = words.doc[word], item[asked]
            at_doc = word - words.first[doc]
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)[doc]
            ids = batch.column(0).fill_null(0).to_numpy()[doc]
            order = np.lexsort((at_doc, ids, none, of))
            order = order[np.concatenate([[True], np.diff(of[order]) != 0])] if len(order) else order
            asked = asked[order]
            columns = [pa.array([test.names[k] for k in item[asked]], pa.string()), pa.array(longest[asked]), pa.array(asked - starts[item[asked]]), pa.array(ids[order], mask=none[order]), pa.array(at_doc[order])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MATCH.split(", ")])

    return texts.mapInArrow(run, MATCH)


def remove(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window of a test text occurs, with all their columns, whatever their names."""
    plain = docs.toDF(*["text" if c == "text" else f"column{k}" for k, c in enumerate(docs.columns)])
    return find(plain, items, window).where(F.size("hit_spans") == 0).select(*plain.columns).toDF(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = find(docs, table(spark, sf_dir, "benchmark"))
    spans = F.aggregate("hit_spans", F.lit(0), lambda s, x: x - s)  # b1 - (a1 - (b0 - a0)) for spans in order
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        spans.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove(docs, table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
