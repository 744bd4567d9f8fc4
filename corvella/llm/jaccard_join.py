"""Jaccard self-join on word n-grams by vertical partitioning.

The global order of n-grams is by how often they occur, rarest first (levels of a table of counts over all
documents, ties by hash). The order is cut into fragments. The first fragment of a set is its prefix: two sets
that reach the threshold share an n-gram of both prefixes, so that pairs are found there. The overlap of a pair is
counted fragment by fragment, each by itself: in the prefixes first, which drops pairs that the rest cannot
make up for, then in the others, and summed per pair.

Equal sets are one class from the start. An n-gram that one class alone has in its prefix joins nothing and is
left out. Links are found in two steps: each class against the one leader it shares most of its prefix with; then
all pairs that share an n-gram and are not yet in one component. So every link between different components is
tested, and the pairs within a group of copies are not spelled out.

Sets are compared by 52-bit hashes of n-grams, classes by 64-bit sums of them with the size, texts by 64-bit hashes.
Rows: null or empty texts, or texts without words, have no n-grams and stay alone. Every row gives a row, also
where a doc_id comes twice, with one text or with two. A null doc_id is never a component's id, but its text
links like any other and its row gets the component's id. Equal texts are always in one component. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitfilter import bit_filter, passes
from .common import discard, stored, table
from .components import components
from .wordhash import NON_SPACE, Words, mix, pieces

BITS = np.uint64(52)
SLOT_BITS, CHUNKS, PARTS = 22, 64, 4
#: Rows of an n-gram's group that one task meets the others with; larger groups are salted.
GROUP_ROWS = 4096


class Shingles:
    """Sorted distinct n-gram hashes of each row of a shard (of 4,096 rows at most)."""

    def __init__(self, column: pa.Array, n: int):
        w = Words(column, NON_SPACE)
        first, end, count = w.first[:-1], w.first[1:], w.count
        at = np.arange(len(w.hash))
        last = np.repeat(np.maximum(end - n, first), count)  # where the row's last n-gram begins
        begin = at[at <= last]
        length = np.minimum(np.repeat(count, count)[begin], n)
        h = np.zeros(len(begin), np.uint64)
        for k in range(n):
            some = k < length
            word = w.hash[np.minimum(begin + k, len(w.hash) - 1)] if len(begin) else h
            h = np.where(some, (h ^ word) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1), h)
            h ^= h >> np.uint64(32)
        packed = np.sort((w.doc[begin].astype(np.uint64) << BITS) | (mix(h) >> np.uint64(12)))
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
        self.doc = (packed >> BITS).astype(np.int64)
        self.hash = packed & np.uint64((1 << 52) - 1)
        self.first = np.searchsorted(self.doc, np.arange(len(column) + 1))
        self.size = np.diff(self.first)

    def keys(self) -> np.ndarray:
        """The class of each row's set."""
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(mix(self.hash + np.uint64(0x51ED27)), out=total[1:])
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64)).view(np.int64)

    def slots(self) -> np.ndarray:
        return (self.hash >> np.uint64(52 - SLOT_BITS)).astype(np.int64)


def _shards(batches, column: int):
    for batch in pieces(batches, column, 1 << 20):
        for i in range(0, batch.num_rows, 4096):
            yield batch.slice(i, 4096)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (class)."""

    def run(batches):
        for b in _shards(batches, 2):
            s = Shingles(b.column(2), n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.size.astype(np.int64)), pa.array(s.keys())], names=["doc_id", "text_hash", "n_shingles", "key"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, key long")


def gram_levels(docs: DataFrame, n: int) -> np.ndarray:
    """How often n-grams occur in all documents, by slot of their hash: eight steps for each doubling, a byte a slot.

    A table of fixed size; n-grams that share a slot are ordered by the sum. Any such order finds the same pairs.
    """
    import zstandard

    def count(batches):
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        for b in _shards(batches, 0):
            slots, times = np.unique(Shingles(b.column(0), n).slots(), return_counts=True)
            total[slots] += times.astype(np.uint32)
        press = zstandard.ZstdCompressor(level=1)
        for k, part in enumerate(total.reshape(CHUNKS, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([press.compress(part.tobytes())], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        press = zstandard.ZstdDecompressor()
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(press.decompress(c), np.uint32).astype(np.uint64)
        for k, part in sums.items():
            level = np.minimum(8 * np.log2(1 + part.astype(float)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    out = np.zeros((CHUNKS, (1 << SLOT_BITS) // CHUNKS), np.uint8)
    for k, level in docs.select("text").mapInArrow(count, kind).repartition(CHUNKS, "chunk").mapInArrow(add, kind).collect():
        out[k] = np.frombuffer(level, np.uint8)
    return out.reshape(-1)


def pivots(levels: np.ndarray) -> np.ndarray:
    """The levels at which the order is cut into PARTS fragments of about equal numbers of occurrences."""
    weight = np.bincount(levels, np.exp2(levels / 8.0) - 1, minlength=256)
    return np.searchsorted(np.cumsum(weight), weight.sum() * np.arange(1, PARTS) / PARTS, "right").astype(np.uint8)


def _prefixes(docs: DataFrame, n: int, percent: int, levels: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """The prefixes of all classes: h, key, n, pos; a class once for each shard of documents. wanted: a filter of h."""

    def run(batches):
        for b in _shards(batches, 0):
            s = Shingles(b.column(0), n)
            key = s.keys()
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True
            order = np.argsort((s.doc << 8) | levels[s.slots()], kind="stable")  # by document, level, hash
            doc = s.doc[order]
            pos = np.arange(len(doc)) - s.first[doc]
            keep = np.flatnonzero((100 * pos <= (100 - percent) * s.size[doc]) & once[doc])
            h = s.hash[order[keep]].view(np.int64)
            if wanted is not None:
                some = passes(wanted, h)
                keep, h = keep[some], h[some]
            doc = doc[keep]
            cols = [h, key[doc], s.size[doc].astype(np.int32), pos[keep].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols[: 2 if wanted is None else 4]], names=["h", "key", "n", "pos"][: 2 if wanted is None else 4])

    return docs.select("text").mapInArrow(run, "h long, key long" + ("" if wanted is None else ", n int, pos int"))


def _room(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether the prefixes' overlap and all of what comes after the prefixes reach the threshold."""
    rest = lambda n: n - F.floor((100 - percent) * n / 100).cast("int") - 1
    most = F.least(overlap + F.greatest(rest(na), rest(nb)), na, nb)
    return (100 + percent) * most >= percent * (na + nb)


def _plausible(pairs: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """The first fragment: pairs (a, b) whose prefixes share enough; prefix: key, n, hs."""
    side = lambda c: prefix.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("hs").alias(f"h{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.where(_room(F.size(F.array_intersect("ha", "hb")), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _fragments(docs: DataFrame, rows: DataFrame, keys: DataFrame, n: int, levels: np.ndarray) -> DataFrame:
    """key, n, part, h (array) of some classes, from the text of one document of each; stored."""
    cuts = pivots(levels)

    def run(batches):
        for b in _shards(batches, 1):
            s, wanted = Shingles(b.column(1), n), b.column(0).to_numpy()
            own = np.flatnonzero(wanted == s.keys())  # else another text with the same hash
            once = np.zeros(len(wanted), bool)
            once[own[np.unique(wanted[own], return_index=True)[1]]] = True
            part = np.searchsorted(cuts, levels[s.slots()], "right")
            order = np.argsort(s.doc * PARTS + part, kind="stable")
            cell = (s.doc * PARTS + part)[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            doc = cell[first] // PARTS
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(cell)]]).astype(np.int32)), pa.array(s.hash[order].view(np.int64)))
            out = pa.RecordBatch.from_arrays([pa.array(wanted[doc]), pa.array(s.size[doc].astype(np.int32)), pa.array((cell[first] % PARTS).astype(np.int32)), lists], names=["key", "n", "part", "h"])
            yield out.filter(pa.array(once[doc]))

    one = rows.join(keys.hint("merge"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("s"))
    one = one.select(F.col("key"), F.col("s.doc_id").alias("id"), F.col("s.text_hash").alias("hash"))
    one = stored(one, "texts")
    seen = bit_filter(one.select("hash"))

    def choose(batches):
        for b in batches:
            yield b.filter(pa.array(passes(seen, b.column(1).to_numpy())))

    some = docs.mapInArrow(choose, "doc_id long, text_hash long, text string")
    texts = some.join(one.hint("merge"), (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "text")
    parts = stored(texts.mapInArrow(run, "key long, n int, part int, h array<long>"), "fragments")
    discard(one)
    return parts


def _linked(docs: DataFrame, rows: DataFrame, pairs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """The pairs (a, b) that reach the threshold: partial overlaps by fragment, summed per pair."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    parts = _fragments(docs, rows, keys, n, levels)
    side = lambda c: parts.select(F.col("key").alias(c), "part", F.col("n").alias(f"n{c}"), F.col("h").alias(f"h{c}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), ["a", "part"])
    partial = both.select("a", "b", "part", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("o"))
    # A fragment that came twice, from equal rows, counts once.
    partial = partial.groupBy("a", "b", "part").agg(F.max("o").alias("o"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    summed = partial.groupBy("a", "b").agg(F.sum("o").alias("o"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    links = stored(summed.where((100 + percent) * F.col("o") >= percent * (F.col("na") + F.col("nb"))).select("a", "b"), "overlaps")
    discard(parts)
    return links


def _across(shared: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(pairs (a, b) of different components with a common n-gram after which enough of both sets is left; tables that they are read from).

    In each n-gram's group the rows of the largest component are met by the others only, not by each other. The rows
    of a large group are dealt out by a salt, and those that meet them are sent to each part.
    """
    own = shared.join(labels.select(F.col("node").alias("key"), "label").hint("merge"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    own = stored(own, "members")
    per = own.groupBy("h", "label").agg(F.count("*").alias("m")).groupBy("h").agg(F.max_by("label", F.struct("m", "label")).alias("major"), F.count("*").alias("labels"), F.sum("m").alias("rows"))
    per = stored(per.where("labels > 1").select("h", "major", F.ceil(F.col("rows") / GROUP_ROWS).cast("int").alias("salts")), "open")
    rows = own.join(per.hint("merge"), "h")
    x = rows.where("label <> major").select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("key").alias("kx"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    y = rows.select("h", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.col("key").alias("ky"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("pos").alias("py"), "major")
    left = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    enough = (100 + percent) * left >= percent * (F.col("nx") + F.col("ny"))
    meet = (F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("major")) | (F.col("kx") < F.col("ky"))) & enough
    pairs = x.join(y.hint("merge"), ["h", "salt"]).where(meet).select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"))
    return pairs.distinct(), [own, per]


def classes(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, key of each row; links between keys)."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = stored(_sets(docs, n), "sets")
    levels = gram_levels(docs, n)
    common = _prefixes(docs, n, percent, levels).groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    common = stored(common.where("lo <> hi").select("h"), "common")
    prefix = _prefixes(docs, n, percent, levels, bit_filter(common))
    shared = stored(prefix.distinct().join(common.hint("merge"), "h"), "shared")
    discard(common)
    first = stored(shared.groupBy("key").agg(F.max("n").alias("n"), F.collect_list("h").alias("hs")), "first-fragments")

    def tested(pairs: DataFrame, *done: DataFrame) -> DataFrame:
        some = stored(_plausible(pairs, first, percent), "pairs")
        for table in done:
            discard(table)
        links = _linked(docs, rows, some, n, percent, levels)
        discard(some)
        return links

    # Each class against one leader: of the classes that have an n-gram earliest, the one that it shares most with.
    leaders = shared.groupBy("h").agg(F.min(F.struct("pos", "key")).alias("s")).select("h", F.col("s.key").alias("leader"))
    star = shared.join(leaders.hint("merge"), "h").where("key <> leader").groupBy("key", "leader").agg(F.count("*").alias("m"))
    star = star.groupBy("key").agg(F.max_by("leader", F.struct("m", "leader")).alias("leader")).select(F.col("leader").alias("a"), F.col("key").alias("b"))
    links = tested(star)
    pairs, members = _across(shared, components(links), percent)
    more = tested(pairs, shared, first, *members)
    return rows, links.union(more)


def labelled(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, label (of the component; null without n-grams) of each row."""
    rows, links = classes(docs, n, percent)
    labels = components(links).select(F.col("node").alias("key"), "label")
    return rows.join(labels, "key", "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "key")).alias("label"))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows = labelled(docs, n, percent)
    smallest = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("m"))
    # Documents alone are their own component; the others are few beside them.
    smallest = smallest.where("m > 1").select("label", "smallest")
    return rows.join(smallest, "label", "left").select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), 4, 85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, that with the smallest doc_id; near duplicates by five words and 0.8.

    Of repeated rows (one doc_id and one text) one stays; a row without a doc_id stays only where no row of its
    component has one; all texts without words stay.
    """
    rows = stored(labelled(docs, 5, 80), "labelled")
    chosen = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("s")).select("s.doc_id", "s.text_hash")
    # Nearly always a row is told by its doc_id and text; only for the others are rows themselves compared.
    times = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("m"), F.max("n_shingles").alias("n"))
    kept = times.join(chosen.withColumn("chosen", F.lit(True)).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left").where("chosen or n = 0")
    kept = stored(kept.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), ((F.col("m") > 1) & (F.col("n") > 0)).alias("__repeated")), "kept")
    hashed = docs.withColumn("__text", F.xxhash64(F.col("text").cast("string")))
    same = lambda k: hashed["doc_id"].cast("long").eqNullSafe(k["__id"]) & (hashed["__text"] == k["__hash"])
    once, repeated = kept.where("not __repeated"), kept.where("__repeated")
    out = hashed.join(once, same(once), "left_semi")
    if not repeated.isEmpty():
        out = out.unionByName(hashed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "__text"]))
    return out.drop("__text")
