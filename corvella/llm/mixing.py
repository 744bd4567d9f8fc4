"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a run of tokens: its words and one end. A token is coded in bits: whether it is new (no training text has
it), then, for one that is not, the CODE bits of its hash, from the top, and last its share among the words with these
bits. Three predictors give the log odds of each bit: from counts of all tokens (the bits so far alone), after the
class of the word before (one of CLASSES, by hash), and after the word before itself; the last two in hashed
tables. A new word is spelled: its bytes and a closing space, high bit first, by three predictors with the last one,
two and three bytes of the word as contexts. All training occurrences are counted; what spelling and newness are
learned from are the words that occur once in all training texts, which are what a new word is when left out.

The predictors' log odds are combined by weights that a gate selects (bit, and how sure the contexts are). The weights
are refined online, in rounds over training texts that no earlier round has seen (ROUNDS, by a hash of the text; together
they are all training texts): each occurrence is predicted by the weights so far, without its own count, and what all tasks gather moves the weights by one
damped Newton step for each gate. So there is one model, whatever the files and partitions. A document adapts to its own
text: words that it has used before get more likely, by as much as has paid in this document. Every step multiplies or
mixes probabilities, so that the score is the log10 of one probability of the text, and with the text's bytes it gives
total bits per byte.

Exact counts of words travel by block and range of hashes, and grow with the corpus. Tables of bits have as many slots
as the training bytes ask for, up to a ceiling (MOST; beyond it contexts collide more), and are summed by ranges of
slots; nothing that grows passes the driver. Blocks are cut where the input's partitions put their rows; neither counts
nor weights depend on them but for the last bits of sums. Words are identified by 64-bit hashes.

Rows: a null or empty text is the end token alone; equal texts get equal scores within a model, up to the last bits of a
sum; a null doc_id is kept and hashed as the empty text; with no training rows the scores come from the
untrained model. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, discard, lower_ascii, stored, table
from .wordhash import NON_SPACE, Words, hash_words, mix, pieces, scramble

CODE, CLASSES, DEPTH = 16, 512, 17  # bits of a code; classes of words before; bits of a token: new or not, and the code
LEAST, MOST = (14, 14, 16, 16, 14), (21, 21, 20, 18, 16)  # binary logarithms of the slots: class, word, three, two, one bytes
CHUNKS = 64
BLOCK_BYTES = 1 << 22
RUN = 2048
#: Sixteenths of the training texts, by hash, that each round learns from; damping of its step, in squared log odds.
ROUNDS, DAMPING = ((0,), (1,), tuple(range(2, 16))), 4.0
CACHES = (0.0, 0.08, 0.3, 0.6)  # shares that a document may give to the words it has used
LN10 = np.log(10)
END, START = np.uint64(1), np.uint64(0)  # hashes of the end of a text and of what stands before it
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def unpacked(data: bytes) -> memoryview:
    import zstandard

    return memoryview(zstandard.ZstdDecompressor().decompress(data))


def starts_for(n_bytes: int) -> np.ndarray:
    """Where each hashed predictor's slots start, for so many bytes of training text."""
    return np.cumsum([0, *(1 << min(max(int(2 * n_bytes).bit_length(), a), b) for a, b in zip(LEAST, MOST, strict=True))])


def codes(hashes: np.ndarray) -> np.ndarray:
    return (scramble(hashes) >> np.uint64(64 - CODE)).astype(np.int64)


def _lines(context: np.ndarray, k: int, starts: np.ndarray) -> np.ndarray:
    """First slot of the sixteen that a context has in table k."""
    right = np.uint64(64 - int(starts[k + 1] - starts[k]).bit_length() + 5)
    return ((scramble(context + np.uint64((k + 1) * int(_GOLD) & (1 << 64) - 1)) >> right).astype(np.int64) * 16 + starts[k]).astype(np.int32)


class TokenBits:
    """The bits of some tokens after the words before them; a row a token, a column a bit."""

    def __init__(self, code: np.ndarray, before: np.ndarray, new: np.ndarray, starts: np.ndarray):
        """before: hash of the word before; new: whether each token is coded as new."""
        code = code.astype(np.int32)
        shift = np.arange(CODE - 1, -1, -1, dtype=np.int32)
        above = ((1 << CODE) | code)[:, None] >> (shift + np.int32(1))  # 1 and the bits before each
        self.bit = np.empty((len(code), DEPTH), np.int8)
        self.bit[:, 0] = new
        self.bit[:, 1:] = (code[:, None] >> shift) & 1
        # The tree of all tokens: 0 for new or not, else 1 with the bits so far.
        self.tree = np.empty((len(code), DEPTH), np.int32)
        self.tree[:, 0] = 0
        self.tree[:, 1:] = above
        self.slots = []
        nibbles = np.arange(CODE // 4, dtype=np.int32)
        so_far = (code[:, None] >> (CODE - 4 * nibbles)).astype(np.uint64) | ((nibbles + 1).astype(np.uint64) << np.uint64(32))
        within = (16 | (code[:, None] >> (CODE - 4 - 4 * nibbles)) & 15)[:, :, None] >> (4 - np.arange(4, dtype=np.int32))
        for k, context in enumerate((mix(before * _GOLD) % np.uint64(CLASSES), before)):
            lines = _lines(mix((context * _GOLD)[:, None] + so_far), k, starts)
            s = np.empty((len(code), DEPTH), np.int32)
            s[:, 0] = lines[:, 0]
            s[:, 1:] = (lines[:, :, None] + within).reshape(len(code), CODE)
            self.slots.append(s)
        self.use = np.ones((len(code), DEPTH), bool)
        self.use[new, 1:] = False

    def gates(self, x: list[np.ndarray]) -> np.ndarray:
        """Place of the bit, and how sure the two hashed predictors are."""
        sure = lambda a: (a != 0).astype(np.int16) + (np.abs(a) > 2.5)
        return (np.arange(DEPTH, dtype=np.int16) * 9 + sure(x[1]) * 3 + sure(x[2])).astype(np.int16)


class SpellingBits:
    """The bits of some new words, with the slots that each predictor looks at; a row a byte, a column a bit."""

    def __init__(self, data: np.ndarray, length: np.ndarray, starts: np.ndarray):
        size = length + 4
        first = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.uint64)  # the byte + 1, after three zeros
        self.first = np.cumsum(length + 1) - length - 1
        use = np.arange(int((length + 1).sum())) + np.repeat(3 * (np.arange(len(length)) + 1), length + 1)
        own = np.ones(len(use), bool)
        own[self.first + length] = False
        flat[use[own]] = data.astype(np.uint64) + np.uint64(1)
        flat[use[~own]] = 33
        last, second, third = flat[use - 1], flat[use - 2], flat[use - 3]
        byte = (flat[use] - np.uint64(1)).astype(np.int64)
        self.bit = ((byte[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int8)
        self.slots = []
        for k, context in ((4, last), (3, last * np.uint64(257) + second), (2, (last * np.uint64(257) + second) * np.uint64(257) + third)):
            s = np.empty((len(byte), 8), np.int32)
            for half in (0, 1):
                so_far = (byte >> 4).astype(np.uint64) + np.uint64(1) if half else np.uint64(0)
                s[:, 4 * half : 4 * half + 4] = _lines(mix(context * _GOLD + so_far), k, starts)[:, None] + ((16 | (byte >> (4 - 4 * half)) & 15)[:, None] >> (4 - np.arange(4)))
            self.slots.append(s)
        place = np.arange(len(byte)) - np.repeat(self.first, length + 1)
        self.gate = (np.minimum(place, 3)[:, None] * 8 + np.arange(8)).astype(np.int16)
        self.use = np.ones(self.bit.shape, bool)

    def gates(self, x: list[np.ndarray]) -> np.ndarray:
        return self.gate + (x[2] != 0) * np.int16(32)


class Mixer:
    """Weights for each gate: judge uses them, gather and step refine them."""

    def __init__(self, n_gates: int, initial: tuple[float, ...], weights: np.ndarray | None = None):
        self.weights = np.tile(np.array(initial, np.float32), (n_gates, 1)) if weights is None else weights
        n = self.weights.shape[1]
        #: For each gate the sums of the errors with each input, and of the inputs' products; of one task.
        self.sums = np.zeros((n + n * (n + 1) // 2, n_gates))

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = x[0] * self.weights[:, 0].take(gate)
        for o in range(1, len(x)):
            z += x[o] * self.weights[:, o].take(gate)
        return np.clip(z, -11, 11, out=z)

    def judge(self, x: list[np.ndarray], bits: TokenBits | SpellingBits) -> np.ndarray:
        """Natural logarithm of each row's bits."""
        z = self.mixed(x, bits.gates(x))
        z *= 1 - 2 * bits.bit
        return -(np.log1p(np.exp(z, out=z), out=z) * bits.use).sum(1, dtype=float)

    def gather(self, x: list[np.ndarray], bits: TokenBits | SpellingBits, often: np.ndarray) -> None:
        """Adds what the bits of some rows, which occur so often, say about the weights."""
        gate, size = bits.gates(x), len(self.weights)
        times = (bits.use * often[:, None]).reshape(-1)
        p = (1 / (1 + np.exp(-self.mixed(x, gate)))).reshape(-1)
        flat, x = gate.reshape(-1).astype(np.intp), [a.reshape(-1) for a in x]
        error, spread = times * (bits.bit.reshape(-1) - p), times * p * (1 - p)
        products = [spread * x[o] * x[q] for o in range(len(x)) for q in range(o + 1)]
        for k, column in enumerate([*(error * a for a in x), *products]):
            self.sums[k] += np.bincount(flat, column, minlength=size)

    def step(self, sums: np.ndarray) -> None:
        """One damped Newton step for each gate, from the sums of all tasks."""
        n = self.weights.shape[1]
        curve = np.empty((len(self.weights), n, n))
        for k, (o, q) in enumerate((o, q) for o in range(n) for q in range(o + 1)):
            curve[:, o, q] = curve[:, q, o] = sums[n + k]
        moves = np.linalg.solve(curve + DAMPING * np.eye(n), sums[:n].T[:, :, None])[:, :, 0]
        # Rounded, so that the order in which sums were made does not show.
        self.weights = np.round(np.clip(self.weights + moves, -2, 4), 4).astype(np.float32)


def token_mixer(weights: np.ndarray | None = None) -> Mixer:
    return Mixer(DEPTH * 9, (0.8, 0.15, 0.25), weights=weights)


def spelling_mixer(weights: np.ndarray | None = None) -> Mixer:
    return Mixer(64, (0.25, 0.35, 0.4), weights=weights)


# Added to the counts of hashed tables, and of the tree, in which no word that is not new takes a way without counts.
HASHED, TREE = np.float32(0.2), np.float32(0.01)


def log_odds(counts: np.ndarray, more: np.float32 = HASHED) -> np.ndarray:
    return np.log(counts[..., 1] + more) - np.log(counts[..., 0] + more)


def odds_without(counts: np.ndarray, more: np.float32 = HASHED) -> np.ndarray:
    """Log odds at each place less one occurrence of a zero, and of a one, in turn: what a bit meets that is left out itself."""
    out = np.empty((len(counts), 2), np.float32)
    for bit in (0, 1):
        zeros, ones = (np.maximum(counts[:, b] - np.float32(b == bit), 0) + more for b in (0, 1))
        np.log(ones / zeros, out=out[:, bit])
    return out.reshape(-1)


def tree_of(leaves: np.ndarray, once: int) -> np.ndarray:
    """Counts of zeros and ones at each place of the tree of codes; place 0 is for new or not."""
    out = np.zeros((1 << CODE, 2), np.float32)
    level, at = leaves.astype(np.float64), CODE
    while at:
        at -= 1
        out[1 << at : 2 << at] = level.reshape(-1, 2)
        level = level.reshape(-1, 2).sum(1)
    out[0] = leaves.sum() - once, once
    return out


class Block:
    """A block's words, tokens, and distinct pairs of tokens and the words before them."""

    def __init__(self, row: dict):
        n = self.n = row["n_words"]
        self.length, self.data = _words(n, row["words"])
        self.start = np.cumsum(self.length) - self.length
        self.tokens = np.frombuffer(unpacked(row["tokens"]), "<u4").astype(np.int64)
        self.sizes = np.array(row["counts"], np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = np.array([bool(t) for t in row["train"]], bool)
        self.shares = np.array(row["shares"], np.int64)
        self.hash = np.concatenate([hash_words(self.data, self.start, self.length), np.array([END, START], np.uint64)])

    def only(self, keep: np.ndarray) -> Block:
        """Without the other documents; their words stay."""
        own = keep[self.doc]
        self.tokens, self.sizes, self.train, self.shares = self.tokens[own], self.sizes[keep], self.train[keep], self.shares[keep]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return self

    def pair(self, count: np.ndarray) -> Block:
        """count: training occurrences of the words and of the end."""
        n = self.n
        self.count = np.concatenate([count, [0]]).astype(np.int64)
        self.at = np.arange(len(self.tokens)) + self.doc  # of the words; the others are the ends of the texts
        sequence = np.full(len(self.tokens) + len(self.sizes), n)
        sequence[self.at] = self.tokens
        before = np.concatenate([[n + 1], sequence[:-1]])
        self.ends = np.cumsum(self.sizes + 1) - 1
        before[self.ends - self.sizes] = n + 1
        pairs, self.back = np.unique(before * (n + 2) + sequence, return_inverse=True)
        self.times = np.bincount(self.back, np.repeat(self.train, self.sizes + 1), minlength=len(pairs)).astype(np.int64)
        self.before, self.word = pairs // (n + 2), pairs % (n + 2)
        self.code = codes(self.hash)
        return self

    def token_runs(self, starts: np.ndarray, use: np.ndarray, new: np.ndarray):
        """Pairs (those at use) in runs: their places and bits; new: which words are coded as new."""
        for i in range(0, len(use), RUN):
            k = use[i : i + RUN]
            yield k, TokenBits(self.code[self.word[k]], self.hash[self.before[k]], new[self.word[k]], starts)

    def spelling_runs(self, starts: np.ndarray, use: np.ndarray):
        """Words (those at use) in runs of about 8 kB."""
        if len(use):
            for k in np.split(use, np.flatnonzero(np.diff(np.cumsum(self.length[use] + 1) >> 13)) + 1):
                length = self.length[k]
                yield k, SpellingBits(self.data[np.repeat(self.start[k] - np.cumsum(length) + length, length) + np.arange(length.sum())], length, starts)


def shares_of(words: Words) -> np.ndarray:
    """A sixteenth for each text, by a hash of its words."""
    place = (np.arange(len(words.hash)) - words.first[words.doc]).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(words.hash + place * _GOLD))])
    return (scramble(sums[words.first[1:]] - sums[words.first[:-1]]) >> np.uint64(60)).astype(np.int8)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of documents: their words as places in a list of the block's distinct words, sorted by hash."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for b in pieces(batches, 1, BLOCK_BYTES):
            w = Words(b.column(1), NON_SPACE)
            hashes, at, index = np.unique(w.hash, return_index=True, return_inverse=True)
            length = (w.end - w.start)[at] if len(at) else np.zeros(0, np.int64)
            data = w.data[np.repeat(w.start[at] - np.cumsum(length) + length, length) + np.arange(length.sum())] if len(at) else w.data[:0]
            n_bytes = np.add.reduceat(np.concatenate([w.end - w.start + 1, [0]]), np.minimum(w.first[:-1], len(w.end))) * (w.count > 0) if b.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([b.column(2).to_pylist()], pa.list_(pa.bool_())), pa.array([w.count.tolist()], pa.list_(pa.int32())), pa.array([shares_of(w).tolist()], pa.list_(pa.int8())), pa.array([list(map(int, n_bytes))], pa.list_(pa.int64())), pa.array([len(hashes)], pa.int64()), pa.array([packed(length.astype("<u4"), data)], pa.binary()), pa.array([packed(index.astype("<u4"))], pa.binary())],
                names=["block", "doc_ids", "train", "counts", "shares", "n_bytes", "n_words", "words", "tokens"],
            )
            number += 1

    return docs.mapInArrow(run, BLOCK)


BLOCK = "block long, doc_ids array<long>, train array<boolean>, counts array<int>, shares array<tinyint>, n_bytes array<long>, n_words long, words binary, tokens binary"
NAMES = [c.split(" ")[0] for c in BLOCK.split(", ")]


def _words(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = unpacked(data)
    return np.frombuffer(raw, "<u4", n).astype(np.int64), np.frombuffer(raw, np.uint8, offset=4 * n)


def counted(blocks: DataFrame, buckets: int) -> tuple[DataFrame, int, int]:
    """The blocks with the training counts of their words (column known); training words; distinct ones.

    Words are asked for by block and range of hashes, and answered in the same places.
    """
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                hashes = block.hash[: block.n]
                counts = np.bincount(block.tokens[block.train[block.doc]], minlength=len(hashes)).astype("<u4")
                cuts = np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64)).tolist()
                out = [(k, row["block"], x, y - x, packed(hashes[x:y], counts[x:y])) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "first", "n", "payload"])

    def judge(batches):
        asked = []
        for b in batches:
            for r in b.to_pylist():
                if asked and r["bucket"] != asked[0]["bucket"]:
                    yield from judge_bucket(asked)
                    asked = []
                asked.append(r)
        if asked:
            yield from judge_bucket(asked)

    def judge_bucket(asked):
        parts = []
        for r in asked:
            raw, n = unpacked(r.pop("payload")), r["n"]
            parts.append((np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, "<u4", n, 8 * n)))
        hashes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(back, np.concatenate([p[1] for p in parts]), minlength=len(hashes))
        empty = (pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()))
        yield pa.RecordBatch.from_arrays([*empty, pa.array([[int(total.sum()), int((total > 0).sum())]], pa.list_(pa.int64()))], names=["block", "first", "known", "sums"])
        i = 0
        for r in asked:
            k = back[i : i + r["n"]]
            i += r["n"]
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["first"]], pa.int64()), pa.array([packed(total[k].astype("<u4"))], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["block", "first", "known", "sums"])

    def gather(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block, first, known, n = (row.column(row.schema.names.index(c))[0].as_py() for c in ("block", "first", "known", "n_words"))
                if known is not None:
                    got.setdefault(block, []).append((first, known))
                    continue
                count = np.zeros(n, "<u4")
                for start, body in got.pop(block, []):
                    part = np.frombuffer(unpacked(body), "<u4")
                    count[start : start + len(part)] = part
                yield pa.RecordBatch.from_arrays([*(row.column(row.schema.names.index(c)) for c in NAMES), pa.array([packed(count)], pa.binary())], names=[*NAMES, "known"])

    sent = blocks.mapInArrow(send, "bucket int, block long, first long, n long, payload binary")
    answers = stored(sent.repartition("bucket").sortWithinPartitions("bucket", "block", "first").mapInArrow(judge, "block long, first long, known binary, sums array<long>"), "word-counts")
    n_words, n_types = answers.where("sums is not null").agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(2)]).first()
    back = answers.where("block is not null").select("block", "first", "known", F.lit(0).alias("kind"))
    rows = blocks.withColumn("kind", F.lit(1)).unionByName(back, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "first")
    out = stored(rows.mapInArrow(gather, f"{BLOCK}, known binary"), "counted")
    discard(answers)
    discard(blocks)
    return out, int(n_words), int(n_types)


def _known(row: dict, n_train: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(unpacked(row["known"]), "<u4").astype(np.int64), [n_train]])


def bit_tables(blocks: DataFrame, starts: np.ndarray, n_train: int) -> tuple[np.ndarray, np.ndarray]:
    """(tree, hashed tables): counts of zeros and ones over all training occurrences, summed by ranges of slots."""
    size = int(starts[-1])

    def count(batches):
        total = None
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                block.pair(_known(row, n_train))
                if total is None:
                    total = np.zeros(2 * size + (1 << CODE) + CHUNKS, np.uint32)
                once = block.count == 1
                use = np.flatnonzero(block.times)
                np.add.at(total, 2 * size + block.code[block.word[use]], block.times[use].astype(np.uint32))
                total[2 * size + (1 << CODE)] += block.times[use][once[block.word[use]]].sum()
                for k, bits in block.token_runs(starts, use, np.zeros(block.n + 2, bool)):
                    bits.bit[:, 0] = once[block.word[k]]
                    often = np.repeat(block.times[k], DEPTH).astype(np.uint32)
                    for s in bits.slots:
                        np.add.at(total, (s.astype(np.int64) * 2 + bits.bit).reshape(-1), often)
                for _, bits in block.spelling_runs(starts, _new_words(block)):
                    for s in bits.slots:
                        np.add.at(total, (s.astype(np.int64) * 2 + bits.bit).reshape(-1), np.uint32(1))
        if total is not None:
            for k, part in enumerate(np.split(total, CHUNKS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(part)], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(unpacked(c), np.uint32).astype(np.float64)
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(part.astype(np.float32))], pa.binary())], names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    total = np.zeros((CHUNKS, (2 * size + (1 << CODE) + CHUNKS) // CHUNKS), np.float32)
    for k, part in blocks.mapInArrow(count, kind).repartition(CHUNKS, "chunk").mapInArrow(add, kind).collect():
        total[k] = np.frombuffer(unpacked(part), np.float32)
    total = total.reshape(-1)
    return tree_of(total[2 * size : 2 * size + (1 << CODE)], float(total[2 * size + (1 << CODE)])), total[: 2 * size].reshape(-1, 2)


def _new_words(block: Block) -> np.ndarray:
    """The words of a block that training texts have once, in this block."""
    use = np.flatnonzero((block.times > 0) & (block.count[block.word] == 1) & (block.word < block.n))
    return block.word[use]


def learn_weights(blocks: DataFrame, starts: np.ndarray, tree: np.ndarray, counts: np.ndarray, n_train: int) -> tuple[np.ndarray, np.ndarray]:
    """Both mixers' weights from all training texts and no others, in rounds over texts that are new to them."""
    held = blocks.sparkSession.sparkContext.broadcast((odds_without(tree, TREE), odds_without(counts)))

    def without(odds: np.ndarray, at: np.ndarray, bits: TokenBits | SpellingBits) -> np.ndarray:
        return odds.take(2 * at + bits.bit)

    def over(shares: tuple[int, ...], weights: tuple[np.ndarray, np.ndarray]):
        def gather(batches):
            tree, counts = held.value
            mixers = token_mixer(weights[0]), spelling_mixer(weights[1])
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row)
                    block.only(block.train & np.isin(block.shares, shares))
                    if not len(block.sizes):
                        continue
                    block.pair(_known(row, n_train))
                    once = block.count == 1
                    for k, bits in block.token_runs(starts, np.flatnonzero(block.times), once):
                        mixers[0].gather([without(tree, bits.tree, bits), *(without(counts, s, bits) for s in bits.slots)], bits, block.times[k].astype(np.float32))
                    for _, bits in block.spelling_runs(starts, _new_words(block)):
                        mixers[1].gather([without(counts, s, bits) for s in bits.slots], bits, np.ones(len(bits.bit), np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([m.sums.reshape(-1) for m in mixers]).tolist()], pa.list_(pa.float64()))], names=["sums"])

        return gather

    mixers = token_mixer(), spelling_mixer()
    for shares in ROUNDS:
        rows = blocks.mapInArrow(over(shares, (mixers[0].weights, mixers[1].weights)), "sums array<double>")
        got = dict(rows.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x")).collect())  # as many numbers as there are weights
        at = 0
        for m in mixers:
            n = m.sums.size
            m.step(np.array([got.get(at + k, 0.0) for k in range(n)]).reshape(m.sums.shape))
            at += n
    held.unpersist()
    return mixers[0].weights, mixers[1].weights


def token_scores(block: Block, starts: np.ndarray, tree: np.ndarray, odds: np.ndarray, leaves: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each pair's token after the word before it."""
    tokens, spelling = token_mixer(weights[0]), spelling_mixer(weights[1])
    new = block.count == 0
    spelled = np.zeros(block.n + 2)
    for k, bits in block.spelling_runs(starts, np.flatnonzero(new[: block.n])):
        spelled[k] = np.add.reduceat(spelling.judge([odds.take(s) for s in bits.slots], bits), bits.first)
    share = np.where(new, spelled, np.log(np.maximum(block.count, 1)) - np.log(np.maximum(leaves[block.code], 1)))
    out = np.zeros(len(block.word))
    for k, bits in block.token_runs(starts, np.arange(len(block.word)), new):
        out[k] = tokens.judge([tree.take(bits.tree), *(odds.take(s) for s in bits.slots)], bits) + share[block.word[k]]
    return out


def document_scores(blocks: DataFrame, starts: np.ndarray, tree: np.ndarray, counts: np.ndarray, weights: tuple[np.ndarray, np.ndarray], n_words: int, n_types: int, n_train: int) -> DataFrame:
    n, v = n_words + n_train, n_types + (n_train > 0)
    held = blocks.sparkSession.sparkContext.broadcast((log_odds(tree, TREE), log_odds(counts), tree[1 << (CODE - 1) :].reshape(-1)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                block.pair(_known(row, n_train))
                tokens, sizes, doc, count = block.tokens, block.sizes, block.doc, block.count
                docs = len(sizes)
                per = lambda x: np.bincount(doc, x, minlength=docs)  # noqa: E731, B023
                base = per((np.log10(count + 1) - np.log10(n + v + 1))[tokens]) + np.log10(n_train + 1) - np.log10(n + v + 1)
                known = per((count > 0)[tokens].astype(float)) + (n_train > 0)
                ln = token_scores(block, starts, held.value[0], held.value[1], held.value[2], weights)
                token, end = ln[block.back[block.at]], ln[block.back[block.ends]]
                # How often the document has had the word before, as a share of its words before.
                order = np.argsort(doc * (block.n + 1) + tokens, kind="stable")
                new = np.concatenate([[True], (np.diff(tokens[order]) != 0) | (np.diff(doc[order]) != 0)]) if len(order) else np.zeros(0, bool)
                run_start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
                before = np.zeros(len(tokens))
                before[order] = np.arange(len(order)) - run_start
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                used = before / np.maximum(place, 1)
                share = np.exp(token)
                options = np.stack([per(token if c == 0 else np.where(place == 0, token, np.log((1 - c) * share + c * used + 1e-300))) + np.where(sizes > 0, np.log(1 - c), 0) for c in CACHES], 1)
                top = options.max(1)
                text = top + np.log(np.exp(options - top[:, None]).sum(1)) - np.log(len(CACHES)) + end
                size = np.array(row["n_bytes"]) + 1
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(~block.train), pa.array(sizes + 1), pa.array(known.astype(np.int64)), pa.array(np.full(docs, n)), pa.array(base), pa.array(text / LN10), pa.array(-text / np.log(2) / size)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return blocks.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def score(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, train (boolean)."""
    spark = docs.sparkSession
    blocks = stored(blocks_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), "train")), "blocks")
    train_bytes = F.aggregate(F.zip_with("train", "n_bytes", lambda t, b: F.when(t, b + 1).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    n_train, n_bytes = blocks.select(F.size(F.filter("train", lambda t: t)).alias("n"), train_bytes.alias("b")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    starts = starts_for(int(n_bytes))
    buckets = 1 << max(8, (int(spark.conf.get("spark.sql.shuffle.partitions")) * 4 - 1).bit_length())
    blocks, n_words, n_types = counted(blocks, buckets)
    tree, counts = bit_tables(blocks, starts, int(n_train))
    weights = learn_weights(blocks, starts, tree, counts, int(n_train))
    return document_scores(blocks, starts, tree, counts, weights, n_words, n_types, int(n_train))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", (crc32_mod(F.col("doc_id"), 7) != 2).alias("train")))
