"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token with which its encoding ends. It is the suffix token
t for which what precedes t is empty or ends with a token p such that BPE of p + t is (p, t). Storing that
last token for each prefix makes appends exact (earlier entries never change) and lets an edit recompute
only from the edited place to where the entries agree again.

Rows: a null text is the empty text: no ids, empty bytes. Repeated rows are encoded each for itself.
Text with lone surrogates cannot occur in Spark strings. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, kept_by_worker, unit_keys, unit_text


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class State:
    """A sequence of bytes with the last token of each of its prefixes; last[i] belongs to the prefix of i + 1 bytes."""

    def __init__(self):
        self.data, self.last = bytearray(), []


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 800_000):
        import regex

        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.max_len = max(map(len, ranks))
        self.backward: dict = {}  # a trie of the reversed tokens; -1: the token that ends here
        for raw, token in ranks.items():
            node = self.backward
            for byte in reversed(raw):
                node = node.setdefault(byte, {})
            node[-1] = token
        self.split = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made_of: dict[int, tuple[int, ...] | None] = {}
        self.pieces = Memo(lambda piece: tuple(self._piece(piece.encode("utf-8", "surrogatepass"))), cache // 2)
        self.units = Memo(lambda key: tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(unit_text(key))))), cache)

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """Plain BPE of a few bytes: merges the leftmost pair of lowest rank while more than least parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, k = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the merge that makes a token; None for a single byte or a token that BPE never makes."""
        if token not in self.made_of:
            parts = self.merge(self.bytes_of[token], 2)
            whole = len(parts) == 2 and self.ranks.get(parts[0] + parts[1]) == token
            self.made_of[token] = tuple(map(self.ranks.__getitem__, parts)) if whole else None
        return self.made_of[token]

    def _keeps(self, left: int, right: int) -> bool:
        """Undoes merges at the border, the latest first; the border holds unless both sides would have merged before."""
        limit = 1 << 60  # the rank at which the tokens now at the border were taken up into larger ones
        while True:
            both = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if both is not None and both < limit:
                return False
            if left > right and (parts := self.halves(left)):
                limit, left = left, parts[1]
            elif parts := self.halves(right):
                limit, right = right + 1, parts[0]  # of equal ranks the left one merges first
            elif parts := self.halves(left):
                limit, left = left, parts[1]
            else:
                return True

    def joins(self, before: int, token: int) -> bool:
        """Whether BPE keeps both tokens when one follows the other."""
        got = self.pairs.get((before, token))
        if got is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            got = self.pairs[before, token] = self.stands(token) and self._keeps(before, token)
        return got

    def stands(self, token: int) -> bool:
        """Whether BPE of the token's bytes is the token itself."""
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def _last(self, data: bytes | bytearray, last: list[int], end: int) -> int:
        """The last token of data[:end], of which all shorter prefixes are known; suffix tokens are met shortest first."""
        node, pairs = self.backward, self.pairs
        for start in range(end - 1, -1, -1):
            node = node.get(data[start])
            if node is None:
                break
            if (token := node.get(-1)) is not None:
                if not start:
                    if self.stands(token):
                        return token
                elif (good := pairs.get((last[start - 1], token))) or (good is None and self.joins(last[start - 1], token)):
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, state: State, more: bytes) -> State:
        """Appends bytes; no entry for an earlier prefix changes."""
        state.data += more
        for end in range(len(state.last) + 1, len(state.data) + 1):
            state.last.append(self._last(state.data, state.last, end))
        return state

    def replace(self, state: State, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; returns how many entries it had to recompute.

        An entry depends on the max_len entries and bytes before it, so after max_len recomputed entries in a
        row that equal the old ones all that follow are equal too.
        """
        old, tail = state.last, len(state.data) - stop
        state.data[start:stop] = new
        state.last = old[:start]
        end, same, done = start, 0, 0
        while end < len(state.data):
            end += 1
            token = self._last(state.data, state.last, end)
            state.last.append(token)
            done += 1
            k = len(old) - (len(state.data) - end) - 1
            same = same + 1 if len(state.data) - end < tail and old[k] == token else 0
            if same >= self.max_len:
                state.last += old[k + 1 :]
                break
        return done

    def tokens(self, state: State) -> list[int]:
        out, end = [], len(state.data)
        while end:
            out.append(state.last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def _piece(self, piece: bytes) -> list[int]:
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        return self.tokens(self.append(State(), piece))

    def encode(self, text: str) -> list[int]:
        keys = unit_keys(text)
        if keys is None:
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))
        return list(chain.from_iterable(map(self.units.__getitem__, keys)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def coder(path: str, pattern: str) -> PrefixBpe:
    return kept_by_worker(lambda: PrefixBpe(load_ranks(path), pattern), "prefix-bpe", path, pattern)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ids array<int>."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = coder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                ids = [enc.encode(t or "") for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: the key and the decoded bytes; null ids decode to nothing."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = coder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([enc.decode(x or ()) for x in some.column(1).to_pylist()], pa.binary())], names=[key, "bytes"])

    kind = dict(df.dtypes)[key]
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, bytes binary")


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes, decodes the ids again, and returns the digests of both in one pass over the rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = coder(path, pattern)
        decimal = {v: str(v) for v in enc.bytes_of}
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                rows = []
                for t in some.column(1).to_pylist():
                    ids = enc.encode(t or "")
                    rows.append((len(ids), hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()))
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(a, pa.int64()), pa.array(b), pa.array(c)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the kept documents' ids."""
    import public_tokenizers

    ids = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))
