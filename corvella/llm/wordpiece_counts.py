"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that go on.
Each node has a failure link and the number of pieces that following it pops, both computed beforehand; a
word is then read once, byte by byte, and the sum of the popped counts is the length of its greedy
longest-match tokenization. No piece is built and no byte is read twice.

Words are the runs of non-space bytes. A word that the pieces cannot cover counts as one unknown token.
Rows: null and empty texts have no tokens; a null key is kept.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, kept_by_worker


class LongestMatch:
    def __init__(self, first: Iterable[bytes], more: Iterable[bytes], cache: int = 500_000):
        self.next: list[dict[int, int]] = [{}, {}]
        self.ends = [False, False]
        for root, pieces in ((0, first), (1, more)):
            for piece in pieces:
                if piece:
                    self._add(root, piece)
        self._link()
        self.words = Memo(lambda w: self.count(w.encode("utf-8", "surrogatepass")), cache)

    def _add(self, root: int, piece: bytes) -> None:
        node = root
        for b in piece:
            if b not in self.next[node]:
                self.next[node][b] = len(self.next)
                self.next.append({})
                self.ends.append(False)
            node = self.next[node][b]
        self.ends[node] = True

    def _link(self) -> None:
        """fail[v], pops[v]: where v goes when the next byte does not fit, and how many pieces end on the way; -1: nowhere."""
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque([(0, c, b) for b, c in self.next[0].items()] + [(1, c, b) for b, c in self.next[1].items()])
        while queue:
            parent, node, byte = queue.popleft()
            if self.ends[node]:
                self.fail[node], self.pops[node] = 1, 1
            else:
                z, popped = self.fail[parent], self.pops[parent]
                while z != -1 and byte not in self.next[z]:
                    popped, z = popped + self.pops[z], self.fail[z]
                if z != -1:
                    self.fail[node], self.pops[node] = self.next[z][byte], popped
            queue += [(node, c, b) for b, c in self.next[node].items()]

    def count(self, word: bytes) -> int:
        """Number of pieces of the greedy tokenization; 1 for a word that the pieces cannot cover, 0 for none."""
        if not word:
            return 0
        node, total, step, fail, pops = 0, 0, self.next, self.fail, self.pops
        for b in word:
            while b not in step[node]:
                if fail[node] == -1:
                    return 1
                total, node = total + pops[node], fail[node]
            node = step[node][b]
        while node != 1:
            if fail[node] == -1:
                return 1
            total, node = total + pops[node], fail[node]
        return total

    def text(self, text: str) -> tuple[int, int]:
        """(pieces, words) of a text."""
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        words = text.split(" ")
        return sum(map(self.words.__getitem__, words)), len(words) - words.count("")


def pieces_of(path: str) -> tuple[set[bytes], set[bytes]]:
    """Word-initial and continuing pieces of a byte-level vocabulary file, whose mark for a space begins a word."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    first, more = set(), set()
    for piece in vocabulary:
        if all(c in byte_of for c in piece):
            raw = bytes(byte_of[c] for c in piece)
            (first if raw[:1] == b" " and len(raw) > 1 else more).add(raw.lstrip(b" "))
    first |= {bytes([b]) for b in range(256)}
    more |= {bytes([b]) for b in range(256)}
    return first - {b""}, more - {b""}


def automaton(path: str) -> LongestMatch:
    """One for each worker process, so that its cache lasts from task to task."""
    return kept_by_worker(lambda: LongestMatch(*pieces_of(path)), "longest-match", path)


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_tokens (pieces of the greedy tokenization) and n_words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                texts = [t or "" for t in some.column(1).to_pylist()]
                pieces, words = zip(*map(auto.text, texts), strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pieces, pa.int64()), pa.array(words, pa.int64())], names=[key, "n_tokens", "n_words"])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_words long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
