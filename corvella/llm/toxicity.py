"""Toxicity: a lexicon learned from labels, met through Levenshtein automata, and scored in context.

The lexicon holds whole words and stems (beginnings shared by many words) that almost only toxic documents
use. It is a trie; a word of the text is turned into a Levenshtein automaton, and walking both together
finds the entries within the allowed distance. Each hit is judged in a window of words around it: hits close
together count more, and hits inside quotation marks are kept apart, so that quotation differs from abuse.
A logistic regression over these few numbers gives the score.

Double quotation marks, typographic ones too, are paired within a paragraph (up to a blank line): a mark opens where
no letter or digit stands before it and no space after it, and closes the other way round. A mark without its
partner quotes nothing. Single marks are not told from apostrophes and do not count.

Only documents with crc32(doc_id as text) mod 3 other than 1 teach. At most SAMPLE_ROWS labelled documents
are used for the fit, chosen by a hash of doc_id; that is its documented bound, and it bounds the lexicon, which holds
all words of three letters or more, and all beginnings of four to seven letters, that pass its tests. Words of any length
are matched. Letters are lower-cased by Spark, for all uses alike.

Rows: null and empty texts have no hits and get the score of a text without hits; equal texts get equal
scores; a doc_id with several labels is toxic if one says so; without labels, or without toxic ones, every score is the prior
(0 with no labels).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, kept_by_worker, table
from .wordhash import ALNUM, NON_SPACE, Words, pieces, text_buffer

SAMPLE_ROWS = 20_000
WINDOW = 8
BLANK_LINE = re.compile(rb"\n[ \t\r]*\n")
#: Marks and spaces beyond ASCII that are no part of a word; what joins letters (apostrophes, joiners) stays.
PUNCTUATION = "[\u00a0\u00a1\u00a7\u00b6\u00b7\u00bf\u1680\u2000-\u200a\u2010-\u2017\u2020-\u202f\u2030-\u205f\u3000-\u3003\u3008-\u3011\u3014-\u301f\uff01\uff0c\uff0e\uff1a\uff1b\uff1f]"
# Typographic marks and what they are read as: guillemets with a space inside them, marks that only open or close, others.
MARKS = (("(^|[\\s(])\u00ab ", '\\1"'), (" \u00bb([\\s,.;:!?)]|$)", '"\\1'), ("[\u300c\u300e]", ' "'), ("[\u300d\u300f]", '" '), ("[\u201c\u201d\u201e\u201f\u00ab\u00bb]", '"'), (PUNCTUATION, " "))
N_FEATURES = 7
BLANK = ~NON_SPACE


class LevenshteinAutomaton:
    """Accepts the strings within distance k of a word; a state is a tuple of (letters used, errors)."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple:
        return self._closed({0: 0})

    def _closed(self, state: dict[int, int]) -> tuple:
        """Adds what letters left out of the word can reach."""
        for i in sorted(state):
            e = state[i]
            while e < self.k and i < len(self.word):
                i, e = i + 1, e + 1
                if state.get(i, self.k + 1) <= e:
                    break
                state[i] = e
        return tuple(sorted(state.items()))

    def step(self, state: tuple, letter: str) -> tuple:
        new: dict[int, int] = {}
        for i, e in state:
            if i < len(self.word) and self.word[i] == letter:
                new[i + 1] = min(new.get(i + 1, e), e)
            elif e < self.k and i < len(self.word):
                new[i + 1] = min(new.get(i + 1, e + 1), e + 1)
            if e < self.k:
                new[i] = min(new.get(i, e + 1), e + 1)
        return self._closed(new) if new else ()

    def errors(self, state: tuple) -> int | None:
        """Errors with which the whole word is used, if that is within k."""
        found = [e + len(self.word) - i for i, e in state if e + len(self.word) - i <= self.k]
        return min(found, default=None)

    def prefix_errors(self, state: tuple) -> int | None:
        """Errors with which some beginning of the word is used."""
        return min((e for _, e in state), default=None)


class Lexicon:
    """Words and stems in one trie, with a quick test that lets almost all other words pass by."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = sorted(words), sorted(stems)
        self.trie: dict = {}
        for kind, entries in (("word", self.words), ("stem", self.stems)):
            for entry in entries:
                node = self.trie
                for letter in entry:
                    node = node.setdefault(letter, {})
                node[kind] = entry
        # One error leaves one half of an entry whole: the first at the start, the second at most one place off.
        halves = [(w[: len(w) // 2], w[len(w) // 2 :]) for w in [*self.words, *self.stems]]
        self.first = {n: {a for a, _ in halves if len(a) == n} for n in {len(a) for a, _ in halves}}
        self.second: dict[tuple[int, int], set[str]] = {}
        for a, b in halves:
            for shift in (-1, 0, 1):
                self.second.setdefault((len(a) + shift, len(b)), set()).add(b)

    @staticmethod
    def allowed(entry: str) -> int:
        return 1 if len(entry) >= 5 else 0

    def match(self, word: str) -> tuple[int, int] | None:
        """(kind, errors) of the best entry: kind 0 a whole word, 1 a stem; None for no entry."""
        if len(word) < 3 or not (any(word[:n] in s for n, s in self.first.items()) or any(word[p : p + n] in s for (p, n), s in self.second.items())):
            return None
        automaton = LevenshteinAutomaton(word, 1)
        best, todo = None, [(self.trie, automaton.start())]
        while todo:
            node, state = todo.pop()
            for letter, below in node.items():
                if letter == "word":
                    e = automaton.errors(state)
                    if e is not None and e <= self.allowed(below):
                        best = min(best or (9, 9), (0, e), key=lambda x: (x[1], x[0]))
                elif letter == "stem":
                    e = automaton.prefix_errors(state)
                    if e is not None and e <= self.allowed(below):
                        best = min(best or (9, 9), (1, e), key=lambda x: (x[1], x[0]))
                elif len(letter) == 1 and (new := automaton.step(state, letter)):
                    todo.append((below, new))
        return best


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float] = field(default_factory=lambda: [0.0] * (N_FEATURES + 1))
    prior: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not any(self.weights):
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


def known(lexicon: Lexicon) -> dict[int, int]:
    """This worker's cache of what words are, by hash: 0 none, else 1 + 2 * kind + errors."""
    return kept_by_worker(dict, "toxicity", tuple(lexicon.words), tuple(lexicon.stems))


def hits(lexicon: Lexicon, words: Words) -> np.ndarray:
    """For each word of a shard: 0 none, 1 a word, 2 a misspelt word, 3 a stem, 4 a misspelt stem."""
    unique, back = np.unique(words.hash, return_inverse=True)
    at = np.zeros(len(unique), np.int64)
    at[back[::-1]] = np.arange(len(back))[::-1]
    cache = known(lexicon)
    if len(cache) > 400_000:
        cache.clear()
    kinds = np.zeros(len(unique), np.int8)
    start, end, data = words.start[at].tolist(), words.end[at].tolist(), words.data.tobytes()
    for k, h in enumerate(unique.tolist()):
        got = cache.get(h)
        if got is None:
            found = lexicon.match(data[start[k] : end[k]].decode("utf-8", "replace"))
            got = cache[h] = 0 if found is None else 1 + 2 * found[0] + found[1]
        kinds[k] = got
    return kinds[back] if len(back) else np.zeros(0, np.int8)


def quotations(text: bytes) -> list[tuple[int, int]]:
    """Places of the marks of each quotation."""
    out, opened, line = [], None, 0
    breaks = [m.start() for m in BLANK_LINE.finditer(text)] if b'"' in text else []
    at = text.find(b'"')
    while at >= 0:
        while line < len(breaks) and breaks[line] < at:
            opened, line = None, line + 1
        before, after = text[at - 1] if at else 32, text[at + 1] if at + 1 < len(text) else 32
        if opened is not None and not BLANK[before] and not ALNUM[after]:
            out.append((opened, at))
            opened = None
        elif not ALNUM[before] and not BLANK[after]:
            opened = at
        at = text.find(b'"', at + 1)
    return out


def _quoted(words: Words, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of some words, in order, is inside a quotation of its text."""
    quoted = np.zeros(len(at), bool)
    doc = words.doc[at]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(doc) != 0, [True]])).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        begin, end = offsets[doc[a]], offsets[doc[a] + 1]
        found = quotations(words.data[begin:end].tobytes())
        if found:
            opens, closes = np.array(found).T
            place = words.start[at[a:b]] - begin
            k = np.searchsorted(opens, place) - 1
            quoted[a:b] = (k >= 0) & (place < closes[k.clip(0)])
    return quoted


def numbers(lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    """The numbers that the score is made of, a row a text."""
    for pattern, mark in MARKS:
        column = pc.replace_substring_regex(column, pattern, mark)
    words = Words(column, ALNUM)
    kind = hits(lexicon, words)
    rows = len(words.count)
    x = np.zeros((rows, N_FEATURES))
    at = np.flatnonzero(kind)
    if not len(at):
        return x
    doc = words.doc[at]
    quoted = _quoted(words, text_buffer(column)[1], at)
    plain = ~quoted
    # Hits within the window of each hit, itself included.
    spread = words.doc[at] * (1 << 40) + (at - words.first[doc])
    near = np.searchsorted(spread, spread + WINDOW, "right") - np.searchsorted(spread, spread - WINDOW, "left")
    count = lambda mask: np.log1p(np.bincount(doc[mask], minlength=rows))
    x[:, 0] = count(plain & (kind[at] == 1))
    x[:, 1] = count(plain & (kind[at] == 2))
    x[:, 2] = count(plain & (kind[at] == 3))
    x[:, 3] = count(plain & (kind[at] == 4))
    x[:, 4] = count(quoted)
    np.maximum.at(x[:, 5], doc[plain], np.log(near[plain]))
    x[:, 6] = np.log1p(np.bincount(doc[plain], minlength=rows) / np.maximum(words.count, 1) * 20)
    return x


def _lower(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text"))


def learn_lexicon(texts: DataFrame, n_toxic: int, purity: float = 0.9) -> Lexicon:
    """texts: doc_id, text (lower case), toxic. Entries that at least a few toxic documents and hardly others have."""
    least = max(4, n_toxic // 60)
    text = F.col("text")
    for pattern, mark in MARKS:
        text = F.regexp_replace(text, pattern, mark.replace("\\1", "$1"))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    seen = texts.select("toxic", F.explode(words).alias("w")).where("length(w) >= 3").groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    seen = seen.cache()
    whole = seen.where((F.col("t") >= least) & (F.col("t") >= purity * F.col("n"))).select("w").collect()
    begins = seen.select("t", "n", F.explode(F.transform(F.sequence(F.lit(4), F.lit(7)), lambda k: F.when(F.length("w") > k, F.substring("w", F.lit(1), k)))).alias("s")).where("s is not null")
    begins = begins.groupBy("s").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count_if(F.col("t") > 0).alias("kinds"), F.max("t").alias("most"))
    begins = begins.where((F.col("t") >= 2 * least) & (F.col("t") >= purity * F.col("n")) & (F.col("kinds") >= 8) & (F.col("most") * 2 < F.col("t"))).select("s").collect()
    seen.unpersist()
    stems: list[str] = []
    for s in sorted((r.s for r in begins), key=lambda s: (len(s), s)):
        if not any(s.startswith(x) for x in stems):
            stems.append(s)
    return Lexicon([r.w for r in whole if not any(r.w.startswith(s) for s in stems)], stems)


def fit_weights(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> list[float]:
    """Logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-9] + [l2] * (x.shape[1] - 1))
        step = np.linalg.solve(h + 1e-9 * np.eye(len(h)), x.T @ (p - y) + l2 * np.r_[0, w[1:]])
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(crc32_mod(F.col("doc_id"), 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = _lower(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).join(F.broadcast(marks), "doc_id")
    n, n_toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not n_toxic:
        return Model(Lexicon([], []))
    lexicon = learn_lexicon(texts, n_toxic)

    def run(batches):
        for b in pieces(batches, 1):
            x = numbers(lexicon, b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(2).cast(pa.int32())], names=["x", "toxic"])

    rows = texts.select("doc_id", "text", "toxic").mapInArrow(run, "x array<double>, toxic int").toPandas()
    x, y = np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES), rows["toxic"].to_numpy(float)
    model = Model(lexicon, prior=float(y.mean()))
    if 0 < y.sum() < len(y) and x.any():
        # More hits never speak against toxicity: numbers that would get a negative weight are left out.
        use = np.ones(N_FEATURES, bool)
        while True:
            w = fit_weights(x[:, use], y)
            negative = np.array(w[1:]) < 0
            if not negative.any():
                break
            use[np.flatnonzero(use)[negative]] = False
        weights = np.zeros(N_FEATURES)
        weights[use] = w[1:]
        model.weights = [w[0], *weights.tolist()]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        for b in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(numbers(model.lexicon, b.column(1))))], names=["doc_id", "score"])

    return _lower(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(run, "doc_id long, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose own text is predicted toxic; other columns stay as they are."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    names, at = docs.columns, len(docs.columns)

    def run(batches):
        for b in pieces(batches, at):
            ok = model.scores(numbers(model.lexicon, b.column(at))) < 0.7
            yield pa.RecordBatch.from_arrays(b.columns[:at], names=names).filter(pa.array(ok))

    return docs.select("*", F.lower(F.col("text").cast("string")).alias("__lower")).mapInArrow(run, docs.schema)
