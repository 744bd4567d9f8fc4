"""Six ways to cut a text into chunks. Each folds over one text; Spark deals the rows."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions.scalars import ABBREVIATIONS, BOUNDARIES, chunk_id
from .embedding import Embedder, embed_texts

Chunk = tuple[str, int, int]
#: Entities and topics of each of some sentences.
Annotator = Callable[[list[str]], Sequence[tuple[set[str], set[str]]]]
# Characters before which a window of characters may end.
_CUT = set(" \n\t.,!?;:")
_TOKEN = re.compile(r"\w+|[^\w \t\n\x0b\f\r]|[ \t\n\x0b\f\r]+")
_WORD = re.compile(r"\w+")
_BOUNDARY = re.compile("|".join(f"(?:{b})" for b in BOUNDARIES))
# Where the recursive strategy cuts, from the coarsest to the finest.
SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]
_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_ABBREVIATION = re.compile(rf"\b(?:{ABBREVIATIONS})\.\Z")


def character(text: str, size: int = 1200, overlap: int = 300) -> Iterator[Chunk]:
    """Windows cut at the last separator before their end; the next begins overlap characters before it."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            cut = end
            while cut > at and text[cut] not in _CUT:
                cut -= 1
            end = cut if cut > at else end
        if text[at:end].strip():
            yield text[at:end].strip(), at, end
        at = end - overlap if end - overlap > at else end


def token(text: str, size: int = 500, overlap: int = 50) -> Iterator[tuple[str, int, int, int]]:
    """Windows of words, marks and runs of white space, with their number; the last is the one that reaches the end."""
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    at = 0
    while at < len(spans):
        end = min(at + size, len(spans))
        yield text[spans[at][0] : spans[end - 1][1]], spans[at][0], spans[end - 1][1], end - at
        if end == len(spans):
            return
        at = max(at + 1, end - overlap)


# The published pattern that cuts a text before byte pairs are merged.
BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """A byte-pair vocabulary of lines 'base64 of the token, rank', read where it is made and sent to the tasks."""

    def __init__(self, path: str, pattern: str = BPE_PATTERN):
        with open(path, "rb") as f:
            self.lines = f.read()
        self.pattern, self.name = pattern, path

    def encoding(self):
        """Of tiktoken; a worker makes it once."""
        import tiktoken

        key = (hash(self.lines), self.pattern)
        if key not in _encodings:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, self.lines.splitlines())}
            _encodings[key] = tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _encodings[key]


_encodings: dict = {}


def bpe(text: str, vocabulary: Vocabulary, size: int = 500, overlap: int = 50) -> Iterator[tuple[str, int, int, int]]:
    """Windows of at most size byte-pair tokens, with their number; no cut splits a character.

    Where a window would end or begin within a character, it does so at the last token before that begins one; a window
    whose every token ends within one character goes on to its end."""
    encoding = vocabulary.encoding()
    ids = encoding.encode_ordinary(text)
    ends = np.cumsum([0, *(len(t) for t in encoding.decode_tokens_bytes(ids))])
    data = np.frombuffer(text.encode(), np.uint8)
    begins = np.append((data & 0xC0) != 0x80, True)  # a character, or the end
    character_at = np.concatenate([[0], np.cumsum(begins[:-1])])
    whole = begins[ends]
    at = 0
    while at < len(ids):
        end = min(at + size, len(ids))
        while end > at and not whole[end]:
            end -= 1
        if end == at:
            end = min(at + size, len(ids))
            while not whole[end]:
                end += 1
        a, b = int(character_at[ends[at]]), int(character_at[ends[end]])
        yield text[a:b], a, b, end - at
        if end == len(ids):
            return
        begin = end - overlap
        while begin > at and not whole[begin]:
            begin -= 1
        at = begin if begin > at else end


def tail(text: str, n: int, only_first_half: bool = False) -> str:
    """The last n characters, from the first whole word on."""
    piece = text[-n:] if n else ""
    space = piece.find(" ")
    return piece[space + 1 :] if space >= 0 and (not only_first_half or space < n / 2) and len(text) > n else piece


def sections(text: str) -> Iterator[str]:
    lines: list[str] = []
    blank = 0
    for line in re.sub(r"\n\s*\n+", "\n\n", text).split("\n"):
        if lines and (_BOUNDARY.match(line) or blank >= 2):
            yield "\n".join(lines)
            lines = []
        blank = blank + 1 if not line.strip() else 0
        lines.append(line)
    if lines:
        yield "\n".join(lines)


def semantic(text: str, most: int = 1500, least: int = 400, overlap: int = 300) -> Iterator[Chunk]:
    """Sections; long ones packed sentence by sentence. Pieces under least characters are dropped."""
    at = 0
    for section in sections(text):
        if len(section) <= most:
            if len(section.strip()) >= least:
                yield section.strip(), at, at + len(section)
        else:
            held = ""
            for s in re.split(r"(?<=[.!?])\s", section):
                if held and len(held) + len(s) + 1 > most:
                    if len(held.strip()) >= least:
                        yield held.strip(), at, at + len(held)
                    held = (tail(held, overlap) + " " + s).strip()
                else:
                    held = f"{held} {s}" if held else s
            if len(held.strip()) >= least:
                yield held.strip(), at, at + len(held)
        at += len(section) + 1


def _recursive(text: str, separators: list[str], most: int, least: int) -> list[str]:
    if len(text) <= most:
        return [text]
    for k, s in enumerate(separators):
        if s and s in text:
            out, held = [], ""
            pieces = text.split(s)
            for i, p in enumerate(pieces):
                p += s if i < len(pieces) - 1 else ""
                if len(held) + len(p) <= most:
                    held += p
                    continue
                if len(held) >= least:
                    out.append(held)
                held = ""
                if len(p) > most:
                    out += _recursive(p, separators[k + 1 :], most, least)
                else:
                    held = p
            return [*out, held] if len(held) >= least else out
    out = []
    for i in range(0, len(text), most):
        piece = text[i : i + most]
        space = piece.rfind(" ")
        piece = piece[:space] if len(piece) == most and space > most / 2 else piece
        if len(piece) >= least:
            out.append(piece)
    return out


def recursive(text: str, most: int = 1500, least: int = 400, overlap: int = 300) -> Iterator[Chunk]:
    """Cuts at the coarsest separator present; each chunk after the first begins with the tail of the one before."""
    at = 0
    pieces = _recursive(text, SEPARATORS, most, least)
    for i, p in enumerate(pieces):
        found = text.find(p, at)
        start = found if found >= 0 else at
        at = start + len(p)
        whole = tail(pieces[i - 1], overlap, True) + p if i else p
        if whole.strip():
            yield whole[: most + overlap].strip(), start, at


def careful_sentences(text: str) -> list[str]:
    """Sentences, not cut after titles, company suffixes and months."""
    out, at = [], 0
    for gap in _GAP.finditer(text):
        if not _ABBREVIATION.search(text[max(0, gap.start() - 6) : gap.start()]):
            out.append(text[at : gap.start()].strip())
            at = gap.end()
    return [s for s in (*out, text[at:].strip()) if s]


class _Codes(dict):
    """Hashes of words, each made once."""

    def __missing__(self, word: str) -> int:
        self[word] = code = zlib.crc32(word.encode())
        return code


def hashed_vectors(texts: list[str], dim: int = 64) -> np.ndarray:
    """Bags of words by hash, of length one; the default embedder."""
    codes, hashes, counts = _Codes(), [], []
    for text in texts:
        before = len(hashes)
        hashes.extend(map(codes.__getitem__, _WORD.findall(text.lower())))
        counts.append(len(hashes) - before)
    h = np.array(hashes, np.int64)
    slots = np.repeat(np.arange(len(texts)), np.array(counts, np.int64)) * dim + h % dim
    v = np.bincount(slots, np.where(h >= 0x80000000, 1.0, -1.0), len(texts) * dim).reshape(len(texts), dim)
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(n == 0, 1.0, n)


def sentence_vectors(sentences: list[str], embedder: Embedder | None, **calls) -> np.ndarray:
    """A row for each sentence; those that the embedder fails on have zeros, which are like nothing."""
    if embedder is None:
        return hashed_vectors(sentences)
    found = [v for v, *_ in embed_texts(sentences, embedder, **calls)]
    size = max((len(v) for v in found if v is not None), default=1)
    return np.array([v if v is not None else [0.0] * size for v in found], float).reshape(len(found), size)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(a @ b / n) if n else 0.0


def join_alike(sentences: list[str], vectors: np.ndarray, most: int = 1500, least: int = 400, threshold: float = 0.8) -> Iterator[Chunk]:
    """Joins sentences while they are like the running mean of the chunk and fit; drops what stays under least."""
    held: list[str] = []
    size = at = 0
    mean = np.zeros(1)
    for s, v in zip(sentences, vectors, strict=True):
        if held and size + len(s) <= most and _cosine(mean, v) >= threshold:
            held.append(s)
            size += len(s)
            mean = mean * ((len(held) - 1) / len(held)) + v / len(held)
            continue
        if size >= least:
            yield " ".join(held), at, at + size
        at += size
        held, size, mean = [s], len(s), v
    if size >= least:
        yield " ".join(held), at, at + size


# What is no entity.
NO_ENTITIES = frozenset({"the", "a", "an", "this", "that", "these", "those"})
#: Common words that are no topic; a parameter of capitals.
NO_TOPICS = frozenset("the and for are was were with from that this these those has have had not but its his her their they them you your our who which what when where will would can could may into onto over under than then there here also been being".split())


def capitals(no_entities: frozenset[str] = NO_ENTITIES, no_topics: frozenset[str] = NO_TOPICS) -> Annotator:
    """The default annotator, in the place of a language model: runs of up to three capitalised words; words of three letters or more."""

    def annotate(sentences: list[str]) -> list[tuple[set[str], set[str]]]:
        out = []
        for s in sentences:
            entities = {e.lower() for e in re.findall(r"[A-Z]\w+(?: [A-Z]\w+){0,2}", s)}
            out.append((entities - no_entities, set(re.findall(r"[^\W\d_]{3,}", s.lower())) - no_topics))
        return out

    return annotate


def join_topics(sentences: list[str], vectors: np.ndarray, notes: Sequence[tuple[set[str], set[str]]], most: int = 2000, least: int = 500, threshold: float = 0.5) -> Iterator[tuple[str, int, int, list[str], list[str]]]:
    """Splits where the topic changes (once least is reached) or most would be passed; drops nothing. With entities and topics of each chunk."""
    held: list[str] = []
    size = at = 0
    entities: set[str] = set()
    topics: set[str] = set()
    mean = np.zeros(1)
    share = lambda a, b: len(a & b) / len(a | b) if a or b else 0.0
    for s, v, (e, t) in zip(sentences, vectors, notes, strict=True):
        if held and size + len(s) > most:
            split = True
        elif held and size >= least:
            cos, es, ts = _cosine(mean, v), share(entities, e), share(topics, t)
            split = (0.5 * cos + 0.25 * es + 0.25 * ts if cos > 0 else 0.5 * es + 0.5 * ts) < threshold
        else:
            split = False
        if split:
            yield " ".join(held), at, at + size, sorted(entities), sorted(topics)
            at += size
            held, size, entities, topics = [], 0, set(), set()
        held.append(s)
        size += len(s)
        entities |= e
        topics |= t
        mean = v if len(held) == 1 else mean * ((len(held) - 1) / len(held)) + v / len(held)
    if held:
        yield " ".join(held), at, at + size, sorted(entities), sorted(topics)


#: Sentences that are embedded and annotated together, those of one text at least.
TOGETHER = 4096


def _by_sentences(texts: list[str], fold: Callable[[list[str], np.ndarray, Sequence], Iterator], embedder: Embedder | None, annotator: Annotator | None, calls: dict) -> Iterator[list]:
    """The chunks of each text, in two phases: the sentences of many texts are embedded together, then each text is folded over."""

    def folded(group: list[list[str]]) -> Iterator[list]:
        every = [s for sentences in group for s in sentences]
        vectors = sentence_vectors(every, embedder, **calls)
        notes = annotator(every) if annotator else every
        at = 0
        for sentences in group:
            end = at + len(sentences)
            yield list(fold(sentences, vectors[at:end], notes[at:end]))
            at = end

    group: list[list[str]] = []
    held = 0
    for text in texts:
        group.append(careful_sentences(text))
        held += len(group[-1])
        if held >= TOGETHER:
            yield from folded(group)
            group, held = [], 0
    yield from folded(group)


def embedding(texts: list[str], embedder: Embedder | None = None, calls: dict | None = None, **sizes) -> Iterator[list[Chunk]]:
    """join_alike over each text. embedder: a batch embedder that may fail; calls: how embed_texts calls it."""
    return _by_sentences(texts, lambda s, v, _: join_alike(s, v, **sizes), embedder, None, calls or {})


def linguistic(texts: list[str], embedder: Embedder | None = None, annotator: Annotator | None = None, calls: dict | None = None, **sizes) -> Iterator[list[tuple[str, int, int, list[str], list[str]]]]:
    """join_topics over each text."""
    return _by_sentences(texts, lambda s, v, n: join_topics(s, v, n, **sizes), embedder, annotator or capitals(), calls or {})


def _each(cut: Callable) -> Callable:
    return lambda texts, **options: (list(cut(t, **options)) for t in texts)


def _tokens(texts: list[str], vocabulary: Vocabulary | None = None, **options) -> Iterator[list]:
    return (list(token(t, **options) if vocabulary is None else bpe(t, vocabulary, **options)) for t in texts)


#: Chunks of each of some texts.
STRATEGIES: dict[str, Callable[..., Iterator[list]]] = {"character": _each(character), "token": _tokens, "semantic": _each(semantic), "recursive_semantic": _each(recursive), "embedding_semantic": embedding, "linguistic": linguistic}
_FIELDS = [("chunk_index", pa.int64()), ("text_content", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())]
_MORE = {"token": [("token_count", pa.int64())], "linguistic": [("entities", pa.list_(pa.string())), ("topics", pa.list_(pa.string()))]}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.string()): "array<string>"}


def sizes(options: Options, strategy: str) -> dict[str, float]:
    """The options of a strategy, by the names of its parameters."""
    o = options
    return {
        "character": {"size": o.chunk_size, "overlap": o.chunk_overlap}, "token": {"size": o.token_max, "overlap": o.token_overlap},
        "semantic": {"most": o.semantic_max, "least": o.semantic_min, "overlap": o.chunk_overlap}, "recursive_semantic": {"most": o.semantic_max, "least": o.semantic_min, "overlap": o.chunk_overlap},
        "embedding_semantic": {"most": o.similarity_max, "least": o.semantic_min, "threshold": o.similarity_threshold}, "linguistic": {"most": o.linguistic_max, "least": o.linguistic_min, "threshold": o.linguistic_threshold},
    }[_known(strategy)]


def _known(strategy: str) -> str:
    return strategy if strategy in STRATEGIES else "character"


#: Bytes of texts that a task cuts at once (or one text): what it holds besides a batch of rows.
PIECE = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each (the last column) have about PIECE bytes."""
    for b in batches:
        group = np.cumsum(pc.fill_null(pc.binary_length(b.columns[-1]), 0).to_numpy(zero_copy_only=False)) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        yield from (b.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False) if y > x)


def _cut(name: str, options: dict, piece: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The chunks of each text, numbered."""
    return ([(i, *c) for i, c in enumerate(chunks)] for chunks in STRATEGIES[name]([t or "" for t in piece.columns[-1].to_pylist()], **options))


def _kinds(name: str) -> list[tuple[str, pa.DataType]]:
    return _FIELDS + _MORE.get(name, [])


def chunk(docs: DataFrame, strategy: str = "character", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, chunk_index, text_content, char_start, char_end, chunk_id; token_count of token chunks, entities and topics of linguistic ones.

    Options are the sizes of the strategy, and embedder, annotator, calls or vocabulary where it has them. Unknown strategies
    mean character; null texts give no rows."""
    name = _known(strategy)
    fields = _kinds(name)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            found = [(row, *c) for row, chunks in enumerate(_cut(name, options, piece)) for c in chunks]
            if found:
                of, *columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(of)), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], names=[piece.schema.names[0], *(n for n, _ in fields)])

    schema = rows.select(F.col(key), *[F.lit(None).cast(_SQL[t]).alias(n) for n, t in fields]).schema
    return rows.mapInArrow(run, schema).withColumn("chunk_id", chunk_id(F.col(key).cast("string"), name, F.col("chunk_index")))


def chunk_arrays(docs: DataFrame, strategy: str = "character", key: str = "doc_id", text: str = "text", contents: bool = True, **options) -> DataFrame:
    """key, n_chars and the array of a text's chunks, empty for null texts: for statistics of a text without a shuffle.

    contents: whether the chunks have what they hold (text_content, entities, topics) or their places alone."""
    name = _known(strategy)
    fields = [(n, t) for n, t in _kinds(name) if contents or t == pa.int64()]
    own = [k for k, f in enumerate(_kinds(name)) if f in fields]
    rows = docs.select(F.col(key), F.length(F.col(text)).cast("long").alias("n_chars"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            lists = [[tuple(c[k] for k in own) for c in chunks] for chunks in _cut(name, options, piece)]
            yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(lists, pa.list_(pa.struct(fields)))], names=[*piece.schema.names[:2], "chunks"])

    schema = rows.select(F.col(key), "n_chars", F.lit(None).cast(f"array<struct<{','.join(f'{n}:{_SQL[t]}' for n, t in fields)}>>").alias("chunks")).schema
    return rows.mapInArrow(run, schema)


def with_metadata(chunks: DataFrame, strategy: str, options: Options, **more: Column) -> DataFrame:
    """chunks with chunk_metadata: strategy, size, token count and the sizes asked for, and what more names; later keys win."""
    fixed = {"chunking_strategy": F.lit(_known(strategy)), "chunk_size": F.length("text_content")}
    if "token_count" in chunks.columns:
        fixed["token_count"] = F.col("token_count")
    if "entities" in chunks.columns:
        fixed |= {"entity_count": F.size("entities"), "topic_count": F.size("topics")}
    fixed |= {f"{k}_config": F.lit(v) for k, v in sizes(options, strategy).items()}
    return chunks.withColumn("chunk_metadata", F.create_map(*[x for k, v in (fixed | more).items() for x in (F.lit(k), v.cast("string"))]))


def _gone_over(spans: Column, n: Column) -> Column:
    """struct of covered (overlaps count twice), spanned (once), last_end and the lost ranges of a text of n characters."""
    kind = "struct<covered:long,spanned:long,last_end:long,lost:array<struct<start:long,end:long>>>"
    zero = F.from_json(F.lit('{"covered":0,"spanned":0,"last_end":0,"lost":[]}'), kind)

    def gap(a: Column, b: Column) -> Column:
        return F.when(b > a, F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(F.array().cast("array<struct<start:long,end:long>>"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.greatest(x["char_end"] - F.greatest(x["char_start"], s["last_end"]), F.lit(0).cast("long"))
        return F.struct((s["covered"] + x["char_end"] - x["char_start"]).alias("covered"), (s["spanned"] + fresh).alias("spanned"), F.greatest(s["last_end"], x["char_end"]).alias("last_end"), F.concat(s["lost"], gap(s["last_end"], x["char_start"])).alias("lost"))

    last = lambda s: F.struct(s["covered"], s["spanned"], s["last_end"], F.concat(s["lost"], gap(s["last_end"], n)).alias("lost"))
    return F.aggregate(F.array_sort(spans), zero, lambda s, x: step(s, x).cast(kind), last)


def _covered(rows: DataFrame, key: str) -> DataFrame:
    """From key, n_chars and spans."""
    none = F.array().cast("array<struct<char_start:long,char_end:long>>")
    found = rows.select(key, "n_chars", _gone_over(F.coalesce("spans", none), F.coalesce("n_chars", F.lit(0).cast("long"))).alias("c"))
    return found.select(key, "n_chars", "c.covered", "c.spanned", "c.last_end", "c.lost").withColumn("lossy", F.col("spanned") < 0.95 * F.col("n_chars"))


def coverage_of(arrays: DataFrame, key: str = "doc_id", keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """coverage from the rows of chunk_arrays, without a shuffle; keep: which chunks count."""
    chunks = F.col("chunks") if keep is None else F.filter("chunks", keep)
    span = lambda c: F.struct(c["char_start"].alias("char_start"), c["char_end"].alias("char_end"))
    return _covered(arrays.select(key, "n_chars", F.transform(chunks, span).alias("spans")), key)


def coverage(chunks: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: characters in chunks (covered counts overlaps twice, spanned once), the last end, the lost ranges, whether over a twentieth is lost."""
    spans = chunks.groupBy(key).agg(F.collect_list(F.struct(F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))).alias("spans"))
    return _covered(docs.select(key, F.length(F.col(text)).cast("long").alias("n_chars")).join(spans, key, "left"), key)
