import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella.config import Options
from corvella.operators import chunkers as C

TEXTS = st.text(alphabet="ab. ,\n!?é中😀A", max_size=6000)


@pytest.mark.parametrize("n, want", [(0, []), (1, [(0, 1)]), (300, [(0, 300)]), (301, [(0, 301), (1, 301)]), (1000, [(0, 1000), (700, 1000)]), (1200, [(0, 1200), (900, 1200)]), (1201, [(0, 1200), (900, 1201), (901, 1201)])])
def test_character_windows(n, want):
    assert [(a, b) for _, a, b in C.character("x" * n)] == want


def test_character_cuts_at_a_separator():
    text = "a" * 700 + " " + "b" * 900
    assert [(a, b) for _, a, b in C.character(text)][0] == (0, 700)
    assert list(C.character(" \n ")) == []


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_character_properties(text):
    for t, a, b in C.character(text):
        assert text[a:b].strip() == t and 0 < b - a <= 1200


@given(st.integers(0, 1500))
@settings(max_examples=40, deadline=None)
def test_token_windows_end(n):
    got = list(C.token("a " * n))
    assert (not n) or got[-1][2] == 2 * n
    assert len(got) == (0 if not n else max(0, -(-(2 * n - 500) // 450)) + 1)


@given(TEXTS)
@settings(max_examples=40, deadline=None)
def test_all_strategies_end(text):
    for name, cut in C.STRATEGIES.items():
        for t, a, b, *_ in list(cut([text]))[0]:
            assert t and a <= b, name


def test_semantic_sections():
    text = "# One\n" + "x " * 250 + "\n# Two\n" + "y " * 100 + "\n" + "Section 3\n" + "z. " * 700
    got = [t for t, _, _ in C.semantic(text)]
    assert got[0].startswith("# One") and not any(t.startswith("# Two") for t in got) and got[1].startswith("Section 3")


def test_recursive_takes_the_coarsest_separator():
    got = [t for t, _, _ in C.recursive("a" * 900 + "\n\n" + "b" * 900)]
    assert len(got) == 2 and got[1].endswith("b" * 900)
    assert [len(t) for t, _, _ in C.recursive("c" * 100)] == [100]


def test_linguistic_drops_nothing():
    text = "Alpha beta gamma. " * 300
    assert sum(b - a for _, a, b, *_ in list(C.linguistic([text]))[0]) == sum(map(len, C.careful_sentences(text)))


def test_sentences_and_abbreviations():
    assert C.careful_sentences("Dr. Who paid 3.5 today. Then he left. ok") == ["Dr. Who paid 3.5 today.", "Then he left. ok"]


def test_unknown_strategy_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.text_content) for r in C.chunk(df, "nothing").collect()] == [(1, "a b")]


# -- windows of byte-pair tokens

VOCABULARY = C.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def plain_bpe(text, size, overlap):
    """Windows found by decoding: a place between two tokens is whole if the bytes before it decode."""
    tokens = VOCABULARY.encoding().decode_tokens_bytes(VOCABULARY.encoding().encode_ordinary(text))

    def whole(k):
        try:
            return b"".join(tokens[:k]).decode() is not None
        except UnicodeDecodeError:
            return False

    out, at = [], 0
    while at < len(tokens):
        top = min(at + size, len(tokens))
        fits = [k for k in range(at + 1, top + 1) if whole(k)]
        end = fits[-1] if fits else next(k for k in range(top, len(tokens) + 1) if whole(k))
        piece = b"".join(tokens[at:end]).decode()
        start = len(b"".join(tokens[:at]).decode())
        out.append((piece, start, start + len(piece), end - at))
        if end == len(tokens):
            break
        back = [k for k in range(at + 1, end - overlap + 1) if whole(k)]
        at = back[-1] if back else end
    return out


@given(st.text(alphabet="ab .\né中😀𓀀\u0301", max_size=300), st.integers(1, 40), st.integers(0, 20))
@settings(max_examples=80, deadline=None)
def test_bpe_windows_against_decoding(text, size, overlap):
    got = list(C.bpe(text, VOCABULARY, size, overlap))
    assert got == plain_bpe(text, size, overlap)
    assert all(text[a:b] == t for t, a, b, _ in got) and (not text or (got[0][1] == 0 and got[-1][2] == len(text)))


def test_bpe_of_a_table(spark):
    texts = [(1, "One two. " * 300), (2, None), (3, ""), (4, "𓀀" * 700), (5, "x" * 5000)]
    got = C.chunk(spark.createDataFrame(texts, "doc_id long, text string"), "token", vocabulary=VOCABULARY).collect()
    want = {(i, k): (t, n) for i, text in texts for k, (t, _, _, n) in enumerate(plain_bpe(text or "", 500, 50))}
    assert {(r.doc_id, r.chunk_index): (r.text_content, r.token_count) for r in got} == want


# -- two phases: vectors of many sentences, then a fold over each text


def plain_alike(text, vector, most, least, threshold):
    out, held, at = [], [], 0
    cosine = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if np.linalg.norm(a) and np.linalg.norm(b) else 0.0
    for s in [*C.careful_sentences(text), None]:
        size = sum(map(len, held))
        if s is not None and held and size + len(s) <= most and cosine(np.mean([vector(x) for x in held], axis=0), vector(s)) >= threshold:
            held.append(s)
            continue
        if held and size >= least:
            out.append((" ".join(held), at, at + size))
        at += size
        held = [s]
    return out


WORDS = "Alpha beta gamma Delta Berlin Paris delta alpha beta beta".split()


def some_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(" ".join(r.choices(WORDS, k=r.randrange(1, 9))).capitalize() + ". " for _ in range(r.randrange(40))) for _ in range(n)]


def refusing(texts):
    if any("Paris" in t for t in texts):
        raise ValueError("refused")
    return [[float(t.count(w)) for w in ("alpha", "beta", "gamma", "elta")] for t in texts]


def test_sentences_embedded_together(spark, monkeypatch):
    monkeypatch.setattr(C, "TOGETHER", 7)
    texts = some_texts(60) + ["", " ", "One."]
    vector = lambda s: np.zeros(4) if "Paris" in s else np.array(refusing([s])[0])
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").repartition(2)
    got = C.chunk(df, "embedding_semantic", embedder=refusing, calls={"batch": 3, "attempts": 1}, most=200, least=40, threshold=0.6)
    rows = sorted((r.doc_id, r.chunk_index, r.text_content, r.char_start, r.char_end) for r in got.collect())
    want = [(i, k, *c) for i, t in enumerate(texts) for k, c in enumerate(plain_alike(t, vector, 200, 40, 0.6))]
    assert rows == want and len({r[0] for r in rows}) > 20
    one = C.hashed_vectors
    default = [[tuple(c) for c in x] for x in C.embedding(texts, most=200, least=40, threshold=0.6)]
    assert default == [plain_alike(t, lambda s: one([s])[0], 200, 40, 0.6) for t in texts]


def plain_topics(text, vector, note, most, least, threshold):
    out, held, at = [], [], 0
    cosine = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if np.linalg.norm(a) and np.linalg.norm(b) else 0.0
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    both = lambda k: set().union(*(note(x)[k] for x in held))
    for s in [*C.careful_sentences(text), None]:
        size = sum(map(len, held))
        if held:
            if s is not None:
                c = cosine(np.mean([vector(x) for x in held], axis=0), vector(s))
                e, t = (share(both(k), note(s)[k]) for k in (0, 1))
                like = 0.5 * c + 0.25 * e + 0.25 * t if c > 0 else 0.5 * e + 0.5 * t
            if s is None or size + len(s) > most or (size >= least and like < threshold):
                out.append((" ".join(held), at, at + size, sorted(both(0)), sorted(both(1))))
                at += size
                held = []
        held.append(s)
    return out


def test_topics_and_entities_of_an_annotator(spark):
    calls = []

    def annotate(sentences):
        calls.append(len(sentences))
        return [({w for w in s.split() if w[0].isupper()}, {w.strip(".") for w in s.split() if len(w) == 4}) for s in sentences]

    texts = some_texts(50)
    want = [plain_topics(t, lambda s: C.hashed_vectors([s])[0], lambda s: annotate([s])[0], 300, 60, 0.7) for t in texts]
    calls.clear()
    assert [[tuple(c) for c in x] for x in C.linguistic(texts, annotator=annotate, most=300, least=60, threshold=0.7)] == want
    assert len(calls) == 1  # in one call for all texts
    rows = C.chunk(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "linguistic", annotator=annotate, most=300, least=60, threshold=0.7).collect()
    assert sorted((r.doc_id, r.chunk_index, r.entities, r.topics) for r in rows) == [(i, k, c[3], c[4]) for i, x in enumerate(want) for k, c in enumerate(x)]


def test_default_annotator_leaves_out_common_words():
    assert C.capitals()(["The New York Times and the Cat. It is 5"]) == [({"the new york", "times", "cat", "it"}, {"new", "york", "times", "cat"})]
    assert C.capitals(no_entities=frozenset({"it"}), no_topics=frozenset())(["It and"]) == [(set(), {"and"})]


def plain_recursive(text, most, least, overlap):
    """By places in the text: cut after each of the coarsest separators, fill up to most, go deeper where one part is too long."""

    def places(a, b, separators):
        if b - a <= most:
            return [(a, b)]
        for k, s in enumerate(separators):
            ends, at = [], text.find(s, a) if s else -1
            while 0 <= at and at + len(s) <= b:
                ends.append(at + len(s))
                at = text.find(s, at + len(s))
            if ends:
                out, begin, end = [], a, a
                for e in [*ends, b]:
                    if e - begin <= most:
                        end = e
                        continue
                    out += [(begin, end)] if end - begin >= least else []
                    out += places(end, e, separators[k + 1 :]) if e - end > most else []
                    begin, end = (e, e) if e - end > most else (end, e)
                return out + ([(begin, end)] if end - begin >= least else [])
        out = []
        for x in range(a, b, most):
            y = min(x + most, b)
            space = text.rfind(" ", x, y)
            y = space if y - x == most and space - x > most / 2 else y
            out += [(x, y)] if y - x >= least else []
        return out

    out, at, before = [], 0, None
    for a, b in places(0, len(text), C.SEPARATORS):
        piece, lead = text[a:b], ""
        if before is not None:
            lead = before[-overlap:]
            space = lead.find(" ")
            if 0 <= space < overlap / 2 and len(before) > overlap:
                lead = lead[space + 1 :]
        start = text.find(piece, at)
        at = start + len(piece)
        if (lead + piece).strip():
            out.append(((lead + piece)[: most + overlap].strip(), start, at))
        before = piece
    return out


@given(st.text(alphabet="ab. ,\n!?;é", max_size=400), st.integers(20, 60), st.integers(0, 20), st.integers(1, 19))
@settings(max_examples=300, deadline=None)
def test_recursive_against_brute_force(text, most, least, overlap):
    assert list(C.recursive(text, most, least, overlap)) == plain_recursive(text, most, least, overlap)


# -- coverage


def test_lost_ranges_against_a_walk_over_characters(spark):
    r = random.Random(2)
    spans = [[tuple(sorted(r.sample(range(60), 2))) for _ in range(r.randrange(6))] for _ in range(50)]
    docs = spark.createDataFrame([(i, "x" * (60 if i else 0)) for i in range(50)], "doc_id long, text string")
    chunks = spark.createDataFrame([(i, a, b) for i, s in enumerate(spans) if i for a, b in s], "doc_id long, char_start long, char_end long")
    for row in C.coverage(chunks, docs).collect():
        n, own = (60, spans[row.doc_id]) if row.doc_id else (0, [])
        seen = [any(a <= k < b for a, b in own) for k in range(n)]
        lost = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if not any(seen[a:b]) and (a == 0 or seen[a - 1]) and (b == n or seen[b])]
        assert (row.n_chars, row.covered, row.spanned, row.last_end, [tuple(x) for x in row.lost], row.lossy) == (n, sum(b - a for a, b in own), sum(seen), max((b for _, b in own), default=0), lost, sum(seen) < 0.95 * n)


def test_coverage_of_every_strategy_agrees_with_its_chunks(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40).cache()
    for name in C.STRATEGIES:
        key = lambda r: (r.doc_id, r.n_chars, r.covered, r.spanned, r.last_end, str(r.lost))
        assert sorted(map(key, C.coverage_of(C.chunk_arrays(docs, name)).collect())) == sorted(map(key, C.coverage(C.chunk(docs, name), docs).collect()))


def test_metadata_of_chunks(spark):
    d = spark.createDataFrame([(1, "One two three.")], "doc_id long, text string")
    got = C.with_metadata(C.chunk(d, "token"), "token", Options(), model=F.lit("m"), chunk_size=F.lit(0)).first().chunk_metadata
    assert got == {"chunking_strategy": "token", "chunk_size": "0", "token_count": "6", "size_config": "500", "overlap_config": "50", "model": "m"}
    assert C.with_metadata(C.chunk(d, "linguistic"), "linguistic", Options()).first().chunk_metadata["entity_count"] == "1"
