"""Bit planes, prefix BPE, longest match, decontamination and the Jaccard join against plain versions."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers as P
from corvella.llm import bitplanes, decontaminate, jaccard_join, prefix_bpe, wordpiece_counts
from corvella.llm.common import scratch, unit_keys, unit_text

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [None, "", " ", "a", "a  b", "\n\n x \t y", "x y z\x1f w", "a \n b\n\nc  ", "don't 12 !!", "é中😀 " * 3, "word" * 3000, "<|endoftext|> x", "x\x00 y"]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a repeated row, a null id and columns whose names clash with inner ones."""
    rows = [(i, t, "k", 1, [1]) for i, t in enumerate(ODD)] + [(3, "a", "k", 1, [1]), (None, "a b c d e f", "k", 1, [1])]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n int, items array<int>")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint32)
    for a in (ids, ids[:1], ids[:0], ids % 300):
        assert (bitplanes.from_planes(bitplanes.to_planes(a, bits), len(a), bits) == a).all()


@pytest.mark.parametrize("bits", [False, True])
def test_files(bits):
    w = bitplanes.Writer(block_ids=64, bits=bits)
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 50257, n).astype("<u4") for n in (0, 1, 63, 64, 65, 300, 2)]
    for i, x in enumerate(lists):
        w.add(None if i == 2 else i, x)
    r = bitplanes.Reader(w.close())
    got = list(r.documents())
    assert [d for d, _, _ in got] == [0, 1, None, 3, 4, 5, 6]
    assert all((a == b).all() for (_, _, a), b in zip(got, lists, strict=True))
    flat = np.concatenate(lists)
    for s, n in ((0, 1), (60, 10), (100, 200), (len(flat) - 1, 1), (5, 0)):
        assert (r.ids(s, n) == flat[s : s + n]).all()
    e = bitplanes.Reader(bitplanes.Writer().close())
    assert list(e.documents()) == []


@pytest.mark.parametrize("literal", [False, True])
def test_op7_against_the_library(spark, docs, literal):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = literal
    folder = scratch(spark, "t7")
    manifest = bitplanes.write_ids(docs, P.path("byte_bpe_50k.json"), folder, file_ids=2000, block_ids=512, **({"literal": True} if literal else {}))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in bitplanes.read_ids(spark, folder, manifest).collect())
    want, at = [], 0
    for d, t in sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect()):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert manifest.count() > 1
    folder = scratch(spark, "t7")
    assert bitplanes.read_ids(spark, folder, bitplanes.write_ids(empty(spark), P.path("byte_bpe_50k.json"), folder)).count() == 0


def test_op7_reads_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a b", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b\n\n c", "<|endoftext|", None, "y x <|endoftext |> <| endoftext|>"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in bitplanes.op7(spark, str(tmp_path)).collect())
    want, at = [], 0
    for d, t in enumerate(texts):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want and want[2][2] == 2


def test_op7_sends_known_words_with_marks_to_the_library_once():
    enc, sent = bitplanes.LibraryEncoder(P.path("byte_bpe_50k.json")), []
    learn = enc._learn
    enc._learn = lambda keys: (sent.extend(keys), learn(keys))
    texts = ["x zorble quaffin", "x zorble, quaffin.***", "x quaffin, zorble.*** zorble,", "x zorble,é zorble-quaffin, zorble1."]
    for t, new in zip(texts, ({"\x00x", "zorble", "quaffin"}, {"zorble,", "quaffin.***", "\x00,", "\x00.***"}, set(), {"zorble,é", "zorble-quaffin,", "zorble1."}), strict=True):
        sent.clear()
        assert list(enc.encode([t])) == [enc.whole(t)] and set(sent) == new


def test_op7_encoder_keeps_the_librarys_ids_when_units_leave_and_come_back():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeéñß中ªʰ𝒜١1'’-_", k=rng.randint(1, 6))) for _ in range(300)]
    marks = ["", "", ",", ".", "'s,", "...", "?!", "'", "$$$", "—", ".'", ",a", "_", "<|", "·"]
    texts = [rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice(marks) + rng.choice([" ", " ", " ", "\n", *["  "] * (n % 5 == 0)]) for _ in range(40)) for n in range(1500)]
    enc = bitplanes.LibraryEncoder(P.path("byte_bpe_50k.json"), units=1000)
    assert list(enc.encode([*texts, None, ""])) == [enc.whole(t) for t in [*texts, "", ""]]
    assert len(enc.units) + len(enc.units.older) < 12_000 and not enc.units.new


def test_op7_encoder_goes_on_after_a_failure():
    enc = bitplanes.LibraryEncoder(P.path("byte_bpe_50k.json"))
    learn, enc._learn = enc._learn, lambda keys: 1 // 0
    with pytest.raises(ZeroDivisionError):
        list(enc.encode(["a new word"]))
    enc._learn = learn
    assert list(enc.encode(["a new word"])) == [enc.whole("a new word")]


def test_units_join_to_the_text():
    for t in ODD:
        keys = unit_keys(t or "")
        assert keys is None or "".join(map(unit_text, keys)) == (t or "")


def test_op8_against_the_library(spark, docs):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in prefix_bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    want = []
    for r in docs.collect():
        ids = ENC.encode_ordinary(r.text or "")
        want.append((-1 if r.doc_id is None else r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert prefix_bpe.digests(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    ids = prefix_bpe.encode(docs.where("doc_id = 9"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert prefix_bpe.decode(ids, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()["bytes"].decode() == ODD[9]


def test_appends_and_edits():
    c = prefix_bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    for _ in range(400):
        b = "".join(rng.choice("aeiothnsré中1") for _ in range(rng.randint(1, 60))).encode()
        s = c.append(prefix_bpe.State(), b[:9])
        before = list(s.last)
        c.append(s, b[9:])
        assert s.last[: len(before)] == before
        if b not in RANKS:
            assert c.tokens(s) == ENC._core_bpe.encode_single_piece(b)
        i = rng.randint(0, len(b))
        j = rng.randint(i, len(b))
        new = bytes(rng.choice(b"abthe") for _ in range(rng.randint(0, 4)))
        c.replace(s, i, j, new)
        fresh = c.append(prefix_bpe.State(), b[:i] + new + b[j:])
        assert s.last == fresh.last and s.data == fresh.data


def greedy(word: bytes, first: set, more: set) -> int:
    at = n = 0
    while at < len(word):
        pieces = more if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_op10_against_greedy_matching(spark, docs):
    first, more = wordpiece_counts.pieces_of(P.path("byte_bpe_50k.json"))
    got = collections.Counter((r.doc_id, r.n_tokens, r.n_words) for r in wordpiece_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect())
    want = collections.Counter((r.doc_id, sum(greedy(w.encode(), first, more) for w in SPACE.findall(r.text or "")), len(SPACE.findall(r.text or ""))) for r in docs.collect())
    assert got == want
    rng = random.Random(6)
    for _ in range(300):
        a = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6))}
        b = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6))}
        auto = wordpiece_counts.LongestMatch(a, b)
        for _ in range(20):
            w = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
            assert auto.count(w) == greedy(w, a, b), (a, b, w)


def test_op5_against_brute_force(spark, docs):
    rng = random.Random(7)
    item = [" ".join(rng.choice(["the", "of", "x", "was", "é", "b2"]) for _ in range(n)) for n in (10, 14, 3, 1, 0, 25)]
    items = spark.createDataFrame([*enumerate(item), (9, None), (0, item[0])], "item_id long, text string")
    texts = [None, "", item[0], "Q " + item[1].upper() + " z", item[5] + "! " + item[2], "of", " ".join(rng.choice(["the", "of", "x"]) for _ in range(400)), item[0][:-2], "zz " * 50]
    d = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(2, item[0], [2])], "doc_id long, text string, items array<int>")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(UPPER))
    for block in (1_000_000, 8):
        got = sorted((r.doc_id, r.n_words, sum(r.hit_spans[1::2]) - sum(r.hit_spans[::2]), sorted(set(r["items"])), r.longest) for r in decontaminate.find(d, items, 10, block).collect())
        want = []
        for i, t in [*enumerate(texts), (2, item[0])]:
            w, hit, found, longest = words(t), set(), set(), 0
            for k, it in enumerate(item):
                q = words(it)
                n = min(10, len(q))
                for p in range(len(q) - n + 1 if n else 0):
                    for a in range(len(w) - n + 1):
                        if w[a : a + n] == q[p : p + n]:
                            hit |= set(range(a, a + n))
                            found.add(str(k))
                            m = n
                            while a + m < len(w) and p + m < len(q) and w[a + m] == q[p + m]:
                                m += 1
                            longest = max(longest, m)
            want.append((i, len(w), len(hit), sorted(found), longest))
        assert got == sorted(want)
    assert {r.doc_id for r in decontaminate.remove(d, items).collect()} == {i for i, _, h, _, _ in want if not h}
    assert decontaminate.remove(docs, items.where("false")).count() == docs.count()
    assert decontaminate.remove(docs, items).schema == docs.schema
    assert decontaminate.find(empty(spark), items).count() == 0


@pytest.mark.parametrize("block, parts", [(1_000_000, 1), (12, 3)])
def test_op5_longest_matches_against_brute_force(spark, block, parts):
    rng = random.Random(9)
    some = lambda n, k=9: " ".join(rng.choices([f"w{j}" for j in range(k)], k=n))
    items = [(0, some(30)), (1, some(4)), (2, "nowhere at all"), (3, None), (4, ""), (None, some(12)), (5, some(60, 3)), (6, "last word of w1 w2 unheard w3")]
    texts = [(i, some(rng.randrange(80))) for i in range(40)] + [(90, items[0][1]), (80, "a " + items[0][1].upper() + " b"), (None, items[5][1]), (91, None), (92, ""), (5, "x w3 w3 " + items[6][1]), (93, some(300, 3))]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(UPPER))
    want = {}
    for name, t in items:
        q, found = words(t), []
        for d, x in texts:
            w = words(x)
            for p in range(len(q)):
                for a in range(len(w)):
                    m = 0
                    while p + m < len(q) and a + m < len(w) and q[p + m] == w[a + m]:
                        m += 1
                    found.append((-m, p, d is None, d or 0, a))
        best = min(found, default=(0,))
        if best[0]:
            want[name] = (-best[0], best[1], None if best[2] else best[3], best[4])
    d = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, length int").repartition(parts)
    got = decontaminate.longest_matches(d, spark.createDataFrame(items, "item_id int, text string"), block)
    assert {r.item_id: tuple(r)[1:] for r in got.collect()} == want and 2 not in want and want[0][0] == 30
    assert decontaminate.longest_matches(empty(spark), d.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert decontaminate.longest_matches(d, empty(spark).withColumnRenamed("doc_id", "item_id")).count() == 0


@pytest.mark.parametrize("size", [*range(60, 132), *range(250, 515, 3)])
def test_op5_finds_short_items_for_all_vocabulary_sizes(size):
    """Items of 1 to 10 words, in blocks of so many distinct words; keys of 63 bits would overflow."""
    names = [f"w{k}" for k in range(size)]
    short = [" ".join(names[-n - k] for k in range(n)) for n in range(1, 11)]
    test = decontaminate.TestSet([*enumerate(short), (99, " ".join(names))], 10)
    texts = [f"other {t} other" for t in short]
    words = decontaminate.Words(pa.array(texts), decontaminate.ALNUM)
    for n, row in enumerate(decontaminate.judge(test, words), 1):
        assert str(n - 1) in row[2] and row[1] == [1, n + 1] and row[3] == n


def test_op5_keeps_items_without_an_id(spark):
    items = spark.createDataFrame([(None, "one two three"), (None, "four five"), (1, "six")], "item_id long, text string")
    d = spark.createDataFrame([(0, "a one two three b four five"), (1, "six one two three"), (2, "seven")], "doc_id long, text string")
    got = {r.doc_id: (r.hit_spans, set(r["items"])) for r in decontaminate.find(d, items).collect()}
    assert got == {0: ([1, 4, 5, 7], {None}), 1: ([0, 4], {"1", None}), 2: ([], set())}
    assert [r.doc_id for r in decontaminate.remove(d, items).collect()] == [2]


def test_op5_takes_one_block_at_a_time(spark, monkeypatch):
    log, blocks, kind = [], decontaminate._blocks, decontaminate.TestSet
    monkeypatch.setattr(decontaminate, "_blocks", lambda *a: (log.append("read") or b for b in blocks(*a)))
    monkeypatch.setattr(decontaminate, "TestSet", lambda *a: log.append("set") or kind(*a))
    items = spark.createDataFrame([(k, f"one two {k}") for k in range(3)], "item_id long, text string")
    d = spark.createDataFrame([(0, "one two 0 one two 2"), (1, "x")], "doc_id long, text string")
    assert {r.doc_id: r.hit_spans for r in decontaminate.find(d, items, 10, 1).collect()} == {0: [0, 6], 1: []}
    assert log == ["read", "read", "set", "read", "set", "set"]


def components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate(UPPER))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d if d is not None else -1, len(sets[i]), least.get(root(i), d if d is not None else -1)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n, percent", [(4, 85), (2, 60)])
def test_op9_against_brute_force(spark, n, percent):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40)) for _ in range(k)] for k in (3, 5, 12, 40, 120)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two three")]
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 14))):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            rows.append((len(rows), " ".join(w)))
    rows += [(7, rows[7][1]), (8, "other text with one id here"), (None, rows[9][1]), (None, rows[9][1])]
    # Near copies without an id, one of them the only link between two documents.
    line = [f"w{k}" for k in range(100)]
    edited = lambda *at: " ".join("new" + w if k in at else w for k, w in enumerate(line))
    rows += [(900, edited(5, 35)), (None, edited(5)), (901, edited(5, 65)), (None, edited(70, 80)), (910, "q " * 60 + "é z"), (None, "q " * 60 + "é y z")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard_join.join(df, n, percent).collect())
    assert got == components(rows, n, percent)


def test_op9_empty(spark):
    assert jaccard_join.join(empty(spark)).count() == 0
    assert jaccard_join.stage(spark, empty(spark), "").count() == 0


def test_jaccard_stage_keeps_one_row_of_each_group(spark):
    """Against brute force: one row a component, also of repeated rows and rows without an id; empty texts stay."""
    rng = random.Random(18)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(4)]
    near = lambda t: " ".join("edit" if k == 30 else w for k, w in enumerate(t.split(" ")))
    rows = [(5, base[0]), (3, near(base[0])), (3, near(base[0])), (None, base[0]), (None, base[1]), (None, base[1]), (8, base[2]), (8, base[3]), (9, None), (9, None), (10, ""), (None, None)]
    df = spark.createDataFrame([(*r, "key", [1], 2) for r in rows], "doc_id long, text string, key string, label array<int>, n int")
    out = jaccard_join.stage(spark, df, "")
    assert out.schema == df.schema
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got == collections.Counter([(3, near(base[0])), (None, base[1]), (8, base[2]), (8, base[3]), (9, None), (9, None), (10, ""), (None, None)])


def test_word_hashes_tell_thue_morse_words_apart():
    from corvella.llm.wordhash import NON_SPACE, Words

    flip = str.maketrans("ab", "ba")
    words = ["a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 64, "a" * 65, "b" + "a" * 64, "é", "éa"]
    t = "a"
    while len(t) < 5000:
        t += t.translate(flip)
        words += [t, t.translate(flip)] if len(t) > 2 else []
    got = Words(pa.array([" ".join(words), None, "A " + words[-1]]), NON_SPACE)
    assert len(set(got.hash[: len(words)].tolist())) == len(words) and got.hash[-1] == got.hash[len(words) - 1] and got.hash[-2] == got.hash[0]
