"""Statistics, toxicity, language-model scores, tool calls and the pipeline."""

import collections
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvella.llm import decision_list, mixing, tool_calls, toxicity, warc_derivatives
from tests.oracle import rows, sql_rows

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}
TEXTS = [None, "", " \n\t", "a", "a b a b a b", "x\nx\n\nx\ny", "#|$ 1! é 中😀", "w " * 3000, "one two three one two three four", "A\x0bB\x0cC"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(TEXTS)] + [(3, "a", 1, "s"), (None, "b c", 1, "s")], "doc_id long, text string, n_words int, lines string")


def quoted_hits(*texts):
    """(plain hits, quoted hits) of each text."""
    x = np.expm1(toxicity.numbers(toxicity.Lexicon(["blockhead"], ["nitwi", "\u0436" * 5]), pa.array(texts, pa.string())))
    return [(round(a), round(b)) for a, b in zip(x[:, :4].sum(1), x[:, 4], strict=True)]


def test_toxicity_quotations():
    bad = "you blockhead"
    plain = [f'a 5" pipe {bad}', f'a 5" pipe {bad} "well"', f'"never closed {bad}', f'"never closed. {bad} "well" he said', f'"one\n\n{bad}" two', f'"a" {bad} "b"', f"\u201cnever closed {bad}", f"\u00bba\u00ab {bad} \u00bbb\u00ab", f"don\u2019t {bad}"]
    assert quoted_hits(*plain) == [(1, 0)] * len(plain)
    quoted = [f'he said "{bad}" so', f'a 5" pipe, "{bad}"', f"\u201c{bad}\u201d", f"\u201e{bad}\u201c", f"\u00ab {bad} \u00bb, so", f"\u00bb{bad}\u00ab", f"\u4ed6\u300c{bad}\u300d\u4ed6", f'"one\n{bad}."', '"blockhead"', "\u201cblockhead\u201d"]
    assert quoted_hits(*quoted) == [(0, 1)] * len(quoted)
    assert quoted_hits(None, "", '"', bad + ' "' + bad + '"') == [(0, 0)] * 3 + [(1, 1)]


def test_toxicity_reads_marks_beyond_ascii_as_no_part_of_words():
    assert quoted_hits(*[f"well{m}blockhead{m}so" for m in "\u2014\u2013\u2026\u00a0\u00bf\u3001\uff01"]) == [(1, 0)] * 7
    assert quoted_hits("he said \u201cblockhead\u201d loudly") == [(0, 1)]


def test_toxicity_stage_agrees_with_the_scores(spark, tmp_path):
    docs, labels = toxic_corpus(spark, 200)
    labels.select("doc_id", "toxic", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))).unionByName(spark.createDataFrame([(None, None), (3, ""), (3, "")], "doc_id long, text string")).withColumn("score", F.lit("x"))
    kept = sorted(str(r.doc_id) for r in toxicity.stage(spark, docs, str(tmp_path)).collect())
    want = sorted(str(r.doc_id) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.score < 0.7)
    assert kept == want and 0 < len(kept) < docs.count()


def test_toxicity_matches_long_words():
    assert quoted_hits("nitwit" + "x" * 100, "\u0436" * 40, "x" * 100) == [(1, 0), (1, 0), (0, 0)]


def test_statistics(odd):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in decision_list.base_statistics(odd).collect())
    want = collections.Counter()
    for r in odd.collect():
        t = r.text or ""
        w = SPACE.findall(t)
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want[r.doc_id, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want


def test_decision_list_learns_a_rule(spark, odd):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        docs.append((i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 999)) + ("***" if bad and rng.random() < 0.8 else "") for _ in range(80))))
        labels.append((i, 1 - int(bad)))
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = decision_list.fit(d, m)
    assert rules and rules[0][0][0] in ("symbol_rate", "mean_word")
    kept = {r.doc_id for r in decision_list.judged(d, rules).where("kept").collect()}
    assert kept == {i for i, q in labels if q}
    assert decision_list.fit(d, m.where("false")) == []
    assert decision_list.judged(odd, rules).count() == odd.count() and decision_list.judged(odd.where("false"), []).count() == 0


def test_levenshtein_automaton_against_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        k = rng.randint(0, 2)
        auto = toxicity.LevenshteinAutomaton(a, k)
        s = auto.start()
        for x in b:
            s = auto.step(s, x)
        want = distance(a, b)
        assert auto.errors(s) == (want if want <= k else None)


def test_lexicon_misses_no_entry():
    lex = toxicity.Lexicon(["clown", "idiot", "worthless"], ["lowei"])
    rng = random.Random(3)
    for entry in ("clown", "idiot", "worthless"):
        for _ in range(60):
            i = rng.randrange(len(entry))
            x = rng.choice("qxz")
            for w in (entry[:i] + entry[i + 1 :], entry[:i] + x + entry[i + 1 :], entry[:i] + x + entry[i:]):
                assert lex.match(w) == (0, 1), w
        assert lex.match(entry) == (0, 0)
    assert lex.match("loweischaft") == (1, 0) and lex.match("louweixx") == (1, 1) and lex.match("house") is None


def toxic_corpus(spark, n=400):
    rng = random.Random(4)
    out = []
    for i in range(n):
        w = [rng.choice("abcdefgh") + rng.choice("lmnopq") + str(rng.randint(0, 30)) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for bad in ("blockhead", "nitwit"):
                w[rng.randrange(60)] = bad if rng.random() < 0.8 else bad[:3] + bad[4:]
        elif i % 5 == 1:
            w[10:12] = ['"blockhead', 'nitwit"']
        out.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(out, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity_held_out(spark, odd):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == bool(truth[i]) for i in held) >= 0.95 * len(held)
    scores = [r.score for r in toxicity.score(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    none = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_scores(spark):
    rng = random.Random(5)
    stems = [["ab", "cd", "ef"], ["uv", "wx", "yz"]]
    texts = [" ".join("".join(rng.choice(stems[i % 2]) for _ in range(rng.randint(1, 3))) for _ in range(80)) for i in range(300)]
    data = [*enumerate(texts), (300, None), (301, ""), (302, "Zz " * 5), (3, texts[3]), (None, "ab")]
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, block int").withColumn("train", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2)
    got = mixing.score(df).collect()
    assert len(got) == len(data)
    count, tokens = collections.Counter(), []
    for d, t in data:
        w = [*SPACE.findall((t or "").translate(UPPER)), None]
        train = zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2
        tokens.append((d, w, train))
        if train:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if d is None else d, not t, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for d, w, t in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert mixing.score(df.where("false")).count() == 0


def test_held_out_texts_teach_nothing(spark):
    """The score of a text stays the same whatever the held-out rows are and however the words are dealt out."""
    rng = random.Random(15)
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(200) if i not in train]
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    data = [(i, " ".join(word("abcdef") for _ in range(60)), True) for i in train] + [(held[0], "abc fed cab zz", False)]
    more = [(i, " ".join(word("\u4e2dxyz0123") for _ in range(300)), False) for i in held[1:]]
    got = []
    for some, parts in ((data, "4"), (data + more, "4"), (data, "96")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows_ = mixing.score(spark.createDataFrame(some, "doc_id long, text string, train boolean").coalesce(1)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        got.append({r.doc_id: r.score for r in rows_ if r.doc_id in {i for i, _, _ in data}})
    assert got[1] == pytest.approx(got[0], abs=1e-5) and got[2] == pytest.approx(got[0], abs=1e-5)


def test_scores_do_not_depend_on_files_and_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 7 != 2).alias("train"))
    one, seven = ({r.doc_id: r.score for r in mixing.score(docs.repartition(n, F.xxhash64("doc_id", F.lit(n)))).collect()} for n in (1, 7))
    assert one == pytest.approx(seven, rel=1e-6) and len(one) == docs.count()


def test_scores_know_word_order_and_frequency(spark):
    """Contexts go across words, and every training occurrence counts."""
    rng = random.Random(16)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(w for _ in range(20) for k in [rng.randrange(30)] for w in names[2 * k : 2 * k + 2]) for _ in range(200)]
    rare = " ".join("".join(rng.choice("xyz") for _ in range(4)) for _ in range(5))
    held = [" ".join(names[:40]), " ".join(names[:40][::-1]), "xxyyx " * 2, rare]
    data = [(i, t + " xxyyx" * 20, True) for i, t in enumerate(texts)] + [(900, rare, True)] + [(1000 + i, t, False) for i, t in enumerate(held)]
    got = {r.doc_id: r.score / r.n_tokens for r in mixing.score(spark.createDataFrame(data, "doc_id long, text string, train boolean").coalesce(1)).collect()}
    assert got[1000] > got[1001] + 0.2 and got[1002] > got[1003]


def test_score_against_brute_force(spark):
    """Counts, learning, mixing and adaptation by plain loops; the slots and the shares of the rounds are those of the operator."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["one new only", "unseen new words new unseen " * 2, "", "abc \u4e2d\u4e2d"]
    data = [(i, t, i % 4 != 1) for i, t in enumerate(texts)]
    blocks = mixing.stored(mixing.blocks_of(spark.createDataFrame(data, "doc_id long, text string, train boolean").repartition(3)), "b")
    starts, n_train = mixing.starts_for(5000), sum(t for *_, t in data)
    blocks, n_words, n_types = mixing.counted(blocks, 256)
    tree, counts = mixing.bit_tables(blocks, starts, n_train)
    weights = mixing.learn_weights(blocks, starts, tree, counts, n_train)
    got = {r.doc_id: r.score for r in mixing.document_scores(blocks, starts, tree, counts, weights, n_words, n_types, n_train).collect()}

    def hashed(w):
        return 1 if w is None else int(mixing.Words(pa.array([w]), mixing.NON_SPACE).hash[0])

    tokens = {d: [*t.split(), None] for d, t, _ in data}
    count = collections.Counter(w for d, _, train in data if train for w in tokens[d])
    assert (n_words, n_types) == (sum(count.values()) - n_train, len(count) - 1)
    seen = collections.defaultdict(lambda: [0.0, 0.0])

    def path(before, w, new):
        """(place in the tree, slots, bit) of each bit."""
        code = mixing.codes(np.array([hashed(w)], np.uint64))
        b = mixing.TokenBits(code, np.array([before], np.uint64), np.array([new]), starts)
        return [(("tree", int(b.tree[0, k])), *(int(s[0, k]) for s in b.slots), int(b.bit[0, k])) for k in range(1 if new else mixing.DEPTH)]

    def spelling(w):
        raw = w.encode()
        b = mixing.SpellingBits(np.frombuffer(raw, np.uint8), np.array([len(raw)]), starts)
        return [(*(int(s[j, k]) for s in b.slots), int(b.bit[j, k])) for j in range(len(raw) + 1) for k in range(8)]

    for d, _, train in data:
        before = 0
        for w in tokens[d] if train else []:
            for k, (*places, bit) in enumerate(path(before, w, False)):
                bit = int(count[w] == 1) if k == 0 else bit
                for x in places:
                    seen[x][bit] += 1
            if count[w] == 1 and w is not None:
                for *places, bit in spelling(w):
                    for x in places:
                        seen[x][bit] += 1
            before = hashed(w)
    more = lambda x: 0.01 if isinstance(x, tuple) else 0.2
    odds = lambda x: math.log(seen[x][1] + more(x)) - math.log(seen[x][0] + more(x))
    bit_ln = lambda z, bit: -math.log1p(math.exp(-z if bit else z))
    sure = lambda x: (x != 0) + (abs(x) > 2.5)

    def without(p, bit):
        return math.log(max(seen[p][1] - bit, 0) + more(p)) - math.log(max(seen[p][0] - (1 - bit), 0) + more(p))

    share = {d: s for row in blocks.collect() for d, s in zip(row.doc_ids, row.shares, strict=True)}
    learned = [np.tile([0.8, 0.15, 0.25], (153, 1)), np.tile([0.25, 0.35, 0.4], (64, 1))]
    for part in mixing.ROUNDS:
        slope, curve = [np.zeros(m.shape) for m in learned], [np.zeros((*m.shape, 3)) for m in learned]

        def add(m, gate, x, bit, slope=slope, curve=curve):
            p = 1 / (1 + math.exp(-float(np.clip(learned[m][gate] @ x, -11, 11))))
            slope[m][gate] += (bit - p) * np.array(x)
            curve[m][gate] += p * (1 - p) * np.outer(x, x)

        for d, _, train in data:
            before = 0
            for w in tokens[d] if train and share[d] in part else []:
                for k, (*places, bit) in enumerate(path(before, w, count[w] == 1)):
                    x = [without(p, bit) for p in places]
                    add(0, k * 9 + sure(x[1]) * 3 + sure(x[2]), x, bit)
                for k, (*places, bit) in enumerate(spelling(w) if count[w] == 1 and w is not None else []):
                    x = [without(p, bit) for p in places]
                    add(1, min(k // 8, 3) * 8 + k % 8 + 32 * (x[2] != 0), x, bit)
                before = hashed(w)
        for m in (0, 1):
            for g in range(len(learned[m])):
                learned[m][g] = np.clip(learned[m][g] + np.linalg.solve(curve[m][g] + mixing.DAMPING * np.eye(3), slope[m][g]), -2, 4)
    assert all(np.abs(a - b).max() < 2e-3 for a, b in zip(learned, weights, strict=True)) and any(np.abs(a[0] - a).max() > 0.1 for a in learned)
    for d, _, _ in data:
        totals, before, used = [math.log(1 - c) if len(tokens[d]) > 1 else 0.0 for c in mixing.CACHES], 0, collections.Counter()
        for place, w in enumerate(tokens[d]):
            ln = 0.0
            for k, (*places, bit) in enumerate(path(before, w, count[w] == 0)):
                x = [odds(p) for p in places]
                z = float(np.dot(weights[0][k * 9 + sure(x[1]) * 3 + sure(x[2])], x))
                ln += bit_ln(z, bit)
            if count[w] == 0:
                for k, (*places, bit) in enumerate(spelling(w)):
                    x = [odds(p) for p in places]
                    ln += bit_ln(float(np.dot(weights[1][min(k // 8, 3) * 8 + k % 8 + 32 * (x[2] != 0)], x)), bit)
            else:
                code = int(mixing.codes(np.array([hashed(w)], np.uint64))[0])
                ln += math.log(count[w] / sum(n for v, n in count.items() if int(mixing.codes(np.array([hashed(v)], np.uint64))[0]) == code))
            for k, c in enumerate(mixing.CACHES):
                totals[k] += ln if c == 0 or place == 0 or w is None else math.log((1 - c) * math.exp(ln) + c * used[w] / place)
            used[w] += 1
            before = hashed(w)
        want = (max(totals) + math.log(sum(math.exp(t - max(totals)) for t in totals) / len(totals))) / math.log(10)
        assert got[d] == pytest.approx(want, rel=1e-4, abs=1e-4), d


def test_weights_learn_from_every_training_text(spark):
    """Each sixteenth of the training texts, also alone, moves the weights; no text is in two rounds."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(300)]
    every = mixing.blocks_of(spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, train boolean").coalesce(1)).collect()
    share = {d: s for row in every for d, s in zip(row.doc_ids, row.shares, strict=True)}
    assert sorted(s for part in mixing.ROUNDS for s in part) == list(range(16)) == sorted(set(share.values()))
    for one in (3, 15):
        data = [(i, t, share[i] == one) for i, t in enumerate(texts)]
        blocks = mixing.stored(mixing.blocks_of(spark.createDataFrame(data, "doc_id long, text string, train boolean").coalesce(1)), "b")
        starts, n_train = mixing.starts_for(5000), sum(t for *_, t in data)
        blocks, *_ = mixing.counted(blocks, 256)
        weights = mixing.learn_weights(blocks, starts, *mixing.bit_tables(blocks, starts, n_train), n_train)
        assert np.abs(weights[0] - mixing.token_mixer().weights).max() > 0.01, one


def test_bit_model_is_a_distribution(spark):
    """At the real rate: the codes of all tokens after any word, with new or not, and all spellings up to a length, sum to one at most."""
    rng = np.random.default_rng(0)
    starts = mixing.starts_for(5000)
    counts = rng.integers(0, 4, (int(starts[-1]), 2)).astype(np.float32)
    tree = mixing.tree_of(rng.integers(0, 2, 1 << mixing.CODE), 1000)
    words = [bytes([a]) for a in range(33, 256)] + [bytes([a, b]) for a in range(33, 256) for b in range(33, 256)]
    spelling, tokens = mixing.spelling_mixer(), mixing.token_mixer()
    bits = mixing.SpellingBits(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]), starts)
    x = [mixing.log_odds(counts)[s] for s in bits.slots]
    spelling.gather(x, bits, np.ones(len(bits.bit), np.float32))
    spelling.step(spelling.sums)
    assert 0 < np.exp(np.add.reduceat(spelling.judge(x, bits), bits.first)).sum() < 1
    total = 0.0
    code = np.arange(1 << mixing.CODE)
    for part in np.split(code, 64):
        bits = mixing.TokenBits(part, np.full(len(part), 77, np.uint64), np.zeros(len(part), bool), starts)
        x = [mixing.log_odds(tree)[bits.tree], *(mixing.log_odds(counts)[s] for s in bits.slots)]
        if not total:
            tokens.gather(x, bits, np.ones(len(part), np.float32))
            tokens.step(tokens.sums)
        total += np.exp(tokens.judge(x, bits)).sum()
    bits = mixing.TokenBits(code[:1], np.full(1, 77, np.uint64), np.ones(1, bool), starts)
    total += np.exp(tokens.judge([mixing.log_odds(tree)[bits.tree], *(mixing.log_odds(counts)[s] for s in bits.slots)], bits)).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_tool_calls(spark):
    calls = [(1, 1, "a", "search", '{"query":"x","n":1}'), (1, 3, "b", "search", '{"n":2,"query":"$a"}'), (1, 5, "c", "compute", '{"query": 5, "more": 1}'), (1, 6, "c", "compute", "{}"), (2, 1, "p", "store", '{"query":"$q"}'), (2, 2, "q", "store", '{"query":"$p"}'), (2, 3, "r", "nothing", "{"), (3, 1, None, "search", None), (3, 2, "z", None, None)]
    results = [(1, 2, "a", "ok"), (1, 9, "a", "late"), (1, 2, "b", "early"), (4, 1, "y", None), (4, 2, None, "n")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = {(x.conv_id, x.call_id): x for x in tool_calls.link(c, r, tool_calls.SCHEMAS).collect()}
    unanswered = [(1, "c"), (2, "p"), (2, "q"), (2, "r"), (3, "z")]
    assert {k: x.status for k, x in got.items()} == {(1, "a"): "linked", (1, "b"): "early", (3, None): "orphan", (4, "y"): "orphan", (4, None): "orphan"} | dict.fromkeys(unanswered, "unanswered")
    assert (got[1, "a"].level, got[1, "b"].level, got[2, "p"].level, got[2, "q"].level) == (0, 1, None, None)
    assert got[1, "a"].n_results == 2 and got[1, "c"].n_calls == 2
    assert got[1, "a"].valid and not got[1, "c"].valid and got[1, "c"].errors == "unexpected more; query is no string"
    assert got[2, "r"].errors == "broken JSON" and json.loads(got[1, "b"].json) == {"id": "b", "name": "search", "arguments": {"query": "$a", "n": 2}, "result": "early"}
    assert got[1, "b"].json == '{"arguments":{"n":2,"query":"$a"},"id":"b","name":"search","result":"early"}'
    assert tool_calls.link(c.where("false"), r.where("false"), {}).count() == 0


def test_tool_calls_survive_odd_arguments(spark):
    deep = "[" * 5000 + "]" * 5000
    odd = ['{"query":1e999,"n":1}', '{"query":"\\ud800","n":1}', '{"query":' + deep + ',"n":1}', "[" * 100_000, '{"query":' + "9" * 5000 + ',"n":1}', "NaN", "null", "", None, '{"x":"$\\udfff","\\udc00":1}', '{"query":"' + "long " * 200_000 + '","n":true}']
    c = spark.createDataFrame([(1, k, f"c{k}", "search", a, 7) for k, a in enumerate(odd)] + [(None, 1, "z", "search", "{}", 7)], "conv_id long, turn long, call_id string, name string, arguments string, level int")
    r = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = {x.call_id: x for x in tool_calls.link(c, r, tool_calls.SCHEMAS).collect()}
    assert len(got) == len(odd) + 1 and [k for k, x in got.items() if x.valid] == ["c1"]
    assert all(got[f"c{k}"].errors == "broken JSON" for k in (0, 3, 4, 5, 7, 8)) and "c2" in got
    assert got["c1"].json == '{"arguments":{"n":1,"query":"\\ud800"},"id":"c1","name":"search","result":null}' and got["z"].level is None
    assert tool_calls.check({"a": 1, "b": None}, {"properties": {"a": {"type": "date"}, "b": {"type": ["string", "null"]}}}) == ["a is no date"]


def test_tool_call_order_against_brute_force(spark):
    """Levels and positions of random graphs, by one task and by rounds of joins; pieces put together give the order."""
    rng = random.Random(19)
    calls = []
    for conv in range(12):
        n = rng.randint(1, 14)
        for k in range(n):
            back = conv % 3 == 0  # these may wait on each other
            deps = [rng.randrange(n if back else max(k, 1)) for _ in range(rng.randint(0, 2))] if k or back else []
            calls.append((conv, rng.randint(0, 5), f"c{k}", "search", json.dumps({"query": [f"$c{d}" for d in deps], "n": 1, "x": "$none"})))
    want = {}
    for conv in range(12):
        own = {c: (t, {d[1:] for d in json.loads(a)["query"]}) for v, t, c, _, a in calls if v == conv}
        level = {}
        while new := [c for c, (_, d) in own.items() if c not in level and all(x in level for x in d if x in own)]:
            level |= {c: max((level[x] + 1 for x in own[c][1] if x in own), default=0) for c in new}
        for p, c in enumerate(sorted(level, key=lambda c: (level[c], own[c][0], c))):
            want[conv, c] = (level[c], p)
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string")
    linked = tool_calls.link(c, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), tool_calls.SCHEMAS)
    got = linked.collect()
    assert {(r.conv_id, r.call_id): (r.level, r.position) for r in got if r.level is not None} == want and len(got) == len(calls)
    small = c.where("conv_id < 5").select("conv_id", "call_id", "turn", F.expr("transform(from_json(get_json_object(arguments, '$.query'), 'array<string>'), x -> substring(x, 2))").alias("deps"))
    assert {(r.conv_id, r.call_id): (r.level, r.position) for r in tool_calls.levels(small, 5).collect() if r.level is not None} == {k: v for k, v in want.items() if k[0] < 5}
    pieces = sorted(tool_calls.serialised(linked, 4).collect(), key=lambda r: (r.conv_id, r.piece))
    for conv in range(12):
        ids = [x["id"] for r in pieces if r.conv_id == conv for x in json.loads(r.json)]
        assert ids == sorted((k[1] for k in want if k[0] == conv), key=lambda c: want[conv, c][1])


def test_large_conversations_are_ordered_by_jumps(spark):
    """Chains, trees, joins and cycles, by joins alone, as one task orders them; a chain takes a logarithm of rounds."""
    rng = random.Random(31)
    convs = {
        0: {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(150)},
        1: {f"c{i}": [f"c{rng.randrange(i)}"] if i else [] for i in range(60)},
        2: {f"c{i}": sorted({f"c{rng.randrange(i)}" for _ in range(rng.randrange(4))}) if i else [] for i in range(60)},
        3: {"a": ["c"], "b": ["a"], "c": ["b"], "d": ["c"], "e": ["d", "f"], "f": [], "g": ["f"], "h": ["h"], "i": ["g", "f"], "j": ["i"], "k": ["nowhere", "j"]},
        4: {f"c{i}": [f"c{i - 1}", f"c{i // 2}"] if i > 1 else [] for i in range(20)},
        5: {"only": []},
    }
    rows = [(v, c, rng.choice([None, 1, 2, 5000]), deps) for v, calls in convs.items() for c, deps in calls.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, deps array<string>")
    want = {}
    for v in convs:
        own = [r for r in rows if r[0] == v]
        for r, level, position in zip(own, *tool_calls.order([r[1] for r in own], [r[2] for r in own], [r[3] for r in own]), strict=True):
            if level is not None:
                want[v, r[1]] = (level, position)
    assert {(r.conv_id, r.call_id): (r.level, r.position) for r in tool_calls.rounds(calls).collect()} == want
    assert want[0, "c149"] == (149, 149) and (3, "d") not in want and (3, "e") not in want and (3, "k") in want


def test_conversation_calls_keep_the_whole_text(spark):
    texts = ["short", 'a "quoted"\n\\ part ' * 5, "\u4e2d\U0001f600 " * 30, "$call_1_0" + "x" * 60, "word " * 60_000]
    turns = [(k, turn, role, t) for k, t in enumerate(texts) for turn, role in ((0, "user"), (1, "assistant"))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in tool_calls.link(*tool_calls.conversation_calls(df), tool_calls.SCHEMAS).collect()}
    for k, t in enumerate(texts):
        call = json.loads(got[k].json)
        assert (call["arguments"]["query"], call["result"], got[k].status) == (t, t, "linked")


def test_warc(spark, small):
    columns, want = sql_rows(small, warc_derivatives.OP2_SQL)
    got = warc_derivatives.op2(spark, small).toPandas()
    assert sorted(got.columns) == columns and rows(got) == want
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", '<title>T</title><a href="l">a &amp; b</a>', "x")], "page_id long, url string, html string, block string")
    d = warc_derivatives.derive(warc_derivatives.responses(pages)).collect()
    assert len(d) == 4 and {x.block for x in d if x.warc_type == "conversion"} == {"", "Ta & b"}
    assert all(x.record.startswith("WARC/1.1\r\n") and f"WARC-Refers-To: {x.refers_to}" in x.record for x in d)


def test_warc_keeps_the_source_headers(spark):
    head = ["HTTP/1.1 301 Moved", "Server: x/1", "Set-Cookie: a=1; b", "content-type:text/html", "SET-COOKIE: c=2", "Location: http://u/?a: b", "X-Long: one", "\t two", "Content-Type: text/plain", "X-Empty:"]
    blocks = ["\r\n".join(head) + "\r\n\r\nServer: not a header", "HTTP/1.0 204 No Content\r\nDate: d", "\r\n\r\nbody", "HTTP/1.1 200 OK\r\n\r\nb"]
    rows_ = [(k, f"<id{k}>", "u", "d", b, "WARC-IP-Address: 1.2.3.4\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>" if k == 0 else None) for k, b in enumerate(blocks)]
    df = spark.createDataFrame(rows_, "source long, record_id string, target_uri string, date string, block string, warc_header string")
    got = {r.source: r.block.split("\r\n") for r in warc_derivatives.derive(df).where("warc_type = 'metadata'").collect()}
    kept = lambda k, name: [x.split(": ", 1)[1] for x in got[k] if x.startswith(name + ": ")]
    assert kept(0, "source-status") == ["301"] and kept(0, "source-content-type") == ["text/html"]
    assert kept(0, "source-header") == ["Server: x/1", "Set-Cookie: a=1; b", "SET-COOKIE: c=2", "Location: http://u/?a: b", "X-Long: one two", "Content-Type: text/plain", "X-Empty:"]
    assert kept(0, "source-warc-header") == ["WARC-IP-Address: 1.2.3.4", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"]
    assert kept(1, "source-header") == ["Date: d"] and kept(1, "source-content-type") == [""]
    assert kept(2, "source-header") == kept(3, "source-header") == []
    assert len(warc_derivatives.derive(df.drop("warc_header")).collect()) == 8


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert 0 < len(last) == docs.count() and all(r.n_tokens == len(r.ids) for r in last)


def test_rules_are_tried_in_order(spark):
    """Two causes of bad texts give two rules; the expression gives what trying the rules one by one gives."""
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(80)]
        if i % 5 == 0:
            words = [w + "***" for w in words]
        elif i % 5 == 1:
            words = [w.upper() for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 > 1)))
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = decision_list.fit(d, m)
    assert len(rules) >= 2
    mixed = [*docs, (900, "A***!!! " * 60), (901, None), (902, "plain words here " * 30)]
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    stats = {r.doc_id: r.asDict() for r in decision_list._with_features(decision_list.base_statistics(df)).collect()}

    def first(x):
        for k, rule in enumerate(rules, 1):
            if all(x[f"f_{f}"] >= at if side == ">=" else x[f"f_{f}"] < at for f, side, at in rule):
                return k
        return 0

    for r in decision_list.judged(df, rules).collect():
        x = stats[r.doc_id]
        failed = x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]
        assert (r.base_failed, r.rule, r.kept) == (failed, 0 if failed else first(x), not failed and first(x) == 0)


def test_growing_against_brute_force(spark):
    """The first condition is the one with the highest gain of all thresholds."""
    rng = random.Random(22)
    data = [(int(rng.random() < 0.3), *[rng.randint(0, 30) for _ in decision_list.FEATURES]) for _ in range(400)]
    data = [(b, *(x + 12 * b if k == 2 else x for k, x in enumerate(xs))) for b, *xs in data]
    points = {f: sorted({r[k + 1] for r in data})[::3] for k, f in enumerate(decision_list.FEATURES)}
    names = ", ".join(f"f_{f} long" for f in decision_list.FEATURES)
    df = spark.createDataFrame(data, f"bad int, {names}")
    bins = [sum((F.when(F.col(f"f_{f}") >= t, 1).otherwise(0) for t in ts), F.lit(0)).alias(f"b_{f}") for f, ts in points.items()]
    got = decision_list._counts(df.select("*", *bins), points)
    for (f, side, at), n in got.items():
        k = decision_list.FEATURES.index(f) + 1
        hit = [r[0] for r in data if (r[k] >= at if side == ">=" else r[k] < at)]
        assert n == (sum(hit), len(hit) - sum(hit))


def plain_rules(rows, max_rules=6, max_conditions=3, min_rows=15, purity=0.9):
    """Sequential covering over a list of dicts: grown by the best gain, pruned on the held back rows."""
    grow, prune = ([r for r in rows if r["held"] == h] for h in (0, 1))
    bad = [r for r in grow if r["bad"]]
    ranks = lambda some, f, n: {math.floor(x + 1e-6) for x in np.percentile([r[f] for r in some], [100 * k / n for k in range(n + 1)])} if some else set()
    thresholds = {f: sorted(ranks(grow, f, 12) | ranks(bad, f, 10)) for f in decision_list.FEATURES}
    met = lambda r, rule: all(r[f] >= t if side == ">=" else r[f] < t for f, side, t in rule)
    two = lambda some: (sum(r["bad"] for r in some), sum(1 - r["bad"] for r in some))
    rules = []
    while len(rules) < max_rules and two(grow)[0] >= min_rows:
        rule = []
        while len(rule) < max_conditions:
            own = [r for r in grow if met(r, rule)]
            p, n = two(own)
            if not n:
                break
            best = None
            for f in decision_list.FEATURES:
                for t in thresholds[f]:
                    for side in ("<", ">="):
                        cp, cn = two([r for r in own if met(r, [(f, side, t)])])
                        gain = cp * (math.log2(cp / (cp + cn)) - math.log2(p / (p + n))) if cp >= min_rows else 0
                        if gain > (best[0] if best else 0.0) + 1e-9:
                            best = gain, (f, side, t)
            if not best:
                break
            rule.append(best[1])
        if not rule:
            break
        kept = []
        for k in range(1, len(rule) + 1):
            hp, hn = two([r for r in prune if met(r, rule[:k])])
            kept.append(((hp - hn) / (hp + hn) if hp + hn else -1.0, -k, hp, hn))
        worth, k, hp, hn = max(kept)
        rule = rule[:-k]
        if hp + hn == 0 or hp / (hp + hn) < purity:
            break
        rules.append(rule)
        grow, prune = ([r for r in some if not met(r, rule)] for some in (grow, prune))
    return rules


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_learning_against_brute_force(spark, seed):
    """Growing, pruning, the order of the rules and where the search ends, for data in any number of partitions."""
    rng = random.Random(seed)
    data = []
    for _ in range(900):
        kind = rng.choice(["good"] * 5 + ["marks", "long", "digits and upper"])
        r = {f: rng.randint(0, 40) for f in decision_list.FEATURES} | {"bad": int(kind != "good" and rng.random() < 0.97), "held": int(rng.random() < 0.33)}
        r["mark_rate"] += 60 * (kind == "marks")
        r["n_words"] += 100 * (kind == "long")
        if kind == "digits and upper":
            r["digit_rate"], r["upper_rate"] = 30 + r["digit_rate"], 35 + r["upper_rate"] // 2
        data.append(r)
    names = list(decision_list.FEATURES)
    df = spark.createDataFrame([(r["bad"], r["held"], *(r[f] for f in names)) for r in data], "bad int, held int, " + ", ".join(f"f_{f} long" for f in names))
    want = plain_rules(data)
    assert decision_list.learn(df.repartition(seed)) == want and len(want) >= 2
    got = df.select(decision_list.case_expression(want).alias("rule"), *df.columns).collect()
    for r in got:
        first = next((k for k, rule in enumerate(want, 1) if all(r[f"f_{f}"] >= t if side == ">=" else r[f"f_{f}"] < t for f, side, t in rule)), 0)
        assert r.rule == first


def test_stages_with_odd_rows(spark, small, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and an empty table in every stage."""
    import corpus_pipeline

    good = " ".join(f"word{i % 97} then{i % 89}" for i in range(200))
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 100").first().text
    data = [(1, None), (2, ""), (3, " \n"), (4, good), (4, good), (5, good + " x"), (None, good + " y"), (6, "z" * 200_000), (7, good[::-1] + " " + item), (None, None)]
    extra = ("score", "predicted", "kept", "rule", "n_words", "label", "key", "h", "n", "hit_spans", "items", "n_tokens", "ids")
    df = spark.createDataFrame([(*r, *range(len(extra))) for r in data], "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    stages = dict(corpus_pipeline.STAGES)
    got = {}
    for name, stage in stages.items():
        out = stage(spark, df, small)
        if name != "byte_level_bpe":
            assert out.columns == df.columns, name
        got[name] = out.collect()
        assert stage(spark, df.where("false"), small).count() == 0, name
    ids = lambda name: sorted((-1 if r.doc_id is None else r.doc_id for r in got[name]))
    assert not {1, 2, 3, 6} & set(ids("quality_rules"))
    assert ids("ngram_jaccard_join") == [-1, 1, 2, 3, 4, 6, 7]
    assert ids("benchmark_decontamination") == [-1, -1, 1, 2, 3, 4, 4, 5, 6]
    assert {1, 2, 3} <= set(ids("toxicity")) and len(got["byte_level_bpe"]) == len(data)


def test_pipeline_run_against_brute_force(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = mixing.stored(stage(spark, docs, small), "by-hand")
    texts = {r.doc_id: (r.text or "").translate(UPPER) for r in docs.collect()}
    words = {i: SPACE.findall(t) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 180 * n >= 80 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = alnum.findall((r.text or "").translate(UPPER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    want = sorted(i for i in order if root(i) == i and not dirty(alnum.findall(texts[i])))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) == want and want


def test_conflicting_labels_are_the_worse_ones(spark):
    docs = spark.createDataFrame([(i, "word " * 60 + ("vile" if i % 2 else "fine")) for i in range(60)], "doc_id long, text string")
    marks = [(i, i % 2, 1 - i % 2) for i in range(60)]
    twice = spark.createDataFrame([*marks, *[(i, 0, 1) for i in range(60)]], "doc_id long, toxic int, quality int")
    once = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    for labels in (twice, twice.orderBy(F.desc("doc_id"), "toxic")):
        a, b = toxicity.fit(docs, labels), toxicity.fit(docs, once)
        assert (a.lexicon.words, a.lexicon.stems, a.weights, a.prior) == (b.lexicon.words, b.lexicon.stems, b.weights, b.prior) and "vile" in a.lexicon.words
        assert decision_list.fit(docs, labels) == decision_list.fit(docs, once)


def test_quality_stage_judges_each_row_by_its_text(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"word{i}" for i in range(80))
    rows = spark.createDataFrame([(1, text, 0), (1, "too short", 1), (None, text, 2), (None, None, 3), (1, text, 0)], "doc_id long, text string, n_words int")
    assert sorted(r.n_words for r in decision_list.stage(spark, rows, str(tmp_path)).collect()) == [0, 0, 2]
    assert decision_list.stage(spark, rows.limit(0), str(tmp_path)).count() == 0


def test_tool_schemas_with_nulls():
    for schema in ({}, {"properties": None, "required": None}, {"properties": {"a": None}}):
        assert tool_calls.check({}, schema) == []
    assert tool_calls.check({"a": 1}, {"properties": {"a": None}}) == [] and tool_calls.check({"b": 1}, {"properties": None}) == ["unexpected b"]
    assert tool_calls.check({"a": 1}, {"properties": {"a": {"type": None, "enum": None}}}) == []
