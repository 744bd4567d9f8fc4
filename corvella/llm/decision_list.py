"""Quality rules: a decision list learned from labelled statistics and emitted as one Spark CASE expression.

Sequential covering: a rule is a conjunction of thresholds on statistics of a text. Grow: add the threshold
that gains most (FOIL's measure) until the rule covers no good row or the conjunction is full; prune: on held
back rows, drop conditions from the end while the rule's worth does not fall; then remove the covered rows
and start again. Rules that are not pure enough on the held back rows end the search. All counting is done
by DataFrame aggregations; the driver sees only counts per statistic and threshold.

Rows: a null or empty text has no words and fails the base rule; statistics are never null; equal rows get
equal verdicts; a doc_id with several labels is bad if one says so; with no labelled rows the list is empty and keeps all that passes the base rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, crc32_mod, stored, table

_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 20_000  # labelled rows that the list is learned from, by hash of doc_id; the bound of the fit

#: name, steps between thresholds. Rates are in thousandths of the number of words or characters.
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "digit_rate")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and counts for the rules, in JVM expressions only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, _SPACES)) > 0)
    d = d.select(
        "doc_id",
        words.alias("w"),
        lines.alias("lines"),
        F.length("text").alias("n_chars"),
        F.length(_without(F.col("text"), _SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), UPPER))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(_without(F.col("text"), "!?"))).cast("long").alias("n_marks"),
        (F.length("text") - F.length(_without(F.col("text"), "0123456789"))).cast("long").alias("n_digits"),
    )
    # Windows of three words as hashes; a window is repeated if its hash is at another place too.
    size = F.size("w")
    three = F.when(size >= 3, F.transform(F.slice("w", 1, F.greatest(size - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    d = d.select("*", three.alias("t"))
    d = d.select("*", (F.size("t") > F.size(F.array_distinct("t"))).alias("some"))
    by_hash = F.sort_array(F.transform("t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    repeated = F.filter("s", lambda x, i: same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1)))
    d = d.select("*", F.when(F.col("some"), by_hash).alias("s"))
    d = d.select("*", F.when(F.col("some"), F.sort_array(F.transform(repeated, lambda x: x["i"]))).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.select(
        "doc_id",
        size.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_upper",
        "n_marks",
        "n_digits",
        F.size("lines").cast("long").alias("n_lines"),
    )


def features() -> dict[str, Column]:
    """Whole-number statistics that the rules test."""
    rate = lambda a, b: F.floor(F.lit(1000) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "n_words": F.col("n_words"),
        "mean_word": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"),
        "mark_rate": rate("n_marks", "n_words"),
        "digit_rate": rate("n_digits", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, str, int]


def holds(condition: Condition) -> Column:
    name, side, at = condition
    return F.col(f"f_{name}") >= at if side == ">=" else F.col(f"f_{name}") < at


def all_hold(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & holds(c)
    return out


def _counts(rows: DataFrame, thresholds: dict[str, list[int]]) -> dict[Condition, tuple[int, int]]:
    """(bad, good) rows under every single condition: counts by statistic and interval, summed from either end."""
    cells = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"b_{f}").alias("b")) for k, f in enumerate(FEATURES)])).alias("x"))
    got = {(r.f, r.b): (r.p, r.n) for r in cells.groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()}
    out = {}
    for k, f in enumerate(FEATURES):
        bins = [got.get((k, b), (0, 0)) for b in range(len(thresholds[f]) + 1)]
        for j, t in enumerate(thresholds[f]):
            out[f, "<", t] = tuple(map(sum, zip(*bins[: j + 1], strict=True)))
            out[f, ">=", t] = tuple(map(sum, zip(*bins[j + 1 :], strict=True)))
    return out


def learn(labelled: DataFrame, max_rules: int = 6, max_conditions: int = 3, min_rows: int = 15, purity: float = 0.9) -> list[list[Condition]]:
    """labelled: f_<statistic> columns, bad 0/1 and held 0/1 (rows for pruning). Returns the rules, in order."""
    grow, prune = labelled.where("held = 0"), labelled.where("held = 1")
    # Exact, so that thresholds do not depend on how the rows are split.
    at = lambda f, n: F.transform(F.percentile(f"f_{f}", [k / n for k in range(n + 1)]), lambda x: F.floor(x + 1e-6)).alias(f)
    points = grow.select(*[at(f, 12) for f in FEATURES]).first()
    bad_points = grow.where("bad = 1").select(*[at(f, 10) for f in FEATURES]).first()
    thresholds = {f: sorted({*(points[f] or []), *(bad_points[f] or [])}) for f in FEATURES}
    bins = [sum((F.when(F.col(f"f_{f}") >= t, 1).otherwise(0) for t in ts), F.lit(0)).alias(f"b_{f}") for f, ts in thresholds.items()]
    grow = stored(grow.select("*", *bins), "grow")
    rules: list[list[Condition]] = []
    for _ in range(max_rules):
        total = grow.agg(F.count_if(F.col("bad") == 1).alias("p"), F.count_if(F.col("bad") == 0).alias("n")).first()
        if total.p < min_rows:
            break
        rule: list[Condition] = []
        p, n = total.p, total.n
        while n and len(rule) < max_conditions:
            entropy = math.log2(p / (p + n))
            best, worth = None, 0.0
            for c, (cp, cn) in _counts(grow.where(all_hold(rule)), thresholds).items():
                if cp >= min_rows and (gain := cp * (math.log2(cp / (cp + cn)) - entropy)) > worth + 1e-9:
                    best, worth = (c, cp, cn), gain
            if best is None:
                break
            rule.append(best[0])
            p, n = best[1:]
        if not rule:
            break
        heads = prune.agg(*[F.struct(F.count_if(all_hold(rule[: k + 1]) & (F.col("bad") == 1)).alias("p"), F.count_if(all_hold(rule[: k + 1]) & (F.col("bad") == 0)).alias("n")).alias(f"h{k}") for k in range(len(rule))]).first()
        value = [((h.p - h.n) / (h.p + h.n) if h.p + h.n else -1.0, h.p, h.n) for h in heads]
        keep = max(range(len(rule)), key=lambda k: (value[k][0], -k))
        rule = rule[: keep + 1]
        _, hp, hn = value[keep]
        if hp + hn == 0 or hp / (hp + hn) < purity:
            break
        rules.append(rule)
        grow, prune = grow.where(~all_hold(rule)), prune.where(~all_hold(rule))
    return rules


def case_expression(rules: list[list[Condition]]) -> Column:
    """The list as an ordered expression: the number of the first rule that holds, 0 for none."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(all_hold(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def _with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[c.alias(f"f_{f}") for f, c in features().items()])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Learns the list from at most sample_rows labelled documents."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min(F.col("quality").cast("int"))).alias("bad"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")
    # Statistics are written before any filter on them: a filter pushed below would repeat their expressions.
    rows = _with_features(stored(base_statistics(texts), "statistics")).where(~base_failed()).select("doc_id", *[f"f_{f}" for f in FEATURES])
    rows = stored(rows.join(F.broadcast(marks), "doc_id").select("*", (crc32_mod(F.col("doc_id"), 3) == 0).cast("int").alias("held")), "labelled")
    return learn(rows)


def judged(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    rows = _with_features(base_statistics(docs)).select("*", base_failed().alias("base_failed"), case_expression(rules).alias("rule"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), F.when(~F.col("base_failed"), F.col("rule")).otherwise(0).alias("rule"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose own text fails the base rule or meets a learned rule; rows are told apart by doc_id and text."""
    rules = fit(docs, table(spark, sf_dir, "labels"))
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    kept = stored(judged(docs.select(key.alias("doc_id"), "text"), rules), "judged").where("kept").select(F.col("doc_id").alias("__key")).distinct()
    return docs.join(kept, key == F.col("__key"), "left_semi")
