r"""Quality rules (operator 4): a learned decision list, in SQL expressions only.

Spark computes a document's statistics. From the statistics of a bounded sample of labelled
documents, sequential covering grows conjunctions of thresholds that single out bad
documents (by information gain, on two thirds of the sample), prunes each on the last
third, keeps it only if it is precise there, takes away what it covers, and goes on. The
list comes back as one ordered Spark conditional expression.

Words are runs of [^\x20\x09-\x0D]; null and empty texts have none. A document of fewer than
50 words, or with more than half of its words in repeated 3-word windows, fails whatever the
rules say. Null labels are not looked at, of several labels of a doc_id the least counts, of
several texts of a doc_id rules are learned from the least; without labels only those two
limits hold.
Repeated rows and other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, table

BLANKS, SYMBOLS, CAPITALS, DIGITS = " \t\n\x0b\x0c\r", "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Labelled documents that rules are learned from at most, and what a rule must reach on held-out ones.
SAMPLE, PRECISION, SUPPORT = 6000, 0.97, 8
FEATURES = ("n_words", "chars_per_word", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "digit_share", "bang_share", "distinct_share", "words_per_line")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(s: Column) -> Column:
        """From (gram, place) in order: the places whose gram has a neighbour of the same."""
        gram = lambda k: F.get(s, k)["g"]
        twice = F.filter(s, lambda x, k: (gram(k + 1) == x["g"]) | F.when(k > 0, gram(k - 1) == x["g"]).otherwise(F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    def count(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_let(_let(ordered, places), covered))

    return F.when(n < 4, F.lit(0)).otherwise(_let(grams, count))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and a struct _stats of FEATURES."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = once(df, "_words", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""))
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, BLANKS) > 0)
    counted = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = once(out, "_s", F.struct(
        F.size("_words").cast("long").alias("_n"),
        _without(t, BLANKS).cast("long").alias("_chars"),
        (F.length(t) - _without(t, SYMBOLS)).cast("long").alias("_symbols"),
        counted.alias("_lines"),
        _repeated(F.col("_words")).cast("long").alias("_repeat"),
        (F.length(t) - _without(t, CAPITALS)).alias("_caps"),
        (F.length(t) - _without(t, DIGITS)).alias("_digits"),
        (F.length(t) - _without(t, "!")).alias("_bangs"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
    )).select(*df.columns, "_s.*")
    n, chars = F.greatest("_n", F.lit(1)), F.greatest("_chars", F.lit(1))
    values = (F.col("_n"), F.col("_chars") / n, F.col("_symbols") / chars, F.col("_lines.dup") / F.greatest("_lines.n", F.lit(1)), F.col("_repeat") / n, F.col("_caps") / chars, F.col("_digits") / chars, F.col("_bangs") / chars, F.col("_distinct") / n, F.col("_n") / F.greatest("_lines.n", F.lit(1)))
    keep = [F.col(c) for c in df.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_stats")]
    base = (F.col("_n") < 50) | (100 * F.col("_repeat") > 50 * F.col("_n"))
    return out.select(*keep, F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_lines.dup").cast("long").alias("n_dup_lines"), F.col("_repeat").alias("n_repeat_words"), base.alias("base_failed"), F.struct(*[v.cast("double").alias(f) for f, v in zip(FEATURES, values, strict=True)]).alias("_stats"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, stats: str = "_stats") -> Column:
        c = F.col(f"{stats}.{self.feature}")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), bool))


def _grown(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition of most gain while good documents are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while (inside & ~bad).any() and len(rule) < 4:
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for f, name in enumerate(FEATURES):
            v = x[inside, f]
            seen = np.unique(v)
            seen = seen[np.unique(np.linspace(0, len(seen) - 1, 65).astype(int))]
            for cut in ((seen[1:] + seen[:-1]) / 2).tolist():
                for above in (True, False):
                    hit = v > cut if above else v <= cut
                    p, n = (hit & bad[inside]).sum(), (hit & ~bad[inside]).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, above, cut), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def learn(x: np.ndarray, bad: np.ndarray, precision: float = PRECISION, support: int = SUPPORT, most: int = 12) -> list[Rule]:
    """Ordered rules, each of which means: bad. x: a row of FEATURES for each labelled document."""
    third = np.arange(len(x)) % 3 == 2
    grow, prune, rules = ~third, third, []
    while len(rules) < most and (bad & grow).sum() >= support:
        rule = _grown(x[grow], bad[grow])
        worth = lambda r: ((m := _covers(r, x[prune])) & bad[prune]).sum() - (m & ~bad[prune]).sum() if r else -1
        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)), default=())
        hit = _covers(rule, x) if rule else np.zeros(len(x), bool)
        held, grown = hit & prune, hit & grow
        if not rule or (bad & held).sum() < max(1, support // 3) or (bad & held).sum() < precision * held.sum() or (bad & grown).sum() < precision * grown.sum():
            break
        rules.append(rule)
        x, bad, grow, prune = x[~hit], bad[~hit], grow[~hit], prune[~hit]
    return rules


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules from the labelled documents of least hash, ``sample`` of them at most."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label")).orderBy(F.xxhash64("_key"), "_key").limit(sample)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key").groupBy("_key", "_label").agg(F.min("text").alias("text"))
    rows = statistics(texts).select("_key", "_label", "base_failed", "_stats.*").collect()
    rows = [r for r in rows if not r["base_failed"]]
    rows.sort(key=lambda r: (r["_key"], r["_label"]))
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r["_label"] == 0 for r in rows], bool))


def verdict(rules: list[Rule], stats: str = "_stats") -> Column:
    """The decision list: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        holds = reduce(lambda a, b: a & b, (c.column(stats) for c in rule))
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with their statistics and ``kept``."""
    rules = learned(docs, labels, key, text, **more)
    return statistics(docs.drop("kept"), text).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' statistics and verdicts."""
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
