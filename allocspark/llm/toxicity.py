"""Toxicity scores (operator 10): boosted trees over dense features, calibrated.

The model is fitted on the driver on a bounded sample of labelled documents of the training
folds, dealt into three parts by their ids and fitted crosswise, so that every document
serves each step. A lexicon holds words and word beginnings whose documents are toxic far
more often than others; a part's features are made with the lexicon of the other two. The
trees of two parts give the sums of the third, and an isotonic map from all these sums to
probabilities calibrates. Lexicon and trees of all parts score every document where it
lies. Labels, language, source and id are no inputs.

Features: share and number of lexicon words, their largest weight, how near they come to a
second-person pronoun, capitals, punctuation, obfuscated spellings, and words that are in
the lexicon only once spelled plainly. A null or empty text has the features of no words.
Null labels are not looked at, of several labels of a doc_id the toxic one counts, of several
texts of a doc_id the model learns from the least; without labels of both kinds in any two
parts every score is the share of toxic labels (0 without any). Repeated rows and null ids
are scored as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, table, texts_of

#: Labelled documents at most that the model is fitted on, parts of them; lexicon words at most, toxic documents that a word needs (fewer where there are under 100); score from which a document counts as toxic.
SAMPLE, PARTS, LEXICON, SUPPORT, TOXIC = 18_000, 3, 1000, 5, 0.7
#: Lengths of the word beginnings that the lexicon may hold, written with a star.
STEMS = range(4, 9)
PRONOUNS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus su vosotros".split())
PLAIN = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
NEAR = 6


def plain(word: str) -> str:
    """A word without look-alike digits and signs and without letters held down."""
    return re.sub(r"(.)\1{2,}", r"\1", word.translate(PLAIN).replace("*", ""))


def weight(word: str, lexicon: dict[str, float]) -> float:
    """The largest weight of the word and its beginnings, 0 without any."""
    return max([lexicon.get(word, 0.0)] + [lexicon.get(word[:k] + "*", 0.0) for k in STEMS if len(word) >= k])


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features of one text."""
    words = WORD.findall(text.lower())
    n = len(words)
    value = {w: weight(w, lexicon) for w in set(words)}
    hits = [i for i, w in enumerate(words) if value[w]]
    odd = [w for w in set(words) if not w.isalpha() and any(c.isalpha() for c in w)]
    unmasked = {w for w in odd if not value[w] and weight(plain(w), lexicon)}
    masked = sum(w in unmasked for w in words) if unmasked else 0
    close = sum(any(w in PRONOUNS for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    weights = [value[words[i]] for i in hits]
    letters = max(1, len(text))
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    return [len(hits) / max(1, n), len(hits), max(weights, default=0.0), sum(weights) / max(1, n), len({words[i] for i in hits}), close / max(1, n), close, capitals / letters, text.count("!") / letters, text.count("?") / letters, len(odd) / max(1, n), masked, float(np.log1p(n))]


def fold(key: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")))


@dataclass
class Trees:
    """Gradient-boosted trees of a fixed depth on binned features, for the logistic loss."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique((u[1:] + u[:-1]) / 2)[:: max(1, len(u) // 48)] if len(u := np.unique(c)) > 1 else np.zeros(0) for c in x.T]
        b = self.binned(x)
        bins = max(len(e) for e in self.edges) + 1
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        total = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, bins)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                for f in range(x.shape[1]):
                    at = (node - first) * bins + b[:, f]
                    g, h = (np.cumsum(np.bincount(at, v, width * bins).reshape(width, bins), axis=1) for v in (grad, hess))
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    gain[(h < 1) | (h[:, -1:] - h < 1)] = 0
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best + 1e-9
                    best[better] = gain[np.arange(width), k][better]
                    feature[first : first + width][better] = f
                    cut[first : first + width][better] = k[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + 1)
            self.trees.append((feature, cut, value))
            total += value[leaf]
        return self

    def sums(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        total = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return total


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising map from sums to probabilities: neighbours out of order are pooled; each pool has half a good and half a bad document more."""
    order = np.argsort(s, kind="stable")
    pools: list[list[float]] = []
    for x, v in zip(s[order].tolist(), y[order].tolist(), strict=True):
        pools.append([x, v, 1.0])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] == pools[-1][0]):
            a, c, n = pools.pop()
            pools[-1] = [max(a, pools[-1][0]), pools[-1][1] + c, pools[-1][2] + n]
    return np.array([p[0] for p in pools]), np.maximum.accumulate([(p[1] + 0.5 * y.mean()) / (p[2] + 0.5) for p in pools])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    points: tuple[np.ndarray, np.ndarray] | None
    share: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(len(texts), len(features("", {})))
        return np.clip(np.interp(self.trees.sums(x), *self.points), 0, 1)


def _rows(docs: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """part, y and features of sampled documents (part, y, text), each with its part's lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicons[p]) for p, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["part", "y", "x"])

    return docs.select("part", "y", "text").mapInArrow(run, "part int, y int, x array<double>")


def _stems(k: int) -> Column:
    """The first k letters of each word that has so many, and a star."""
    return F.transform(F.filter("words", lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents of the training folds that have the least hashes."""
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y")).where(fold(F.col("k")) % 3 != 1)
    chosen = usable.orderBy(F.xxhash64("k"), "k").limit(sample).select("k", "y", F.pmod(F.xxhash64("k", F.lit("part")), F.lit(PARTS)).cast("int").alias("part"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").groupBy("k", "part", "y").agg(F.min("text").alias("text")).select("part", "y", "text")
    lexicons = learned_lexicons(rows)
    got = _rows(rows, lexicons).collect()
    got.sort(key=lambda r: (r["part"], r["y"], r["x"]))
    part, y = np.array([r["part"] for r in got], int), np.array([r["y"] for r in got], float)
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(features("", {})))
    if any(len(set(y[part != p])) < 2 for p in range(PARTS)):
        return Model(lexicons[PARTS], None, None, float(y.mean()) if len(y) else 0.0)
    sums = np.zeros(len(y))
    for p in range(PARTS):
        sums[part == p] = Trees().fit(x[part != p], y[part != p]).sums(x[part == p])
    return Model(lexicons[PARTS], Trees().fit(x, y), isotonic(sums, y), float(y.mean()))


def learned_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """For each part of (part, y, text) the lexicon of the others, and at the end that of all."""
    seen = once(rows, "words", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))))
    seen = seen.select("part", "y", F.explode(F.array_distinct(F.concat("words", *[_stems(k) for k in STEMS]))).alias("w"))
    n = {(r["part"], r["y"]): r["n"] for r in rows.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda p, y: sum(c for (q, v), c in n.items() if q != p and v == y)
    counts = [F.count_if((F.col("y") == y) & (F.col("part") != p)).alias(f"{name}{p}") for p in range(PARTS + 1) for name, y in (("bad", 1), ("good", 0))]
    scored = seen.groupBy("w").agg(*counts)
    for p in range(PARTS + 1):
        least = max(2, min(SUPPORT, of(p, 1) // 20))
        odds = F.log((F.col(f"bad{p}") + 0.5) / (of(p, 1) + 1)) - F.log((F.col(f"good{p}") + 0.5) / (of(p, 0) + 1))
        scored = scored.withColumn(f"o{p}", F.when((F.col(f"bad{p}") >= least) & (odds > 1.5), odds))
    worth = [F.coalesce(F.col(f"o{p}") * F.sqrt(f"bad{p}"), F.lit(0.0)) for p in range(PARTS + 1)]
    got = scored.select("w", *[f"o{p}" for p in range(PARTS + 1)], *[v.alias(f"v{p}") for p, v in enumerate(worth)]).where(F.greatest(*worth) > 0).orderBy(F.greatest(*worth).desc(), "w").limit((PARTS + 1) * LEXICON).collect()
    return [{r["w"]: r[f"o{p}"] for r in sorted((r for r in got if r[f"o{p}"]), key=lambda r: (-r[f"v{p}"], r["w"]))[:LEXICON]} for p in range(PARTS + 1)]


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each text (0 to 1)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def scored(texts):
        return texts.__class__(model.scores([t or "" for t in texts]))

    return df.withColumn(out, scored(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' scores, with a model of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
