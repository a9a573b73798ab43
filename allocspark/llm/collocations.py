"""Collocations by passes over the text with bucket counts and Apriori pruning (operator 13).

Pass k counts phrases of k words exactly and, as it goes, phrases of k + 1 words in hashed
buckets (``bucket_maps``). Pass k + 1 counts only phrases whose bucket holds enough and
whose first and last k words are frequent themselves, by bitmaps of the frequent phrases:
both bitmaps have a fixed size and go to every task. What passes is counted by its words,
not by hashes, so bitmaps save work and change nothing.

In a task, words are coded by a vocabulary of each slice of texts and phrases are pairs of
codes, which are counted by sorting; only distinct phrases become texts. They are summed by
Spark, task by task before they are shuffled.

A phrase's score is that of its weakest cut into two parts. Scores are exact: products of
counts are decimals of up to 37 digits. A phrase goes if a longer candidate that holds it
has half of its occurrences; that looks at the largest count among the longer ones.

Null texts count as empty, null lang as ``und``. Repeated rows count again. Phrases don't
cross pieces or texts. Ties of scores are broken by counts, then by bytes. Other columns are
not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bucket_maps import Buckets, bitmap, has, items_bitmap
from .common import table, written
from .runs_of_bytes import Words, byte_class, codes_of, sliced, words_of
from .shingles import mix

#: Words of the longest phrases, parts in which a language's phrases are ranked first.
LONGEST, SALTS = 3, 64
#: Occurrences of a candidate, percent of them in a longer one that take it away, phrases shown of each language, buckets (two bitmaps of an eighth of that in bytes go to every task).
LEAST, COVERED, SHOWN, BUCKETS = 10, 50, 2000, 1 << 26
WORD = byte_class(but="\t .,;:!?\n\x0b\x0c\r")
BREAK = ~WORD & ~byte_class(but=".,;:!?\n\x0b\x0c\r")
ROWS = "lang string, phrase string, n long, part int, data binary"
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(langs: list[str], words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, xxhash.xxh3_64_intdigest(lang)) for lang, w in zip(langs, words, strict=True)), np.uint64, len(words))


def chained(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its words but the last, and of the last."""
    return mix(first * _STEP + last)


def phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of phrases (lang, phrase), as the passes make them from the words."""
    langs, phrases = batch.column(0).to_pylist(), [p.split(" ") for p in batch.column(1).to_pylist()]
    out = word_hashes(langs, [p[0] for p in phrases])
    for k in range(1, max(map(len, phrases))):
        longer = np.array([len(p) > k for p in phrases])
        more = word_hashes([x for x, m in zip(langs, longer, strict=True) if m], [p[k] for p in phrases if len(p) > k])
        out[longer] = chained(out[longer], more)
    return out


@dataclass
class Level:
    """Distinct phrases of one length in a slice of texts, by code: their languages' codes, texts and hashes. code: of the phrase at each word, -1 where there is none."""

    code: np.ndarray
    lang: np.ndarray
    texts: pa.Array
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.code[self.code >= 0], minlength=len(self.hashes))

    def kept(self, mask: np.ndarray) -> Level:
        """Without the phrases that the mask leaves out."""
        number = np.append(np.where(mask, np.cumsum(mask) - 1, -1), -1)
        return Level(number[self.code], self.lang[mask], self.texts.filter(pa.array(mask)), self.hashes[mask])


def words_level(lang: np.ndarray, names: list[str], words: Words) -> Level:
    """The words of a slice, told apart by language. lang: code of each word's."""
    size = max(1, len(words.vocabulary))
    keys, code = np.unique(lang * size + words.code, return_inverse=True)
    of, texts = keys // size, words.vocabulary.take(pa.array(keys % size))
    return Level(code, of, texts, word_hashes([names[i] for i in of.tolist()], texts.to_pylist()))


def longer(shorter: Level, words: Level, joined: np.ndarray, size: int, with_texts: bool) -> Level:
    """Phrases of ``size`` words whose first and last size - 1 words are among the shorter ones. joined: whether a word and the next are of one piece."""
    n, base = len(words.code), max(1, len(words.hashes))
    code = np.full(n, -1, np.int64)
    at = np.flatnonzero((shorter.code[: max(0, n - size + 1)] >= 0) & (shorter.code[1 : n - size + 2] >= 0) & joined[size - 2 : n - 1]) if n >= size else np.zeros(0, np.int64)
    keys, code[at] = np.unique(shorter.code[at] * base + words.code[at + size - 1], return_inverse=True)
    first, last = keys // base, keys % base
    texts = pc.binary_join_element_wise(shorter.texts.take(pa.array(first)), words.texts.take(pa.array(last)), " ") if with_texts else pa.array(np.zeros(len(keys), np.int8))
    return Level(code, shorter.lang[first], texts, chained(shorter.hashes[first], words.hashes[last]))


def counted(docs: DataFrame, length: int, frequent: list, enough, buckets: int, least: int) -> DataFrame:
    """One pass over docs (lang, text): lang, phrase and n of phrases of ``length`` words, and rows with part and data of a task's bucket counts of the next length.

    frequent: a broadcast bitmap of the frequent phrases of each shorter length; enough: one of the buckets of this length.
    """
    none = lambda n, kind: pa.nulls(n, kind)
    names = ["lang", "phrase", "n", "part", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Buckets(buckets, least) if length < LONGEST else None
        for batch in batches:
            lang, langs = codes_of(batch.column(0))
            for a, _, data, begins in sliced(batch.column(1)):
                words = words_of(data, begins, WORD)
                if not len(words.code):
                    continue
                breaks = np.concatenate((np.zeros(1, np.int32), np.cumsum(BREAK[data], dtype=np.int32)))[words.starts]
                joined = (breaks[1:] == breaks[:-1]) & (words.text[1:] == words.text[:-1])
                level = ones = words_level(lang[a + words.text], langs.to_pylist(), words)
                for k in range(2, length + 1):
                    level = level.kept(has(frequent[k - 2].value, level.hashes))
                    ones = level if k == 2 else ones
                    level = longer(level, ones, joined, k, True)
                if length > 1:
                    level = level.kept(has(enough.value, level.hashes))
                n = len(level.hashes)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(level.lang)), level.texts, pa.array(level.counts().astype(np.int64)), none(n, pa.int32()), none(n, pa.binary())], names)
                if own:
                    following = longer(level, level if length == 1 else ones, joined, length + 1, False)
                    own.add(following.hashes, following.counts())
        for part, data in own.parts() if own else ():
            yield pa.RecordBatch.from_arrays([none(1, pa.string()), none(1, pa.string()), none(1, pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names)

    return docs.mapInArrow(run, ROWS)


def phrases(docs: DataFrame, least: int = LEAST, buckets: int = BUCKETS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all word occurrences, and (lang, phrase, n) of the phrases of each length with ``least`` occurrences or more."""
    context = docs.sparkSession.sparkContext
    totals, found, frequent, enough = None, [], [], None
    for length in range(1, LONGEST + 1):
        rows = written(counted(docs, length, frequent, enough, buckets, least), f"phrases-{length}")
        each = rows.where("part IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if length == 1:
            totals = rows.where("part IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        found.append(written(each.where(F.col("n") >= least), f"frequent-{length}"))
        if length < LONGEST:
            frequent.append(context.broadcast(items_bitmap(found[-1], phrase_hashes, buckets)))
            enough = context.broadcast(bitmap(rows.where("part IS NOT NULL"), buckets, least))
    return totals, found


def _words(phrase: Column, start: int, end: int) -> Column:
    """Words start to end of a phrase (from 1)."""
    return F.array_join(F.slice(F.split(phrase, " "), start, end - start + 1), " ")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, covered: int = COVERED, shown: int | None = SHOWN, buckets: int = BUCKETS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's phrases; shown=None: all of them."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    totals, found = phrases(docs, least, buckets)
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = []
    for size in range(2, LONGEST + 1):
        for k in range(1, size):
            own = found[size - 1].select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), _words(F.col("phrase"), 1, k).alias("first"), _words(F.col("phrase"), k + 1, size).alias("last"))
            left, right = (found[n - 1].select("lang", F.col("phrase").alias(name), F.col("n").alias(count)) for n, name, count in ((k, "first", "l"), (size - k, "last", "r")))
            cuts.append(own.join(left, ["lang", "first"]).join(right, ["lang", "last"]).select("lang", "phrase", "a", "l", "r", "k"))
    scored = functools.reduce(DataFrame.unionByName, cuts)
    scored = scored.withColumn("score", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l") * wide("r")))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = [found[size - 1].select("lang", _words(F.col("phrase"), k, k + part - 1).alias("phrase"), F.col("n").alias("in")) for size in range(3, LONGEST + 1) for part in range(2, size) for k in range(1, size - part + 2)]
    most = functools.reduce(DataFrame.unionByName, inner).groupBy("lang", "phrase").agg(F.max("in").alias("in"))
    left = scored.join(most, ["lang", "phrase"], "left").where(F.col("in").isNull() | (100 * F.col("in") < covered * F.col("a")))
    order = (F.desc("score"), F.desc("a"), "phrase")
    if shown is not None:  # each part of a language keeps its leading ones, so the last ranking gets a bounded number
        left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= shown).drop("salt", "rank")
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if shown is not None:
        ranked = ranked.where(F.col("rank") <= shown)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading phrases of each language in all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM docs),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM pieces WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) FROM pieces WHERE len(w) > 2),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT lang, phrase, a, c, array_to_string(w[:c], ' ') AS x, array_to_string(w[c+1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
val AS (SELECT t.lang, t.phrase, t.a, t.c, p.a AS l, q.a AS r, (1000000 * t.a * t.a) // (p.a * q.a) AS score FROM cut t JOIN f p ON p.lang = t.lang AND p.phrase = t.x JOIN f q ON q.lang = t.lang AND q.phrase = t.y),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM val) WHERE o = 1),
held AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3),
over AS (SELECT lang, phrase, max(a) AS m FROM held GROUP BY ALL),
free AS (SELECT b.* FROM best b LEFT JOIN over o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.m IS NULL OR 100 * o.m < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
