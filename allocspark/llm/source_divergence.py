"""How far the sources of a language differ in their words (operator 11).

Shares are smoothed: a term with c of N occurrences in a group has p = 1 + floor(10^9 (c + 2)
/ (N + 2V)) with V kept terms in its language, so two groups differ by V values f of which
most belong to terms that neither has. A pair of sources therefore starts at V times the
value of two zero counts, and the inverted index of the terms emits corrections only:

* for a term that one group has, f(p, other's zero) less f(both zero). These depend on the
  group's count alone, so they are taken from its histogram of counts, not term by term;
* for a term of which both have postings, what the two corrections above leave open.

Postings of a term meet by a join of the index with itself, one row for each pair of sources
that share it, summed before they are shuffled. All arithmetic is in whole numbers; counts
are multiplied as decimals. The terms of a group are ranked in windows, which Spark cuts to
the leading ones of each task before it moves rows.

Null text, lang and source count as ''. Every row is a document of its own, repeated ones
too; doc_id isn't looked at. A group without kept terms has p of zero counts; without kept
terms in its language all its pairs have the value 0. Texts without words still make their
group. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .runs_of_bytes import byte_class, codes_of, sliced, words_of

#: Documents of a language that a term needs, terms that are shown of each group.
LEAST, SHOWN = 10, 10
TERM = byte_class(only_letters=True)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents) of docs (lang, source, text), combined in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, langs = codes_of(batch.column(0))
            source, sources = codes_of(batch.column(1))
            for a, _, data, begins in sliced(batch.column(2)):
                words = words_of(data, begins, TERM)
                size = max(1, len(words.vocabulary))
                pairs, n = np.unique(words.text * size + words.code, return_counts=True)
                doc, code = a + pairs // size, pairs % size
                group = lang[doc] * len(sources) + source[doc]
                keys, inverse, d = np.unique(group * size + code, return_inverse=True, return_counts=True)
                group, code = keys // size, keys % size
                total = np.bincount(inverse, n, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), words.vocabulary.take(pa.array(code)), pa.array(total), pa.array(d.astype(np.int64))], ["lang", "source", "term", "n", "d"])

    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed share in whole parts of 10^9; null without any occurrence and kept term."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(count) + F.lit(2).cast("decimal(1,0)")), F.nullif(wide(total) + wide(kept) * F.lit(2).cast("decimal(1,0)"), F.lit(0).cast("decimal(1,0)"))) + 1


def apart(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / (p + q)); at most 10^9 + 1 each, so the square fits."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergences(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (``pair``) and the ``shown`` terms that a group has most above its language (``term``)."""
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    of_term, of_group = Window.partitionBy("lang", "term"), Window.partitionBy("lang", "source")
    index = term_counts(docs).withColumns({"documents": F.sum("d").over(of_term), "in_lang": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    index = written(index.where(F.col("documents") >= least).drop("d", "documents"), "postings")
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("first").alias("v"))
    groups = written(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["n", "v"]), "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("v").alias("kept"))
    groups = groups.join(langs, "lang").select("lang", "source", F.col("n").alias("total"), "lang_total", "kept", share(F.lit(0), F.col("n"), F.col("kept")).alias("p0"))
    posts = index.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    one = posts.select("lang", "source", "term", "p", "p0")
    other = one.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    more = apart("p", "q") - apart("p", "q0") - apart("p0", "q") + apart("p0", "q0")
    both = one.join(other, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(more).alias("value"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "kept")
    has = posts.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    alone = has.join(others.drop("kept"), "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    start = groups.select("lang", "source", "p0").join(others, "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", F.coalesce(F.col("kept") * apart("p0", "q0"), F.lit(0)).alias("value"))
    mirrored = both.unionByName(alone)
    mirrored = mirrored.unionByName(mirrored.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = start.unionByName(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    above = posts.withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))).where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"), F.lit("term").alias("part"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(above).where(F.col("rank") <= shown)).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of documents."""
    return divergences(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT lang, source, i, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT i) >= 10),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
had AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM docs),
tot AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM grp g LEFT JOIN had h ON g.lang = h.lang AND g.source = h.source GROUP BY ALL),
dense AS (SELECT t.lang, t.source, k.term, coalesce(h.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(h.c, 0) + 2)) // (t.n::HUGEINT + 2 * s.v) AS p
  FROM tot t JOIN kept k ON t.lang = k.lang JOIN size s ON s.lang = t.lang LEFT JOIN had h ON h.lang = t.lang AND h.source = t.source AND h.term = k.term),
told AS (SELECT lang, sum(n) AS n FROM tot GROUP BY lang),
sums AS (SELECT lang, term, sum(c) AS c FROM had GROUP BY lang, term),
whole AS (SELECT h.lang, h.term, 1 + (1000000000::HUGEINT * (h.c + 2)) // (t.n::HUGEINT + 2 * s.v) AS q FROM sums h JOIN told t ON t.lang = h.lang JOIN size s ON s.lang = h.lang),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT d.lang, d.source, 'term' AS part, d.term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM dense d JOIN whole w ON d.lang = w.lang AND d.term = w.term WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
