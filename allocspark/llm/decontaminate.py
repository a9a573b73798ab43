r"""Benchmark decontamination (operator 7), in SQL expressions only.

The windows of the test items form a hash set: an array of buckets by the hash of the whole
window, and a table of the hashes of their first words, both constants of the plan that so
reach every task. Each position of a document looks up its first words, and the few that
are known compare the whole window. Documents are neither exploded nor shuffled. The
set is counted first: past ``most`` windows (a bound of some MB) only the table of first
words is such a constant (a bit map of fixed size), and the positions that it lets through
are joined with the windows by a shuffle instead. Both ways give the same rows.

Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became lower case. An item's
windows are its runs of 13 words; an item of fewer is one window, an item without words
(or without text) is none. Windows of an item without id hit, but no item is listed for
them; rows of one item_id are one item. A document without words, or of null text, has no
hits; repeated rows and null ids of documents stay as they are. Columns are passed on;
those whose names begin with ``_dc`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, table, written

#: Words of a window, words that are looked up first, windows at most that go to every task, bits of the map of first words beyond.
WINDOW, LEAD, MOST, BITS = 13, 3, 50_000, 1 << 22
#: A document is contaminated if hits are one word of this many.
SHARE = 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """The array of words; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, BREAK + "+"), "")


def _lead(at: Column, length: int, of: str) -> Column:
    return F.xxhash64(*[F.get(F.col(of), at + k) for k in range(min(LEAD, length))])


def _gram(at: Column, length: Column | int, of: str) -> Column:
    return F.array_join(F.slice(F.col(of), at + 1, length), " ")


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """length, lead (hash), gram (words joined by spaces) and the items that have it."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.size("w"), F.lit(size)))
    w = w.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))))
    lead = F.coalesce(*[F.when(F.col("length") == n, _lead(F.col("i"), n, "w")) for n in range(1, size + 1)])
    w = w.select("item", "length", lead.alias("lead"), _gram(F.col("i"), F.col("length"), "w").alias("gram"))
    return w.groupBy("length", "lead", "gram").agg(F.collect_set("item").alias("items"))


def _buckets(known: DataFrame, length: int, slots: int) -> tuple[Column, Column, Column, Column, Column]:
    """Constant arrays: whether a slot of first words is known; grams by slot, and their items (ids in hexadecimal digits); for each slot of grams the first place and the number, however many share it."""
    rows = known.where(F.col("length") == length).select(F.pmod(F.xxhash64("gram"), F.lit(slots)).cast("int").alias("slot"), F.pmod("lead", F.lit(slots)).cast("int").alias("lead"), "gram", F.array_join(F.transform("items", lambda x: F.concat(F.lit("x"), F.hex(x))), ",").alias("items")).collect()
    rows.sort(key=lambda r: (r["slot"], r["gram"]))
    first, number, leads = [0] * slots, [0] * slots, [0] * slots
    for k, r in enumerate(rows):
        first[r["slot"]] = first[r["slot"]] if number[r["slot"]] else k
        number[r["slot"]] += 1
        leads[r["lead"]] = 1
    leads, grams, items, firsts, numbers = (F.split(F.lit("\n".join(map(str, x))), "\n") for x in (leads, [r["gram"] for r in rows], [r["items"] for r in rows], first, number))
    return leads.cast("array<int>"), grams, items, firsts.cast("array<int>"), numbers.cast("array<int>")


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", size: int = WINDOW, most: int = MOST) -> DataFrame:
    """``docs`` with _dc_words (array), _dc_hits (array of start, length, items) in order of start."""
    known = windows(benchmark, item, "text", size)
    lengths = {r["length"]: r["n"] for r in known.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    row = once(docs.drop("_dc_hits"), "_dc_words", words(F.col(text)))
    kind = "array<struct<start int, length int, items array<string>>>"
    none = F.array().cast(kind)
    if sum(lengths.values()) > most:
        return _joined(row, written(known, "windows"), sorted(lengths), none, kind)
    found = [_starts(n, slots := 1 << (4 * count).bit_length(), _buckets(known, n, slots), none) for n, count in sorted(lengths.items())]
    hits = F.array_sort(F.concat(*found)) if len(found) > 1 else found[0] if found else none
    return once(row, "_dc_hits", hits.cast(kind))


def _starts(n: int, slots: int, buckets: tuple, none: Column) -> Column:
    """The hits of windows of n words."""

    leads, grams, items, firsts, numbers = buckets

    def ids(k: Column) -> Column:
        return F.transform(F.array_remove(F.split(F.get(items, k), ","), ""), lambda x: F.decode(F.unhex(F.substring(x, 2, 1 << 30)), "utf-8"))

    def of_slot(i: Column, gram: Column, slot: Column) -> Column:
        first, number = F.get(firsts, slot), F.get(numbers, slot)
        sure = F.filter(F.sequence(first, first + number - 1), lambda k: F.get(grams, k) == gram)
        return F.when(number > 0, F.transform(sure, lambda k: F.struct(i.alias("start"), F.lit(n).alias("length"), ids(k).alias("items")))).otherwise(none)

    def at(i: Column) -> Column:
        known = F.get(leads, F.pmod(_lead(i, n, "_dc_words"), F.lit(slots)).cast("int")) > 0
        whole = F.transform(F.array(_gram(i, n, "_dc_words")), lambda g: of_slot(i, g, F.pmod(F.xxhash64(g), F.lit(slots)).cast("int")))
        return F.when(known, F.flatten(whole)).otherwise(none)

    return F.when(F.size("_dc_words") >= n, F.flatten(F.transform(F.sequence(F.lit(0), F.size("_dc_words") - n), at))).otherwise(none)


def _grams(n: int, bits: Column) -> Column:
    """Every run of n words whose first words the bit map knows."""
    slot = lambda i: F.pmod(_lead(i, n, "_dc_words"), F.lit(BITS)).cast("int")
    known = F.filter(F.sequence(F.lit(0), F.size("_dc_words") - n), lambda i: F.getbit(F.get(bits, F.shiftright(slot(i), 6)), slot(i).bitwiseAND(F.lit(63))) == 1)
    each = F.transform(known, lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), _gram(i, n, "_dc_words").alias("gram")))
    return F.when(F.size("_dc_words") >= n, each).otherwise(F.array().cast("array<struct<start int, length int, gram string>>"))


def _joined(row: DataFrame, known: DataFrame, lengths: list[int], none: Column, kind: str) -> DataFrame:
    """The same by a shuffled join, for window sets of any size; skewed windows are split by the adaptive join."""
    slot = F.pmod("lead", F.lit(BITS)).cast("int")
    rows = known.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(pmod(lead, 64) as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    words_of = [0] * (BITS >> 6)
    for r in rows:
        words_of[r["at"]] = r["bits"]
    bits = F.split(F.lit("\n".join(map(str, words_of))), "\n").cast("array<long>")
    tried = F.concat(*[_grams(n, bits) for n in lengths])
    numbered = written(row.select(F.monotonically_increasing_id().alias("id"), F.struct(*row.columns).alias("whole")), "numbered")
    each = numbered.select("id", F.col("whole._dc_words").alias("_dc_words")).select("id", F.explode(tried).alias("c")).select("id", "c.*")
    hits = each.join(known.select("length", "gram", "items"), ["length", "gram"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "items"))).alias("h"))
    return numbered.join(hits, "id", "left").select("whole.*", F.coalesce(F.col("h").cast(kind), none).alias("_dc_hits"))


def covered() -> Column:
    """Words inside any hit."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate("_dc_hits", zero, lambda a, h: F.struct((a["n"] + F.greatest(h["start"] + h["length"] - F.greatest(h["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], h["start"] + h["length"]).alias("end")))["n"]


def contaminated() -> Column:
    n = covered()
    return (n > 0) & (SHARE * n >= F.size("_dc_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **more) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words (and the breaks before them) of each cut out of the text."""
    found = scan(docs, benchmark, text, **more)
    if remove == "documents":
        return found.where(~contaminated()).select(*docs.columns)
    parts = F.regexp_extract_all(F.col(text), F.lit(f"({BREAK}*{WORD}+)"), F.lit(1))
    tail = F.regexp_extract(F.col(text), f"({BREAK}*)$", 1)
    kept = F.filter(parts, lambda p, i: ~F.exists("_dc_hits", lambda h: (i >= h["start"]) & (i < h["start"] + h["length"])))
    cut = F.when(F.size("_dc_hits") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(F.col(text))
    return found.withColumn(text, cut).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their hits of all benchmark items."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_dc_hits", lambda h: h["items"]))))
    out = found.select("doc_id", F.size("_dc_words").cast("long").alias("n_words"), covered().cast("long").alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM grams),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'i': i, 'g': array_to_string(w[i:i+n-1], ' ')})) AS x FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, x.i AS i, dw.n AS n, item_id FROM dw JOIN grams ON dw.n = grams.n AND x.g = grams.g),
spots AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS c, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(spots.c, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.c, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(spots.c, 0) > 0 AND 20 * coalesce(spots.c, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""
