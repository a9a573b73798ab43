"""MinHash near-duplicates by a signature-coordinate inverted join (operator 2).

Documents are posted under each (coordinate, value) of their signatures; pairs that collide
in at least ``match`` of ``k`` coordinates are candidates, and full shingle sets confirm
them. The steps:

1. One pass gives each document's set size, a 128-bit digest of its set, and its signature.
   Documents of one digest have the same set; the least doc_id stands for them from here on.
2. Sets are posted under all coordinates. A set with fewer than ``match`` coordinates in
   lists of two or more has no partner; it leaves, and only the others' texts are fetched.
3. Counting its collisions with the least set of each of its lists gives each set a head;
   that link is confirmed. This joins large groups of near copies by few links and is a
   shortcut only: sets that are tied already need no further link between them.
4. Inverted join with a prefix: two sets with ``match`` common coordinates share one of
   the first k - match + 1, so only those are posted, and lists that lie within one group
   are skipped. Lists over ``block`` sets are split into pairs of blocks, which are tasks of
   their own. In a list collisions are counted coordinate by coordinate, on 8 bits of each,
   which can only add candidates; a pair is skipped as soon as the coordinates that are left
   can't bring it to ``match``, if it lies within a group, or if the sizes differ too much.
5. The candidates are confirmed on full sets; all links give the components. A list with
   very many candidates (families of documents that are alike, but mostly not enough) gives
   a tree over them instead of all pairs; the sets of such a family meet in blocks, and
   each pair of blocks verifies its candidates in place and gives the links that join groups.

A pair at the threshold of 0.75 has at least 30 of 64 equal coordinates but for one in
some millions, and a lost link matters only where no other path joins its documents.

Null and empty texts have an empty set and no links. Repeated rows are one document. Rows
of one doc_id with different texts are told apart: a link of one doesn't tie the others. A
row without doc_id is linked with nothing, has no component, and is kept. Other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, table, texts_of, written
from .graph import components
from .shingles import min_hashes, shingle_sets

#: Coordinates, equal ones that make a candidate, sets in a block, similarity in percent, pairs for each set that a list gives as such.
K, MATCH, BLOCK, PERCENT, SPARSE = 64, 30, 2048, 75, 8


def signatures(df: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text", size: int = 5, k: int = K) -> DataFrame:
    """doc_id, text_key, n_shingles, digest (null for an empty set), sig (array of k coordinates), of rows with a text_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            for a, b in slices(texts):
                found = shingle_sets(texts[a:b], secret, size)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
                sigs = [min_hashes(s, k) if len(s) else np.zeros(k, np.int32) for s in found]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, k * (b - a) + 1, k, dtype=np.int32)), pa.array(np.concatenate(sigs)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(map(len, found), pa.int64()), pa.array(digests, pa.binary()), flat], ["doc_id", "text_key", "n_shingles", "digest", "sig"])

    return df.select(F.col(key).cast("long").alias("doc_id"), "text_key", F.col(text).alias("text")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, sig array<int>")


def _posted(sets: DataFrame, coordinates: int = K, *more: str) -> DataFrame:
    """node, more columns, and key (a coordinate and its value) of each post."""
    return sets.select("node", *more, F.posexplode(F.slice("sig", 1, coordinates)).alias("i", "value")).select("node", *more, (F.shiftleft(F.col("i").cast("long"), 32) + F.col("value")).alias("key"))


def with_company(sets: DataFrame, match: int = MATCH) -> DataFrame:
    """The sets that share ``match`` coordinates or more, each with some other set."""
    posts = _posted(sets)
    lists = written(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "lists")
    nodes = posts.join(lists, "key", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= match).select("node")
    return sets.join(nodes, "node", "left_semi")


def confirmed(texts: DataFrame, pairs: DataFrame, secret: bytes, size: int = 5, percent: int = PERCENT, block: int = 64) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. Each b is sent to its a once; an a with many partners is sent to several tasks. texts: node, text."""
    n = texts.sparkSession
    dealt = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    members = pairs.join(dealt, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"))
    heads = dealt.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"))
    texts = texts.select(F.col("node").alias("id"), "text")
    rows = members.unionByName(heads).join(texts, "id").select("a", "salt", (F.col("a") != F.col("id")).alias("member"), "id", "text")
    rows = rows.repartition(shuffle_partitions(n), "a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.zeros(0, np.uint64)
        for batch in batches:
            texts = texts_of(batch.column(4))
            firsts, salts, ids = (batch.column(c).to_pylist() for c in (0, 1, 3))
            for x, z in slices(texts):
                left, right = [], []
                for a, salt, i, found in zip(firsts[x:z], salts[x:z], ids[x:z], shingle_sets(texts[x:z], secret, size), strict=True):
                    if a == i:
                        at, head = (a, salt), found
                    elif at == (a, salt) and 100 * min(len(head), len(found)) >= percent * max(len(head), len(found)):
                        both = len(np.intersect1d(head, found, assume_unique=True))
                        if both and 100 * both >= percent * (len(head) + len(found) - both):
                            left.append(a)
                            right.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def headed(sets: DataFrame, match: int = MATCH) -> DataFrame:
    """Each set's link (a < b) to the set that is the least of most of its lists, if those are half of ``match``."""
    posts = _posted(sets)
    least = posts.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("key", "a")
    met = posts.join(least, "key").where("a <> node").groupBy(F.col("node").alias("b"), "a").agg(F.count(F.lit(1)).alias("same")).where(F.col("same") >= match // 2)
    return met.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a")).select("a", "b")


def colliding(sets: DataFrame, match: int = MATCH, block: int = BLOCK, percent: int = PERCENT, sparse: int = SPARSE) -> DataFrame:
    """Pairs (a < b) of different groups with ``match`` equal coordinates. sets: node, grp, n_shingles, sig.

    A list with more than ``sparse`` pairs for each of its sets doesn't give them: it gives
    one edge (with ``dense``) from each set to the least set that its pairs lead to.
    """
    prefix = K - match + 1
    posted = _posted(sets, prefix, "grp")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    live = posted.join(lists, "key").select("key", "blocks", "node")
    small = sets.select("node", "grp", F.col("n_shingles").alias("n"), F.transform("sig", lambda x: (x % 256 - 128).cast("tinyint")).alias("sig"))
    rows = live.join(small, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("c"), "own", "node", "grp", "n", "sig")
    rows = rows.repartition(shuffle_partitions(sets.sparkSession), "key", "r", "c").sortWithinPartitions("key", "r", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in _ending(batches):
            now = None if batch is None else [np.asarray(batch.column(c)) for c in range(7)] + [np.asarray(batch.column(7).flatten()).reshape(-1, K)]
            if rest is not None:
                now = rest if now is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if now is None:
                return
            if not len(now[0]):
                rest = None
                continue
            cut = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1])) + 1
            starts = np.concatenate(([0], cut))
            ends = np.append(cut, len(now[0]))
            if batch is not None:  # the last list may go on
                rest = [x[starts[-1] :] for x in now]
                starts, ends = starts[:-1], ends[:-1]
            else:
                rest = None
            out = {False: [], True: []}
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 1:
                    own, ids, grp, n, sig = (x[s:e] for x in now[3:])
                    i, j = _matching(ids, grp, n, sig, own if now[1][s] != now[2][s] else None, match, percent)
                    if dense := len(i) > sparse * (e - s):
                        root = _roots(i, j, e - s)
                        least = np.full(e - s, np.iinfo(np.int64).max)
                        np.minimum.at(least, root, ids)
                        left, right = least[root], ids
                        out[dense].append(np.stack((left[left != right], right[left != right]), axis=1))
                    elif len(i):
                        out[dense].append(np.stack((ids[i], ids[j]), axis=1))
            for dense, parts in out.items():
                if parts:
                    found = np.unique(np.concatenate(parts), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.full(len(found), dense))], ["a", "b", "dense"])

    return rows.mapInArrow(run, "a long, b long, dense boolean").distinct()


def _matching(ids: np.ndarray, grp: np.ndarray, n: np.ndarray, sig: np.ndarray, own: np.ndarray | None, match: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (lesser id first) of different groups, and blocks where given, that collide often enough and whose sizes allow a link."""
    left, right = [], []
    step = max(1, (1 << 22) // (len(ids) * K))
    for p in range(0, len(ids), step):
        q = min(p + step, len(ids))
        fit = (ids[p:q, None] < ids) & (grp[p:q, None] != grp)
        fit &= 100 * np.minimum(n[p:q, None], n) >= percent * np.maximum(n[p:q, None], n)
        if own is not None:
            fit &= own[p:q, None] != own
        i, j = np.nonzero(fit)
        same = np.zeros(len(i), np.int16)
        for k in range(0, K, 8):
            same += (sig[p + i, k : k + 8] == sig[j, k : k + 8]).sum(axis=1, dtype=np.int16)
            able = same + (K - k - 8) >= match
            if not able.all():
                i, j, same = i[able], j[able], same[able]
        left.append(p + i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places is joined to by the pairs."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def clustered(texts: DataFrame, sets: DataFrame, edges: DataFrame, secret: bytes, size: int = 5, match: int = MATCH, percent: int = PERCENT, block: int = BLOCK // 4) -> DataFrame:
    """Links (a, b) that join the groups of all similar sets within the components of the dense edges.

    Each component is dealt out by pairs of blocks of its sets. A task verifies the pairs that
    collide often enough on full sets, all but those that its links join already, so it gives
    fewer links than it has sets.
    """
    found = components(edges)
    spread = found.groupBy("component").agg(F.count(F.lit(1)).alias("m")).select("component", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    small = sets.select("node", "grp", F.col("n_shingles").alias("n"), F.transform("sig", lambda x: (x % 256 - 128).cast("tinyint")).alias("sig"))
    rows = found.join(spread, "component").join(small, "node").select("component", "blocks", "node", "grp", "n", "sig", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    rows = rows.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("c"), "own", "node", "grp", "n", "sig", "text")
    rows = rows.repartition(shuffle_partitions(texts.sparkSession), "component", "r", "c").sortWithinPartitions("component", "r", "c")

    def links(cell: tuple, own: list, ids: list, grp: list, n: list, sig: list, full: list) -> pa.RecordBatch:
        own, ids, grp, n = (np.array(x) for x in (own, ids, grp, n))
        sig = np.array(sig, np.int8).reshape(len(ids), -1)
        left, right = _matching(ids, grp, n, sig, own if cell[1] != cell[2] else None, match, percent)
        joined = {g: g for g in grp.tolist()}

        def root(x: int) -> int:
            while joined[x] != x:
                joined[x] = x = joined[joined[x]]
            return x

        out = []
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            x, y = root(int(grp[i])), root(int(grp[j]))
            if x != y:
                a, b = full[i], full[j]
                at = np.searchsorted(a, b)
                at[at == len(a)] = 0
                both = int((a[at] == b).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    joined[max(x, y)] = min(x, y)
                    out.append((int(ids[i]), int(ids[j])))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, [[] for _ in range(6)]
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                columns = [part.column(c).to_pylist() for c in range(8)]
                for row in zip(*columns, shingle_sets(texts_of(part.column(8)), secret, size), strict=True):
                    if row[:3] != cell:
                        if cell is not None:
                            yield links(cell, *held)
                        cell, held = row[:3], [[] for _ in range(6)]
                    for h, v in zip(held, row[3:], strict=True):
                        h.append(v)
        if cell is not None:
            yield links(cell, *held)

    return rows.mapInArrow(run, "a long, b long")


def _ending(batches):
    yield from batches
    yield None


def _named(sets: DataFrame, salt: int) -> DataFrame:
    """Sets with a node each: their doc_id, or another number where several sets have the same."""
    twice = sets.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last").select("doc_id", "first")
    if not twice.head(1):
        return sets.withColumn("node", F.col("doc_id"))
    other = F.col("first").isNotNull() & (F.col("first") != F.col("digest"))
    return sets.join(twice, "doc_id", "left").withColumn("node", F.when(other, F.xxhash64(F.lit(salt), "digest", "doc_id")).otherwise(F.col("doc_id"))).drop("first")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", sparse: int = SPARSE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    secret, salt = secrets.token_bytes(32), secrets.randbits(62)  # drawn for each run: names of words, texts and extra nodes can't be made to collide
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.lit(salt), text).alias("text_key"), F.col(text).alias("text"))
    signed = written(signatures(docs, secret), "signatures")
    row = F.struct("doc_id", "text_key", "n_shingles", "sig")
    alone = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min_by(row, F.struct("doc_id", "text_key")).alias("s")).select("s.*", "digest")
    alone = written(alone, "sets")
    sets = written(with_company(_named(alone, salt)), "company")
    texts = docs.where("text IS NOT NULL").join(sets.select("doc_id", "text_key", "node"), ["doc_id", "text_key"])
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    groups = components(written(confirmed(texts, headed(sets), secret), "stars"))
    grouped = written(sets.join(groups, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("grp"), "n_shingles", "sig", "digest"), "groups")
    pairs = written(colliding(grouped, sparse=sparse), "pairs")
    links = confirmed(texts, pairs.where("NOT dense").select("a", "b"), secret).unionByName(clustered(texts, grouped, pairs.where("dense").select("a", "b"), secret))
    merged = grouped.select("node", "grp")
    a, b = (merged.select(F.col("node").alias(x), F.col("grp").alias(f"g{x}")) for x in "ab")
    joined = written(components(written(links, "links").join(a, "a").join(b, "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))), "joined")
    final = grouped.join(joined.withColumnRenamed("node", "grp"), "grp", "left").select("digest", "doc_id", F.coalesce("component", "grp").alias("class"))
    least = written(final.groupBy("class").agg(F.min("doc_id").alias("of")), "least")
    classes = written(final.join(least, "class").select("digest", "of"), "classes")
    # sets without company stand for their equal ones only
    equal = written(alone.select("digest", F.col("doc_id").alias("least")).join(classes, "digest", "left").select("digest", F.coalesce("of", "least").alias("of")), "components")
    out = signed.where("digest IS NOT NULL").join(equal, "digest", "left").select("doc_id", "n_shingles", "of").unionByName(signed.where("digest IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("of")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of near copies that they belong to."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM posted a JOIN posted b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM same WHERE 100 * c >= 75 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON s.doc_id = r.a
"""
