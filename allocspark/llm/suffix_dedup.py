"""Repeated passages by a distributed merge sort of suffixes (operator 5).

Every byte goes that lies in a 200-byte string which starts anywhere else too. Sorting all
suffixes would move each byte many times, so only suffixes at anchors are sorted: each
window of 200 bytes has one anchor that depends on its bytes alone (``suffix_runs``), and
two equal windows have theirs at the same offset. The steps:

1. Texts are laid into chunks of some MB, compressed rows of one binary column; equal texts
   of a chunk are one. All else refers to chunks, so few and small rows are shuffled.
2. A chunk asks about the fingerprints of its anchors and the digests of their surroundings
   (keyed, with a key drawn for each run), one bucket of fingerprints each. The bucket's answer says which surroundings occur
   elsewhere too (all of their windows go, and one chunk alone goes on with them), and
   which have company by their fingerprint only.
3. The suffixes of the latter become sorted front-coded runs, one for each bucket and chunk.
4. A bucket's runs meet in one task, which merges them with a tree of losers that knows the
   prefixes shared with the last string out. From the lengths shared in merged order, and
   those of the bytes to the left, windows that occur again follow for each offset.
5. Spans are united for each text and cut out.

A fingerprint with more than ``crowd`` different surroundings in a chunk, or ``bound`` in
all, is split before it is merged: its records are cut into blocks of 24 offsets, each of
which has a fingerprint of its own (the bytes that all its windows share), and step 2
begins again; then blocks of 3, then of one, where equal windows are equal records. So no
fingerprint fills a task, and each round costs what the crowded ones have.

Matches never cross documents. Null and empty texts have no bytes. Equal texts repeat each
other and lose all windows, whatever their ids. Other columns pass through
``deduplicated``; those of its outputs' names are replaced.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, table, texts_of, written
from .suffix_runs import LENGTH, SPAN, Records, anchors, coded, digest, opened, packed, repeats, unpacked

#: Bytes of texts in a chunk, different surroundings of a fingerprint that a chunk tells and a bucket merges, offsets in a block of each round.
CHUNK, CROWD, BOUND, WIDTHS = 4 << 20, 64, 20_000, (SPAN, 24, 3, 1)
ROWS = "chunk long, kind int, bucket int, data binary"
#: Kinds of rows: what a chunk is told, a chunk's own data, spans of a chunk, a run for a bucket, records of a chunk that are split further.
TOLD, OWN, HITS, RUN, SPLIT = range(5)
#: Bits of an answer.
AGAIN, SEND, CROWDED = 1, 2, 4


def _key(text: str) -> tuple[Column, Column]:
    """Two numbers of 60 bits each that name a text, from its SHA-256."""
    sha = F.sha2(F.encode(text, "utf-8"), 256)
    return tuple(F.conv(F.substring(sha, a, 15), 16, 10).cast("long").alias(name) for a, name in ((1, "ka"), (16, "kb")))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["chunk", "kind", "bucket", "data"])


def chunked(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """Chunks of docs (ka, kb, text): keys, number of equal ones, lengths and bytes of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, int], list] = {}
        size = 0

        def chunk() -> pa.RecordBatch:
            ka, kb = (np.array([k[i] for k in held], np.int64) for i in (0, 1))
            raw = b"".join(r for r, _ in held.values())
            data = packed(ka, kb, np.array([n for _, n in held.values()], np.int32), np.array([len(r) for r, _ in held.values()], np.int64), np.frombuffer(raw, np.uint8))
            return _rows([(part << 32 | made, OWN, -1, data)])

        for batch in batches:
            for ka, kb, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                if (ka, kb) in held:
                    held[ka, kb][1] += 1
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                held[ka, kb] = [raw, 1]
                size += len(raw)
                if size >= most:
                    yield chunk()
                    held, size, made = {}, 0, made + 1
        if held:
            yield chunk()

    return docs.select("ka", "kb", "text").mapInArrow(run, ROWS)


@dataclass
class Items:
    """Records that ask: key (all that may match have the same), tag (equal ones have equal surroundings), copies, offsets and place; strings(i) cuts the bytes right and left of the place."""

    key: np.ndarray
    tag: np.ndarray
    copies: np.ndarray
    least: np.ndarray
    most: np.ndarray
    place: np.ndarray
    strings: object

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """In order of key and tag: items, number of their kind, first item and copies of each kind."""
        order = np.lexsort((self.tag, self.key))
        key, tag = self.key[order], self.tag[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1]))) if len(order) else np.zeros(0, bool)
        kind = np.cumsum(fresh) - 1
        return order, kind, order[fresh], np.bincount(kind, self.copies[order], int(fresh.sum())).astype(np.int64)

    def records(self, chosen: np.ndarray) -> Records:
        right, left = zip(*map(self.strings, chosen.tolist()), strict=True)
        return Records(list(right), list(left), self.least[chosen], self.most[chosen], self.place[chosen])


def _anchored(data: bytes, secret: bytes) -> Items:
    """The anchors of a chunk's texts."""
    _, _, copies, lens, flat = unpacked(data)
    raw, ends = flat.tobytes(), np.cumsum(lens)
    texts = [raw[a:z] for a, z in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
    parts = []
    for a, z in slices(texts):
        of, place, *rest = anchors(texts[a:z], secret)
        parts.append((copies[a + of], place + (ends[a] - lens[a]), *rest))
    n, place, least, most, key, tag = (np.concatenate(x) for x in zip(*parts, strict=True))

    def strings(i: int) -> tuple[bytes, bytes]:
        p = int(place[i])
        return raw[p : p + LENGTH - int(least[i])], raw[p - int(most[i]) : p][::-1]

    return Items(key, tag, n, least, most, place, strings)


def _split(data: bytes, width: int, secret: bytes) -> Items:
    """The records of a run, cut into blocks of ``width`` offsets."""
    records, _ = opened(data)
    out, sides = [], []
    for right, left, least, most, place in zip(records.right, records.left, records.least.tolist(), records.most.tolist(), records.place.tolist(), strict=True):
        for a in range(least // width * width, most + 1, width):
            low, high, b = max(least, a), min(most, a + width - 1), min(a + width, SPAN) - 1
            x, y = right[: LENGTH - low], left[:high]
            out.append((digest(secret, bytes([a]), right[: LENGTH - b], left[:a]), digest(secret, bytes([low, high]), x, y), low, high, place))
            sides.append((x, y))
    key, tag = (np.array([o[k] for o in out], np.uint64) for k in (0, 1))
    low, high, place = (np.array([o[k] for o in out], np.int64) for k in (2, 3, 4))
    return Items(key, tag, np.ones(len(out), np.int32), low, high, place, sides.__getitem__)


def _items(data: bytes, level: int, secret: bytes) -> Items:
    return _split(data, WIDTHS[level], secret) if level else _anchored(data, secret)


def _dealt(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key % np.uint64(buckets)).astype(np.int64)


def _crowds(key: np.ndarray, crowd: int) -> np.ndarray:
    """For sorted keys of kinds: whether more than ``crowd`` have the same."""
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[inverse] > crowd


def asked(own: DataFrame, level: int, buckets: int, crowd: int, secret: bytes) -> DataFrame:
    """A row for each chunk and bucket: keys and tags of the chunk's kinds. A crowded key is told without its tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items = _items(batch.column(3)[i].as_py(), level, secret)
                _, _, first, copies = items.distinct()
                key, tag, several = items.key[first], items.tag[first], (copies > 1).astype(np.uint8)
                many = _crowds(key, crowd)
                several[many], tag[many] = 255, 0
                tell = ~many | np.concatenate(([True], key[1:] != key[:-1])) if len(key) else many
                bucket = _dealt(key, buckets)
                out = [(batch.column(0)[i].as_py(), TOLD, b, packed(*(x[mine] for x in (key, tag, several)))) for b in np.unique(bucket).tolist() for mine in [(bucket == b) & tell]]
                for x in range(0, len(out), 64):
                    yield _rows(out[x : x + 64])

    return own.mapInArrow(run, ROWS)


def answered(asks: DataFrame, buckets: int, bound: int) -> DataFrame:
    """For each row of asks one answer byte for each of its kinds."""

    def answers(chunks: list[int], bucket: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(d) for d in data]
        key, tag, several = (np.concatenate([p[k] for p in parts]) for k in range(3))
        sizes = np.array([len(p[0]) for p in parts])
        order = np.lexsort((np.repeat(np.arange(len(parts)), sizes), tag, key))  # of equal ones the first chunk leads
        k, t, s = key[order], tag[order], several[order]
        fresh_key = np.concatenate(([True], k[1:] != k[:-1]))
        fresh = fresh_key | np.concatenate(([True], t[1:] != t[:-1]))
        of_key, of_kind = np.cumsum(fresh_key) - 1, np.cumsum(fresh) - 1
        kinds = np.bincount(of_key, fresh)
        crowded = (np.bincount(of_key, s == 255) > 0) | (kinds > bound)
        again = (np.bincount(of_kind)[of_kind] > 1) | (s == 1)
        code = np.where(crowded[of_key], CROWDED, AGAIN * again + SEND * (fresh & (kinds[of_key] > 1))).astype(np.uint8)
        back = np.empty_like(code)
        back[order] = code
        out = [(c, TOLD, bucket, packed(x)) for c, x in zip(chunks, np.split(back, np.cumsum(sizes)[:-1]), strict=True)]
        for x in range(0, len(out), 1024):
            yield _rows(out[x : x + 1024])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (chunks, data) in _grouped(batches, 2, 0, 3):
            yield from answers(chunks, bucket, data)

    return asks.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, ROWS)


def _grouped(batches: Iterator[pa.RecordBatch], by: int, *columns: int) -> Iterator[tuple[int, list[list]]]:
    """Consecutive rows of one value of a column: that value, and lists of other columns."""
    at, held = None, [[] for _ in columns]
    for batch in batches:
        for row in zip(batch.column(by).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != at and held[0]:
                yield at, held
                held = [[] for _ in columns]
            at = row[0]
            for h, v in zip(held, row[1:], strict=True):
                h.append(v)
    if held[0]:
        yield at, held


def _meeting(parts: int, *rows: DataFrame) -> DataFrame:
    """The rows of a chunk next to each other, its own data last."""
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionByName(r)
    return all_rows.withColumn("own", F.col("kind") == OWN).repartition(parts, "chunk").sortWithinPartitions("chunk", "own").drop("own")


def settled(own: DataFrame, answers: DataFrame, level: int, parts: int, buckets: int, crowd: int, secret: bytes) -> DataFrame:
    """What follows from the answers: spans that are known, runs for buckets, and records to split."""

    def follow(chunk: int, told: dict[int, np.ndarray], data: bytes) -> list[tuple]:
        items = _items(data, level, secret)
        order, kind, first, copies = items.distinct()
        if not len(first):
            return []
        key = items.key[first]
        many, bucket, code = _crowds(key, crowd), _dealt(key, buckets), np.zeros(len(first), np.uint8)
        code[many] = CROWDED
        tell = ~many | np.concatenate(([True], key[1:] != key[:-1]))
        for b, x in told.items():
            code[(bucket == b) & tell] = x
        code[many] = CROWDED
        code[copies > 1] |= AGAIN
        out = []
        if len(hit := order[(code[kind] & AGAIN) > 0]):
            out.append((chunk, HITS, -1, packed(items.place[hit] - items.most[hit], items.place[hit] - items.least[hit] + LENGTH)))
        if (chosen := (code & CROWDED) > 0).any():
            out.append((chunk, SPLIT, -1, coded(items.records(first[chosen]))))
        send = (code & (SEND | CROWDED)) == SEND
        for b in np.unique(bucket[send]).tolist():
            out.append((chunk, RUN, b, coded(items.records(first[send & (bucket == b)]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, kind, bucket = (batch.column(c)[i].as_py() for c in range(3))
                if chunk != at:
                    at, told = chunk, {}
                if kind == TOLD:
                    told[bucket] = unpacked(batch.column(3)[i].as_py())[0]
                elif out := follow(chunk, told, batch.column(3)[i].as_py()):
                    yield _rows(out)

    return _meeting(parts, answers, own).mapInArrow(run, ROWS)


def merged_runs(runs: DataFrame, buckets: int) -> DataFrame:
    """Spans of the windows that occur again, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (chunks, data) in _grouped(batches, 2, 0, 3):
            of, s, e = repeats(data)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(len(chunks) + 1))
            yield _rows([(c, HITS, -1, packed(s[order[a:z]], e[order[a:z]])) for c, a, z in zip(chunks, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if z > a])

    return runs.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, ROWS)


def cut(chunks: DataFrame, spans: DataFrame, parts: int) -> DataFrame:
    """ka, kb, removed (merged spans as arrays) and kept (the bytes that stay) of the texts with spans."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def losses(data: bytes, hits: list[bytes]) -> Iterator[pa.RecordBatch]:
        ka, kb, _, lens, flat = unpacked(data)
        s, e = (np.concatenate([x[k] for x in map(unpacked, hits)]) for k in (0, 1))
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
        ends = np.cumsum(lens)
        of, reach = np.searchsorted(ends, s, side="right"), np.maximum.accumulate(e)
        fresh = np.concatenate(([True], (s[1:] > reach[:-1]) | (of[1:] != of[:-1])))
        s, e, of = s[fresh], np.maximum.reduceat(e, np.flatnonzero(fresh)), of[fresh]
        raw, out, size = flat.tobytes(), [], 0
        for i in np.unique(of).tolist():
            base, mine = int(ends[i] - lens[i]), of == i
            spans = list(zip((s[mine] - base).tolist(), (e[mine] - base).tolist(), strict=True))
            text = raw[base : int(ends[i])]
            left = b"".join(text[a:z] for a, z in zip([0] + [x[1] for x in spans], [x[0] for x in spans] + [len(text)], strict=True))
            out.append((int(ka[i]), int(kb[i]), [{"s": a, "e": z} for a, z in spans], left))
            size += len(left)
            if size > CHUNK or len(out) >= 4096:
                yield lost(out)
                out, size = [], 0
        if out:
            yield lost(out)

    def lost(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), kind, pa.binary()))], ["ka", "kb", "removed", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hits = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if chunk != at:
                    at, hits = chunk, []
                if kind == HITS:
                    hits.append(batch.column(3)[i].as_py())
                elif hits:
                    yield from losses(batch.column(3)[i].as_py(), hits)

    return _meeting(parts, spans, chunks).mapInArrow(run, "ka long, kb long, removed array<struct<s: long, e: long>>, kept binary")


def repeated_passages(docs: DataFrame, chunk: int = CHUNK, crowd: int = CROWD, bound: int = BOUND) -> DataFrame:
    """ka, kb, removed and kept of every text of docs (ka, kb, text) that loses bytes; equal texts have equal rows."""
    chunks = written(chunked(docs.where(f"octet_length(text) >= {LENGTH}"), chunk), "chunks")
    parts = max(shuffle_partitions(docs.sparkSession), -(-chunks.count() // 32))
    own, spans, crowd, bound, secret = chunks, None, max(1, crowd), max(1, bound), secrets.token_bytes(32)
    for level in range(len(WIDTHS)):
        answers = answered(asked(own, level, parts, crowd, secret), parts, bound)
        found = written(settled(own, answers, level, parts, parts, crowd, secret), "settled")
        hits = found.where(f"kind = {HITS}").unionByName(merged_runs(found.where(f"kind = {RUN}"), parts))
        spans = hits if spans is None else spans.unionByName(hits)
        own = found.where(f"kind = {SPLIT}").withColumn("kind", F.lit(OWN))
        if not own.head(1):
            break
    return cut(chunks, written(spans, "spans"), parts)


def deduplicated(df: DataFrame, text: str = "text", **more) -> DataFrame:
    """``df`` with its repeated bytes cut out of the texts, as ``kept`` (binary: a cut may split a character) and ``removed`` (spans)."""
    if {"ka", "kb"} & set(df.columns):
        raise ValueError("columns ka and kb are needed for the work")
    keyed = df.drop("kept", "removed").withColumns(dict(zip(("ka", "kb"), _key(text), strict=True)))
    lost = repeated_passages(keyed.select("ka", "kb", F.col(text).alias("text")), **more).dropDuplicates(["ka", "kb"])
    return keyed.join(lost, ["ka", "kb"], "left").drop("ka", "kb").withColumn("kept", F.coalesce("kept", F.encode(F.coalesce(text, F.lit("")), "utf-8")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what stays of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", *_key("text"), "text")
    raw = F.encode("text", "utf-8")
    whole = keyed.select("doc_id", "ka", "kb", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"))
    lost = repeated_passages(keyed).select("ka", "kb", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n"), F.size("removed").cast("long").alias("k"), F.sha2("kept", 256).alias("left"))
    lost = lost.groupBy("ka", "kb").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("left").alias("left"))
    zero = F.lit(0).cast("long")
    return whole.join(lost, ["ka", "kb"], "left").select("doc_id", "n_bytes", F.coalesce("n", zero).alias("n_removed"), F.coalesce("k", zero).alias("n_spans"), F.coalesce("left", "sha").alias("kept_sha256"))
