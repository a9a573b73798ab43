"""Shards by a consistent-hash ring with virtual nodes and bounded loads (operator 6).

Each shard owns many points of a ring of hashes; a key belongs to the owner of the first
point at or after its hash. No shard takes more than its capacity: the keys that come last
within an arc of a full shard continue clockwise to the next owner with room. Which keys
those are follows from the number of keys in each arc alone, so one small count by ring
cell (their number is a parameter, not a matter of the input) goes to the driver, and the
plan that comes back is a table of ranges of places within arcs. Documents are then placed
by a narrow lookup and a numbering within cells.

With no slack, capacities add up to the number of rows and the counts of two shards differ
by one at most: the law ``rows``. With slack, less moves when a shard is added.

A row's key on the ring is its doc_id with the size and crc32 of its text, so that many rows
of one doc_id (or of none) are spread. Rows of equal key and text are told apart by nothing
and share their places in some order. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Bits of a hash that the ring has.
RING_BITS = 32


@dataclass(frozen=True)
class Ring:
    shards: int
    points: int = 64

    def arcs(self) -> list[tuple[int, int]]:
        """(last hash, owner), in order. The arc behind the last point goes on to the first."""
        found = {}
        for s in range(self.shards):
            for v in range(self.points):
                h = int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") >> (64 - RING_BITS)
                found.setdefault(h, s)
        return sorted(found.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard takes at most."""
    if slack:
        return [-(-int(rows * (1 + slack) * 1000) // (1000 * shards)) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: list[int], owners: list[int], most: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first place, end place, shard, shard's slot of the first place) for keys numbered within their arcs.

    Arcs are served in ring order, each from its first key on; then what has overflown walks
    clockwise together, arc by arc, until every key has found room.
    """
    room = list(most)
    used = [0] * len(most)
    out = []

    def take(arc: int, start: int, end: int, shard: int) -> int:
        n = min(end - start, room[shard])
        if n:
            out.append((arc, start, start + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return start + n

    over = []
    for arc, (n, owner) in enumerate(zip(counts, owners, strict=True)):
        at = take(arc, 0, n, owner)
        if at < n:
            over.append((arc, at, n))
    for arc, at, n in over:
        step = 1
        while at < n:
            at = take(arc, at, n, owners[(arc + step) % len(owners)])
            step += 1
            if step > 2 * len(owners):
                raise ValueError("capacities hold fewer rows than there are")
    return out


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slack: float = 0.0, points: int = 64, cells: int = 4096) -> DataFrame:
    """Each row's key, size, crc32 of its text, shard and slot within the shard.

    ``cells``: equal parts of the ring that rows are numbered in; choose more of them for
    more rows, as each is sorted by itself.
    """
    spark = df.sparkSession
    arcs = Ring(shards, points).arcs()
    ends = [h for h, _ in arcs]
    width = 2**RING_BITS // cells
    # A piece is a part of one arc within one cell. Pieces are numbered in ring order.
    cuts = sorted({*ends, *(c * width + width - 1 for c in range(cells))})
    arc_of = [bisect_left(ends, c) % len(ends) for c in cuts]

    raw = F.coalesce(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8"), F.lit(b""))
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    ring = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "size", "text_crc32"), 64 - RING_BITS)
    rows = rows.withColumn("ring", ring)
    # The cell by division, then the few cuts inside it by a short lookup.
    inner: dict[int, list[int]] = {}
    for i, c in enumerate(cuts):
        inner.setdefault(c // width, []).append(i)
    pieces = spark.createDataFrame([(c, [(cuts[i], i) for i in found]) for c, found in inner.items()], "cell long, cuts array<struct<cut long, piece int>>")
    located = rows.withColumn("cell", F.floor(F.col("ring") / width).cast("long")).join(F.broadcast(pieces), "cell")
    located = located.withColumn("piece", F.expr("filter(cuts, c -> ring <= c.cut)[0].piece")).drop("cuts", "cell")
    counts = {r["piece"]: r["n"] for r in located.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_arc = [0] * len(arcs)
    # The arc behind the last point begins at the ring's end and goes on at its start.
    order = sorted(range(len(cuts)), key=lambda i: (arc_of[i], cuts[i] <= arcs[0][0] if arc_of[i] == 0 else False, cuts[i]))
    start = {}
    for i in order:
        start[i] = by_arc[arc_of[i]]
        by_arc[arc_of[i]] += counts.get(i, 0)
    ranges = plan(by_arc, [o for _, o in arcs], capacities(sum(by_arc), shards, slack))
    of_arc: dict[int, list] = {}
    for arc, a, z, shard, slot in ranges:
        of_arc.setdefault(arc, []).append((a, z, shard, slot))
    moves = spark.createDataFrame([(i, start[i], of_arc.get(arc_of[i], [])) for i in range(len(cuts))], "piece int, start long, ranges array<struct<a long, z long, shard int, slot long>>")
    numbered = located.withColumn("place", F.row_number().over(Window.partitionBy("piece").orderBy("ring", "doc_id", "text_crc32", "size")).cast("long") - 1)
    placed = numbered.join(F.broadcast(moves), "piece").withColumn("place", F.col("place") + F.col("start"))
    return placed.withColumn("found", F.expr("filter(ranges, r -> place >= r.a AND place < r.z)[0]")).select("doc_id", "size", "text_crc32", F.col("found.shard").alias("shard"), (F.col("found.slot") + F.col("place") - F.col("found.a")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts (law ``rows``)."""
    placed = assign(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
