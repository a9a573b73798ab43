"""Counts of hashed items in a fixed number of buckets, and bitmaps of the buckets that hold enough.

A bucket's count is at least that of each item in it, so an item whose bucket holds too few
can't be frequent: bitmaps prune and never decide. Counts stop at ``least``, the most that
matters. A task counts into one byte array; tasks' arrays travel in parts, as places and
counts where they aren't zero, and are added up part by part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .suffix_runs import packed, unpacked

PART = 1 << 16


class Buckets:
    """Counts of one task."""

    def __init__(self, size: int, least: int) -> None:
        self.count, self.least = np.zeros(size, np.uint8), min(least, 255)

    def add(self, hashes: np.ndarray, n: np.ndarray) -> None:
        """Count distinct hashed items n times each."""
        at = (hashes % np.uint64(len(self.count))).astype(np.int64)
        places, inverse = np.unique(at, return_inverse=True)
        total = np.bincount(inverse, np.minimum(n, self.least), len(places)) + self.count[places]
        self.count[places] = np.minimum(total, self.least).astype(np.uint8)

    def parts(self) -> Iterator[tuple[int, bytes]]:
        for a in range(0, len(self.count), PART):
            own = self.count[a : a + PART]
            if len(places := np.flatnonzero(own)):
                yield a // PART, packed(places.astype(np.uint16), own[places])


def bitmap(rows: DataFrame, size: int, least: int) -> np.ndarray:
    """The bits (size / 8 bytes) of buckets whose counts of all tasks reach ``least``, from rows (part, data)."""
    least = min(least, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(PART, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != at:
                    if at is not None:
                        yield done()
                    at, total = part, np.zeros(PART, np.int64)
                places, n = unpacked(data)
                total[places] += n
        if at is not None:
            yield done()

    dealt = rows.select("part", "data").repartition(shuffle_partitions(rows.sparkSession), "part").sortWithinPartitions("part")
    out = np.zeros(max(1, size // 8), np.uint8)
    for r in dealt.mapInArrow(run, "part int, bits binary").toLocalIterator():  # size / 8 bytes in all
        bits = np.frombuffer(r["bits"], np.uint8)
        a = r["part"] * PART // 8
        out[a : a + PART // 8] = bits[: len(out) - a]
    return out


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of these hashes are set."""
    at = hashes % np.uint64(len(bits) * 8)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def items_bitmap(rows: DataFrame, hashes, size: int) -> np.ndarray:
    """The bits of all items of rows; hashes(batch) gives theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Buckets(size, 1)
        for batch in batches:
            if batch.num_rows:
                h = hashes(batch)
                own.add(h, np.ones(len(h), np.int64))
        for part, data in own.parts():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

    return bitmap(rows.mapInArrow(run, "part int, data binary"), size, 1)
