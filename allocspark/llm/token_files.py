"""Token-ID files (operator 9).

Documents are dealt out by ranges of doc_id (and of a hash of the text, where many share
one), encoded, and packed into segments of patched frame-of-reference blocks (see ``pfor``).
The ids are the tokenizers library's: it encodes every text that holds more than Latin
letters; the words of the others are merged in numpy, which is held against the library and
takes under half of its time (``bpe.LibraryWords`` asks it for each word). The segments are the rows of a table
with one binary column beside their keys, so Spark's commit protocol writes them: a task
that is run again leaves one copy, and any store will do. Reading needs no order: a
segment knows its range partition and the values before it there, and the few sums by
partition give its place among all ids.

Null and empty texts give the end id alone. Rows of equal doc_id lie next to each other in
the order of their texts' hashes; null doc_ids come first.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pfor
from .bpe import WordModel
from .common import SLICE_CHARS, shared_dir, shuffle_partitions, table, texts_of

SEGMENTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_values", T.LongType()), T.StructField("segment", T.BinaryType())])


@functools.lru_cache(maxsize=1)
def model(path: str) -> WordModel:
    """One for each Python worker, whatever number of tasks it runs; the library's own threads are off, as tasks share the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordModel(path)


def write(df: DataFrame, path: str, to: str, end_id: int = 2, key: str = "doc_id", text: str = "text", segment_values: int = 1 << 20) -> None:
    """Write the ids of all texts, each with the end id behind it, in ascending order of ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        keys: list = []
        ids: list[bytes] = []
        held = 0
        end = np.array([end_id], "<i4").tobytes()

        def segment() -> pa.RecordBatch:
            lens = np.array([len(x) // 4 for x in ids], np.int64)
            values = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([len(values)], pa.int64()), pa.array([pfor.pack(values, lens)], pa.binary())], ["part", "before", "doc_ids", "n_values", "segment"])

        pending: list[str] = []
        size = 0

        def encoded() -> int:
            got = [x + end for x in model(path).encode_texts(pending)]
            ids.extend(got)
            return sum(len(x) // 4 for x in got)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                keys.append(k)
                pending.append(t)
                size += len(t)
                if size >= SLICE_CHARS:
                    held += encoded()
                    pending, size = [], 0
                    if held >= segment_values:
                        yield segment()
                        before, held = before + held, 0
                        keys, ids = [], []
        if pending:
            encoded()
        if keys:
            yield segment()

    ordered = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange(shuffle_partitions(df.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(run, SEGMENTS).write.parquet(to)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document: doc_id, start (ids of all documents before it), ids."""
    return _read(spark, path, T.StructField("ids", T.ArrayType(T.IntegerType())), lambda ids, lens: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32)), pa.array(ids.astype(np.int32))))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As read(), with the length and crc32 of the ids in their place."""

    def crc(ids: np.ndarray, lens: np.ndarray) -> pa.Array:
        data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lens, dtype=np.int64) * 4
        return pa.array([zlib.crc32(data[a:b]) for a, b in zip((ends - lens.astype(np.int64) * 4).tolist(), ends.tolist(), strict=True)], pa.int64())

    return _read(spark, path, T.StructField("ids_crc32", T.LongType()), crc)


def _read(spark: SparkSession, path: str, field: T.StructField, make) -> DataFrame:
    stored = spark.read.schema(SEGMENTS).parquet(path)
    # A row for each range partition: its place among all ids. Partition numbers follow the ranges.
    sums = stored.groupBy("part").agg(F.sum("n_values").alias("n")).collect()
    base, at = {}, 0
    for row in sorted(sums, key=lambda r: r["part"]):
        base[row["part"]] = at
        at += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, keys, segment = (batch.column(c)[row].as_py() for c in ("part", "before", "doc_ids", "segment"))
                lens = pfor.lengths(segment)
                start = base[part] + before + np.concatenate(([0], np.cumsum(lens, dtype=np.int64)[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start, pa.int64()), pa.array(lens.astype(np.int64)), make(pfor.unpack(segment), lens)], ["doc_id", "start", "n_tokens", field.name])

    out = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens")] + [field])
    return stored.select("part", "before", "doc_ids", "segment").mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and crc32, from the files read back."""
    import public_tokenizers

    to = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), to)
    return digests(spark, to)
