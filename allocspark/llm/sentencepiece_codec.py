"""SentencePiece encoding and decoding (operator 1).

Encoding runs vectorised merge rounds over flat symbol arrays (see ``bpe``); Spark only
deals out the texts, nothing is shuffled. Null and empty texts have no ids; a text of any
length is taken whole; rows keep all their other columns, and a column that already bears
the output's name is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PieceModel
from .common import replaced, slices, table, texts_of


@functools.lru_cache(maxsize=1)
def model(path: str) -> PieceModel:
    """One for each Python worker, whatever number of tasks it runs."""
    return PieceModel(path)


def _schema(df: DataFrame, out: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, kind)])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the array of ids of each text, without begin or end ids; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index(text)))
            for a, b in slices(texts):
                ids = model(path).encode_texts(texts[a:b])
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                yield replaced(batch.slice(a, b - a), {out: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))})

    return df.mapInArrow(run, _schema(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each array of ids; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [model(path).decode(x or []) for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield replaced(part, {out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, _schema(df, out, T.StringType()))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ids and their decoding, ``decoded``, in one pass: each task needs one worker and one model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index(text)))
            for a, b in slices(texts):
                ids = model(path).encode_texts(texts[a:b])
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                back = [model(path).decode(np.frombuffer(x, "<i4").tolist()) for x in ids]
                yield replaced(batch.slice(a, b - a), {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))), "decoded": pa.array(back, pa.string())})

    return df.mapInArrow(run, _schema(df.drop("ids", "decoded"), "ids", T.ArrayType(T.IntegerType())).add(T.StructField("decoded", T.StringType())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
