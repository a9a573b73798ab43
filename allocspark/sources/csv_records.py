"""Records of CSV files, found by many tasks a file.

A file is read in splits of lines. Whether a split begins inside a quoted cell depends on all
text before it, so a first pass sums each split up for both cases: its lines, whether it
ends inside a cell, and where its last record begins. These small sums are chained from split
to split on the driver, one row each as in the listing of files. A second pass cuts the
lines into records; only the pieces of a record that crosses a border of splits are moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A quote that ends a cell: not escaped, and before a separator or the end of the line.
_CLOSING = re.compile(rb'(?:[^"\\]|\\.|\\$|"(?![ \t]*(?:;|\r?$)))*+"[ \t]*(?=;|\r?$)', re.DOTALL)
#: Least number of lines without a quote that are taken together.
PLAIN = 16
#: Lines of a split: the file, the byte at which the split begins, the line's bytes.
_PLACE = ("file", "block")


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line leaves a quoted cell open, by whether it begins in one."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            closing = _CLOSING.match(line, at)
            if closing is None:
                return True
            inside, at = False, closing.end() + 1  # past the separator
        elif line[at : at + 1] == b'"':
            inside, at = True, at + 1
        else:
            separator = line.find(b";", at)
            if separator < 0:
                return False
            at = separator + 1
        if not inside and at > len(line):
            return False


def lines(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _splits(batches: Iterator[pa.RecordBatch], more: int = 0) -> Iterator[tuple[tuple, pa.Array]]:
    """Batches of lines of one split each, with its place and further columns that are the same for all its lines."""
    for batch in batches:
        file, block, n = batch.column(0), batch.column(1), batch.num_rows
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])) if n > 1 else pa.array([], pa.bool_())
        ends = [*(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for a, z in zip([0, *ends[:-1]], ends, strict=True):
            if z > a:
                yield tuple(batch.column(c)[a].as_py() for c in (0, 1, *range(3, 3 + more))), batch.column(2)[a:z]


def _runs(part: pa.Array) -> Iterator[tuple[bool, pa.Array]]:
    """Lines in order: stretches without any quote (True), which need no look at single lines, and others."""
    a, n = 0, len(part)
    quoted = np.flatnonzero(pc.match_substring(part, pattern='"').to_numpy(zero_copy_only=False))
    ends = np.append(quoted, n)
    begins = np.append(0, quoted + 1)
    for i in np.flatnonzero(ends - begins >= PLAIN):
        if begins[i] > a:
            yield False, part[a : begins[i]]
        yield True, part[begins[i] : ends[i]]
        a = int(ends[i])
    if a < n:
        yield False, part[a:]


def _without_return(found: pa.Array) -> pa.Array:
    """Lines without a carriage return at the end."""
    ends = pc.ends_with(found, pattern="\r")
    return pc.if_else(ends, pc.binary_slice(found, 0, -1), found) if pc.any(ends).as_py() else found


def summed(rows: DataFrame) -> DataFrame:
    """file, block, n (lines), and for a beginning outside and inside of a cell: whether it ends inside, and the last line that begins a record (-1: none)."""
    names = [*_PLACE, "n", "end_out", "end_in", "last_out", "last_in"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, state, last = None, 0, [False, True], [-1, -1]

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*at, n, *state, *last), kinds, strict=True)], names)

        for place, part in _splits(batches):
            if place != at:
                if at is not None:
                    yield done()
                at, n, state, last = place, 0, [False, True], [-1, -1]
            for plain, found in _runs(part):
                if plain:
                    n += len(found)
                    last = [at_ if inside else n - 1 for at_, inside in zip(last, state, strict=True)]
                    continue
                for line in found.to_pylist():
                    for k in (0, 1):
                        if not state[k]:
                            last[k] = n
                        state[k] = ends_inside(line, state[k])
                    n += 1
        if at is not None:
            yield done()

    return rows.mapInArrow(run, "file string, block long, n long, end_out boolean, end_in boolean, last_out long, last_in long")


def chained(sums: list) -> list[tuple[str, int, bool, int, int]]:
    """file, block, whether it begins inside a cell, lines before it, and the line (from 1) of the record that is open then (0: none)."""
    out, file, inside, before, opened = [], None, False, 0, 0
    for s in sorted(sums, key=lambda s: (s["file"], s["block"])):
        if s["file"] != file:
            file, inside, before, opened = s["file"], False, 0, 0
        out.append((file, s["block"], inside, before, opened))
        last = s["last_in"] if inside else s["last_out"]
        opened = before + last + 1 if last >= 0 else opened
        inside, before = (s["end_in"] if inside else s["end_out"]), before + s["n"]
    return out


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """_file, _line (of its beginning, from 1) and record (bytes) of every record of the files, line breaks within cells as one \\n each."""
    found = lines(spark, files)
    starts = spark.createDataFrame(chained(summed(found).collect()), "file string, block long, inside boolean, before long, opened long")  # one row a split
    names = ["_file", "_line", "at", "record", "whole"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        inside, before, opened, held, first, cut = False, 0, 0, [], 0, False

        def piece(whole: bool) -> tuple:
            return at[0], opened, first, b"\n".join(held), whole and not cut

        for (file, block, starts_inside, lines_before, open_line), part in _splits(batches, 3):
            out = []
            if (file, block) != at:
                if held:
                    out.append(piece(False))  # it goes on in the next split, or the file ends in a cell
                at, inside, before, opened, held, cut = (file, block), starts_inside, lines_before, open_line, [], starts_inside
            for plain, found in _runs(part):
                if plain and not inside:
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
                        out = []
                    n, line_of = len(found), pa.array(np.arange(before + 1, before + len(found) + 1))
                    before, opened, cut = before + n, before + n, False
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), n), line_of, line_of, _without_return(found), pa.repeat(pa.scalar(True), n)], names)
                    continue
                for line in found.to_pylist():
                    before += 1
                    if not inside:
                        opened, cut = before, False
                    if not held:
                        first = before
                    inside = ends_inside(line, inside)
                    held.append(line.removesuffix(b"\r"))
                    if not inside:
                        out.append(piece(True))
                        held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(piece(False), kinds, strict=True)], names)

    placed = found.join(F.broadcast(starts), list(_PLACE)).select(*_PLACE, "line", "inside", "before", "opened")  # splits are few beside lines
    cut = placed.mapInArrow(run, "_file string, _line long, at long, record binary, whole boolean")
    pieces = cut.where("NOT whole").groupBy("_file", "_line").agg(F.sort_array(F.collect_list(F.struct("at", "record"))).alias("p"))  # the pieces of one record
    joined = pieces.select("_file", "_line", F.aggregate("p", F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x["record"]).otherwise(F.concat(a, F.lit(b"\n"), x["record"]))).alias("record"))
    return cut.where("whole").select("_file", "_line", "record").unionByName(joined)


def parsed(found: DataFrame, names: list[str], encoding: str) -> DataFrame:
    """_file, _line and the cells of records: cut or filled up to the names.

    Exploded from an array of one, so that a record is parsed once and not again for each cell.
    """
    schema = ", ".join(f"`{n}` string" for n in names)
    text: Column = F.decode("record", encoding)
    cells = F.from_csv(text, schema, {"sep": ";", "quote": '"', "escape": "\\", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    return found.select("_file", "_line", F.explode(F.array(cells)).alias("c")).select("_file", "_line", "c.*")
