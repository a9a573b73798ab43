"""Records of CSV files by many tasks against Spark's reader of one task a file, with splits of a few hundred bytes."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allocspark.sources import csv_import as C
from allocspark.sources import csv_records as R


def test_what_leaves_a_cell_open():
    for line, out, inside in [
        (b"a;b", False, True),
        (b'a;"b', True, True),
        (b'"a";b', False, False),
        (b'a"b;c', False, True),  # no quote of a cell's beginning, nor one before a separator
        (b'";"', False, True),
        (b'a;"b;c"', False, False),
        (b'"a\\";b', True, True),
        (b'x"', False, False),
        (b'"', True, False),
        (b"", False, True),
        (b'"";""', False, False),
        (b'"a" ;"b', True, True),
        (b'"a"b;c"', False, False),
        (b'"a"\r', False, False),
    ]:
        assert (R.ends_inside(line, False), R.ends_inside(line, True)) == (out, inside), line


def test_chained_splits():
    s = lambda file, block, n, end_out, end_in, last_out, last_in: {"file": file, "block": block, "n": n, "end_out": end_out, "end_in": end_in, "last_out": last_out, "last_in": last_in}
    got = R.chained([s("b", 0, 1, False, True, 0, -1), s("a", 9, 3, False, True, 2, -1), s("a", 0, 4, True, False, 3, 1), s("a", 20, 2, True, False, 1, 1)])
    assert got == [("a", 0, False, 0, 0), ("a", 9, True, 4, 4), ("a", 20, True, 7, 4), ("b", 0, False, 0, 0)]


def test_stretches_without_quotes_are_taken_together(spark, tmp_path, monkeypatch):
    plain = "".join(f"{i};x{'\r' if i % 3 == 0 else ''}\n" for i in range(40))
    (tmp_path / "a.csv").write_text(plain + '1;"two\n' + plain + 'lines"\n' + plain + '2;"open\n' + plain, newline="")
    files = [f"file:{tmp_path}/a.csv"]
    together = sorted((x._line, bytes(x.record)) for x in R.records(spark, files).collect())
    assert len(together) == 40 + 1 + 40 + 1 and max(x.count(b"\n") for _, x in together) == 41 and b"\r" not in b"".join(x for _, x in together)
    part = pa.array([b"a"] * 20 + [b'"'] + [b"b"] * 3 + [b'"'] + [b"c"] * 16)
    assert [(whole, len(x)) for whole, x in R._runs(part)] == [(True, 20), (False, 5), (True, 16)]


@pytest.mark.parametrize("most", ["120", "1000", "64m"])
def test_records_as_one_task_would_read_them(spark, tmp_path, most):
    r = random.Random(7)
    cells = ["x", "", "two\nlines", "a;b", 'she said \\"no\\"', "ä ö", "long\n" * 40, " padded ", "1"]
    text = "h1;h2;h3\n"
    for _ in range(300):
        row = [r.choice(cells) for _ in range(r.choice([3, 3, 3, 2, 4]))]
        text += ";".join(f'"{c}"' if r.random() < 0.3 or any(x in c for x in '\n;"') else c for c in row) + r.choice(["\n", "\r\n"])
    for name, encoding in (("a.csv", "utf-8"), ("b.csv", "iso-8859-1")):
        (tmp_path / name).write_bytes(text.encode(encoding))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for name, encoding in (("a.csv", "UTF-8"), ("b.csv", "ISO-8859-1")):
            files = [f"file:{tmp_path}/{name}"]
            assert R.lines(spark, files).rdd.getNumPartitions() > (1 if most != "64m" else 0)
            found = R.parsed(R.records(spark, files), ["a", "b", "c"], encoding).orderBy("_line").collect()
            plain = spark.read.options(sep=";", quote='"', escape="\\", encoding=encoding, header=False, multiLine=True).schema("a string, b string, c string").csv(files).collect()
            pairs = list(zip([tuple(c or None for c in (x.a, x.b, x.c)) for x in found], [tuple(c and c.rstrip("\r") or None for c in (x.a, x.b, x.c)) for x in plain], strict=False))  # that reader leaves \r where a file mixes line ends; the import trims it
            assert [p for p in pairs if p[0] != p[1]][:2] == [] and len(found) == len(plain)
            physical = text.split("\n")
            starts = [x._line for x in found]
            assert starts[0] == 1 and starts == sorted(set(starts)) and all(physical[n - 1].startswith((x.a or "").split("\n")[0][:1]) or physical[n - 1].startswith('"') for n, x in zip(starts, found, strict=True))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_reference_tables_of_any_size_give_the_same_ids(spark, monkeypatch):
    rows = spark.createDataFrame([("Geburtsklinik",), (" kardio  LOGIE",), (None,), ("nobody",), ("Chirurgie",)] * 40, "department string")
    known = spark.createDataFrame([(1, "Geburtshilfe"), (2, "Kardio Logie"), (3, "chirurgie"), (9, "Chirurgie")], "id int, name string")
    want = sorted([1, 2, 3] * 40 + [0] * 80)
    small = C.resolved(rows, known, "department", "department_id", C.DEPARTMENT_ALIASES)
    assert sorted(x.department_id or 0 for x in small.collect()) == want
    monkeypatch.setattr(C, "SMALL", 0)
    large = C.resolved(rows, known, "department", "department_id", C.DEPARTMENT_ALIASES)
    assert sorted(x.department_id or 0 for x in large.collect()) == want and large.columns == small.columns
    assert large.where(F.col("department_id").isNull()).count() == 80
