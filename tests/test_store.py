"""Changes of several tables at once, views that are refreshed while they are read, and local days over both changes of the clock."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from allocspark.functions.local_days import bounds, local_day, local_month, today, within
from allocspark.operators import local_kpis as K
from allocspark.operators.store import Conflict, Store, dropped_import, refreshed_views, replaced_import


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "import_id int, x int")
    with s.change() as change:
        change.replace_by("a", F.col("import_id"), rows)
        change.replace_by("b", F.col("import_id"), rows.withColumn("y", F.col("x") * 2))
    return s


def rows_of(s, name, **more):
    return sorted(tuple(r) for r in s.read(name, **more).collect())


class Killed(BaseException):
    """No handler of exceptions sees it, as if the run had been killed."""


@pytest.mark.parametrize("after", ["a", "b", "state"])
def test_a_run_that_dies_leaves_the_old_state_in_all_tables(spark, store, after, monkeypatch):
    before = {t: rows_of(store, t) for t in "ab"}
    new = spark.createDataFrame([(1, 99)], "import_id int, x int")
    write = Store._write

    def dying(self, name, text):
        if after == "state" and name.startswith("commits/"):
            raise Killed
        write(self, name, text)

    monkeypatch.setattr(Store, "_write", dying)
    with pytest.raises(Killed), store.change() as change:
        change.replace("a", 1, new)
        if after == "a":
            raise Killed
        change.replace("b", 1, new.withColumn("y", F.lit(1)))
        if after == "b":
            raise Killed
    monkeypatch.undo()
    assert {t: rows_of(store, t) for t in "ab"} == before
    left = store.folders("journal")
    assert len(left) == 1 and len(store.recovered()) == (1 if after == "a" else 2) and store.folders("journal") == []
    assert {t: rows_of(store, t) for t in "ab"} == before and len(store.folders("data")) == 2
    replaced_import(store, 1, {"a": new, "b": new.withColumn("y", F.lit(1))})
    assert all((1, 99) == r[:2] for t in "ab" for r in rows_of(store, t) if r[0] == 1)


def test_a_commit_that_was_created_but_not_filled_is_removed(store):
    before = rows_of(store, "a")
    (Path(store.root) / "commits" / "00000002").write_text("")
    store.recovered()
    assert store.version() == 1 and rows_of(store, "a") == before


def test_a_failing_job_is_rolled_back(spark, store):
    before = {t: rows_of(store, t) for t in "ab"}
    bad = spark.range(1).select(F.lit(1).alias("import_id"), F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"), store.change() as change:
        change.drop("b", 0)
        change.replace("a", 1, bad)
    assert {t: rows_of(store, t) for t in "ab"} == before and store.folders("journal") == [] and len(store.folders("data")) == 2


def test_drops_count_and_come_twice(store):
    assert dropped_import(store, 2) == {"a": 10, "b": 10} and dropped_import(store, 2) == {"a": 0, "b": 0}
    assert {r[0] for r in rows_of(store, "b")} == {0, 1} and store.read("a", [2]) is None and store.parts("a") == ["0", "1"]


def test_changes_of_other_parts_are_both_kept_and_of_the_same_conflict(spark, store):
    one = spark.createDataFrame([(0, -1)], "import_id int, x int")
    with store.change() as first:
        first.replace("a", 0, one)
        with store.change() as second:
            second.replace("a", 1, one)
    assert rows_of(store, "a", parts=[0]) == rows_of(store, "a", parts=[1]) == [(0, -1)]
    with pytest.raises(Conflict), store.change() as first:
        first.replace("a", 0, one)
        replaced_import(store, 0, {"a": one})
    assert store.folders("journal") == []


def test_readers_end_with_the_rows_they_began_with(spark, store):
    reader, view = store.read("a"), spark.range(5)
    assert refreshed_views(store, {"v": lambda: view}) == {"v": "refreshed"}
    old = store.read("v")
    told = refreshed_views(store, {"v": lambda: spark.range(7), "w": lambda: spark.range(1).select(F.raise_error(F.lit("broken")))})
    assert told["v"] == "refreshed" and told["w"].startswith("failed: ") and len(told["w"]) > 20
    assert old.count() == 5 and store.read("v").count() == 7 and store.read("w") is None
    assert refreshed_views(store, {"v": lambda: spark.range(1).select(F.raise_error(F.lit("broken")))})["v"].startswith("failed") and store.read("v").count() == 7
    replaced_import(store, 0, {"a": spark.createDataFrame([(0, 7)], "import_id int, x int")})
    assert reader.count() == 30 and store.read("a").count() == 21
    gone = store.retired(keep=1)
    assert gone == 1 and store.read("v").count() == 7 and store.read("a").count() == 21  # the first version of the view


def test_local_days_have_23_24_or_25_hours():
    hours = lambda d: (lambda b: (b[1] - b[0]).total_seconds() / 3600)(bounds(d, d))
    assert [hours(dt.date(1997, *d)) for d in ((3, 29), (3, 30), (3, 31), (10, 25), (10, 26), (10, 27))] == [24, 23, 24, 24, 25, 24]
    assert bounds(dt.date(1997, 3, 30), dt.date(1997, 3, 30)) == (dt.datetime(1997, 3, 29, 23), dt.datetime(1997, 3, 30, 22))
    assert today(dt.datetime(1997, 12, 31, 22, 59)) == dt.date(1997, 12, 31) and today(dt.datetime(1997, 12, 31, 23)) == dt.date(1998, 1, 1)


def test_instants_at_the_edges_of_local_days(spark):
    at = ["1997-03-29 22:59:59", "1997-03-29 23:00:00", "1997-03-30 21:59:59", "1997-03-30 22:00:00", "1997-10-25 22:00:00", "1997-10-26 22:59:59", "1997-10-26 23:00:00", None]
    rows = spark.createDataFrame([(a,) for a in at], "t string").select(F.to_timestamp_ntz("t").alias("t"))
    want = ["1997-03-29", "1997-03-30", "1997-03-30", "1997-03-31", "1997-10-26", "1997-10-26", "1997-10-27", None]
    assert [None if r[0] is None else str(r[0]) for r in rows.select(local_day("t")).collect()] == want
    for d in ("1997-03-30", "1997-10-26"):
        day = dt.date.fromisoformat(d)
        assert rows.where(within("t", day, day)).count() == want.count(d)
    assert str(rows.where("t = '1997-10-25 22:00:00'").select(local_month("t")).first()[0]) == "1997-10-01"


LOG = "created_at timestamp_ntz, hospital_id int, status string, n_rows long, n_rejected long"


def log_of(spark, *rows):
    return spark.createDataFrame([(dt.datetime.fromisoformat(t), h, s, n, 0) for t, h, s, n in rows], LOG)


def test_only_days_that_late_rows_touch_are_recomputed(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    old = log_of(spark, ("1997-03-28 12:00", 1, "completed", 5), ("1997-03-30 10:00", 1, "failed", None), ("1997-03-31 10:00", 2, "completed", 3), ("1997-02-01 10:00", 1, "cancelled", 1), ("1997-02-02 10:00", 1, "running", 9))
    K.aggregated(s, old)
    february = s.state()["kpi_days"]["1997-02"]
    late = log_of(spark, ("1997-03-29 23:30", 2, "partial", 7), ("1997-03-28 23:30", 3, "completed", 100), ("1997-02-01 11:00", 3, "completed", 100))
    now = dt.datetime(1997, 3, 31, 9)
    assert K.recomputed(s, old.unionByName(late), late, now) == [dt.date(1997, 3, 30)]
    assert s.state()["kpi_days"]["1997-02"] == february
    got = sorted((str(r.day), r.hospital_id or 0, r.imports, r.successful, r.failed, r.n_rows) for r in s.read("kpi_days").collect())
    assert got == [
        ("1997-02-01", 0, 1, 0, 0, 1), ("1997-02-01", 1, 1, 0, 0, 1),
        ("1997-03-28", 0, 1, 1, 0, 5), ("1997-03-28", 1, 1, 1, 0, 5),
        ("1997-03-30", 0, 2, 1, 1, 7), ("1997-03-30", 1, 1, 0, 1, 0), ("1997-03-30", 2, 1, 1, 0, 7),
        ("1997-03-31", 0, 1, 1, 0, 3), ("1997-03-31", 2, 1, 1, 0, 3),
    ]
    version = s.version()
    assert K.recomputed(s, old, late.where("created_at < '1997-03-01'"), now) == [] and s.version() == version
    assert K.recomputed(s, log_of(spark, ("1997-03-31 10:00", 2, "running", 3)), log_of(spark, ("1997-03-31 10:00", 2, "running", 3)), now) == [dt.date(1997, 3, 31)]
    assert not s.read("kpi_days").where("day = '1997-03-31'").count() and s.read("kpi_days").where("day = '1997-03-30'").count() == 3
