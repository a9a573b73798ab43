"""Deduplication import by import against ranking everything, and the review of raw indications by rows made by hand."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from allocspark.operators import dedup_index as D
from allocspark.operators import raw_review as R
from allocspark.operators.maintenance import OPTIONAL, PRINT, _repeated, deduplicated
from allocspark.operators.store import Store
from allocspark.sources.binding import allocations_by_import, raw_allocations

KIND = "fact_key string, import_id int, hospital_id int, case_id long, created_at timestamp_ntz, arrival_at timestamp_ntz, age int, gender_code int, urgency_code int, speciality_id int, department_id int, assignment_id int, dispatch_area_id int, indication_raw_id int, notes string, assessment_id int, secondary_indication_id int, occasion_id int, infection_id int"
assert {*PRINT, *OPTIONAL} <= {c.split()[0] for c in KIND.split(", ")}


def rows_of(spark, seed, imports):
    """Few different events, so that copies meet within and between imports, with and without case ids."""
    r = random.Random(seed)
    rows = []
    for import_id in imports:
        for k in range(25):
            at = dt.datetime(1997, r.randint(1, 3), r.randint(1, 2), 5)
            rows.append((f"{import_id}-{k}", import_id, r.randint(1, 2), r.choice([None, 1, 2]), at, at, r.choice([None, 40]), 1, 1, 1, 1, 1, 1, r.choice([None, 7]), r.choice([None, "", "x"]), r.choice([None, 1, k]), None, r.choice([None, 2]), None))
    return spark.createDataFrame(rows, KIND)


def standing(store):
    return sorted(r.fact_key for r in store.read(D.CASES).collect())


def ranked(rows):
    return sorted(r.fact_key for r in deduplicated(rows).collect())


def test_each_import_leaves_what_ranking_all_rows_would(spark, tmp_path):
    rows, store = rows_of(spark, 1, (3, 1, 2, 5, 4)), Store(spark, str(tmp_path))
    D.built(store, rows.where("import_id = 3"))
    done = [3]
    for import_id in (1, 2, 5, 4):  # an older import may come later
        before = set(standing(store))
        counts = D.applied(store, import_id, rows)
        done.append(import_id)
        seen = rows.where(F.col("import_id").isin(done))
        assert standing(store) == ranked(seen)
        gone = store.read(D.REMOVED, [import_id])
        own = {r.fact_key: r.attribution for r in gone.collect()} if gone is not None else {}
        assert {k for k, a in own.items() if a == "other"} == before - set(standing(store))
        assert counts == {a: sum(x == a for x in own.values()) for a in ("current", "other")} and all((a == "current") == k.startswith(f"{import_id}-") for k, a in own.items())
    assert sorted(r.fact_key for r in D.kept(rows, store).collect()) == ranked(rows)
    D.withdrawn(store, 5, rows)
    assert standing(store) == ranked(rows.where("import_id <> 5")) and "5" not in store.parts(D.REMOVED)
    gone = store.read(D.REMOVED).where("assessment_id IS NOT NULL")
    left = {r.assessment_id for r in store.read(D.CASES).collect()}
    assert {r.assessment_id for r in D.orphaned_assessments(store).collect()} == {r.assessment_id for r in gone.collect()} - left
    assert D.applied(store, 99, rows) == {"current": 0, "other": 0}


def test_months_that_an_import_does_not_touch_are_left_alone(spark, tmp_path):
    rows, store = rows_of(spark, 2, (1, 2)), Store(spark, str(tmp_path))
    D.built(store, rows.where("import_id = 1"))
    january = store.state()[D.CASES]["1997-01"]
    D.applied(store, 2, rows.where("import_id = 1 OR created_at >= '1997-02-01'"))
    assert store.state()[D.CASES]["1997-01"] == january and {"1997-02", "1997-03"} <= set(store.parts(D.CASES))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cases_are_moved_once_to_be_ranked_and_written(spark):
    class Seen:
        def replace_by(self, table, key, rows, laid=False):
            self.laid, self.plan = laid, planned(rows)

    seen = Seen()
    D._put_cases(seen, rows_of(spark, 3, (1, 2)))
    assert seen.laid and seen.plan.count("Exchange") == 1


def test_repeated_rows_join_no_tables_and_an_import_reads_its_own_files(spark):
    sf = "/root/testdata/sf0.001"
    rows, raw = allocations_by_import(spark, sf), raw_allocations(spark, sf)
    rows = rows.select(*raw.columns)
    assert rows.schema == raw.schema and rows.count() == raw.count() and not rows.exceptAll(raw).count()
    assert "Join" not in planned(_repeated(spark, sf))
    own = planned(_repeated(spark, sf).where("import_id = 200105"))
    assert own.count("PartitionFilters: []") == 0 and own.count("PartitionFilters: [") == 3


def used(spark):
    at = lambda d: dt.datetime(1997, 1, d)
    rows = [("a", 1, 5, None, at(1)), ("b", 1, 5, 6, at(2)), ("c", 2, 6, 5, at(3)), ("d", 9, 7, 7, at(4)), ("e", 1, None, 5, at(5)), ("f", 1, 5, None, at(5)), ("g", 1, None, None, at(6))]
    return spark.createDataFrame(rows, "fact_key string, hospital_id int, indication_raw_id int, secondary_indication_raw_id int, created_at timestamp_ntz")


def test_uses_are_counted_by_the_raw_id_of_either_kind(spark):
    raw = spark.createDataFrame([(5,), (6,), (7,), (8,)], "raw_id int")
    assert sorted(tuple(r) for r in R.occurrences(used(spark), raw).collect()) == [(5, 5, 3, 2), (6, 2, 1, 1), (7, 2, 1, 1), (8, 0, 0, 0)]
    homes = spark.createDataFrame([(1, "one"), (2, "two")], "hospital_id int, hospital_name string")
    got = sorted((r.raw_id, r.position, r.fact_key, r.hospital_name) for r in R.samples(used(spark), homes, 3).collect())
    assert got == [(5, 1, "e", "one"), (5, 2, "f", "one"), (5, 3, "c", "two"), (6, 1, "c", "two"), (6, 2, "b", "one"), (7, 1, "d", None)]


def test_segments_of_the_review(spark):
    at = lambda m, d: dt.datetime(1997, m, d)
    raw = spark.createDataFrame([(1, "unreviewed", at(5, 30)), (2, "needs_review", at(5, 31)), (3, "unreviewed", at(6, 29)), (4, "matched", at(6, 29)), (5, "ignored", None), (6, None, None)], "raw_id int, review_status string, created_at timestamp_ntz")
    assert {r.segment: r.n for r in R.segments(raw, "1997-06-30 00:00:00").collect()} == {"open": 3, "new": 2, "unreviewed": 2, "needs_review": 1, "matched": 1, "not_matchable": 0, "ignored": 1}
    assert [r.raw_id for r in R.top_open(used(spark), spark.createDataFrame([(5, "matched"), (6, "unreviewed"), (7, "unreviewed"), (8, "needs_review")], "raw_id int, review_status string"), 2).collect()] == [6, 7]


def test_imports_whose_removal_takes_hospitals_away(spark):
    rows = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (2, 11), (3, 12)], "hospital_id int, import_id int")
    assert sorted(tuple(r) for r in R.removals(rows).collect()) == [(10, True, 1), (11, False, 0), (12, True, 1)]
    assert R.introduces(rows.where("import_id = 12"), rows.where("import_id < 12")) and not R.introduces(rows.where("import_id = 12"), rows) and not R.introduces(rows.where("import_id = 11"), rows.where("import_id = 10"))
