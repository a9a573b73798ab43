"""Definitions of the semantic layer on rows whose results were worked out by hand, apart from any SQL."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from allocspark.functions import semantics as S
from allocspark.operators import slices
from allocspark.plans import analysis
from allocspark.plans.spec import Analysis
from allocspark.sources import binding


def keys(spark, dimension, column, values, kind="int"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {column} {kind}")
    return [r[0] for r in rows.orderBy("i").select(F.expr(S.DIMENSIONS[dimension])).collect()]


def test_ages_have_three_groupings(spark):
    ages = [None, -1, 0, 17, 18, 19, 29, 30, 39, 89, 90, 99, 100]
    assert keys(spark, "age_group", "age", ages) == ["unknown", "unknown", "0_18", "0_18", "0_18", "19_29", "19_29", "30_39", "30_39", "80_89", "90_99", "90_99", "unknown"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, age int").orderBy("i")
    assert [r[0] for r in rows.select(F.expr(S.ages(17))).collect()] == ["unknown", "unknown", "0_17", "0_17", "18_29", "18_29", "18_29", "30_39", "30_39", "80_89", "90_99", "90_99", "unknown"]
    pattern = S.steps([(18, "'0-17'"), (40, "'18-39'"), (65, "'40-64'")], "age", "'65-99'")
    assert [r[0] for r in rows.where("age IS NULL OR age IN (0, 18, 39)").select(F.expr(pattern)).collect()] == ["65-99", "0-17", "18-39", "18-39"]


def test_transport_times_are_half_open_tens_of_rounded_minutes(spark):
    assert keys(spark, "transport_time_bucket", "rounded_minutes", [None, -1, 0, 9, 10, 19, 59, 60, 400]) == ["unknown", "unknown", "under_10", "under_10", "10_20", "10_20", "50_60", "over_60", "over_60"]


def test_flags_cohorts_and_codes(spark):
    assert keys(spark, "cpr", "is_cpr", [True, False, None], "boolean") == ["1", "0", None]
    rows = spark.createDataFrame([(1, 1), (2, 3), (3, None), (None, 2)], "location_code int, tier_code int")
    assert [r[0] for r in rows.select(F.expr(S.cohort_key())).collect()] == ["urban_basic", "mixed_full", None, None]


def test_day_times_shifts_and_iso_weeks(spark):
    at = [dt.datetime(2024, 12, 30, h) for h in (0, 5, 6, 11, 12, 13, 14, 17, 18, 21, 22, 23)]
    rows = spark.createDataFrame([(t, 1.0) for t in at], "created_at timestamp_ntz, minutes double").select(*[F.expr(e).alias(n) for n, e in binding.calendar("spark").items()])
    got = rows.collect()
    assert [r.day_time_code for r in got] == [1, 1, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4] and [r.shift_code for r in got] == [1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 1, 1]
    assert {(r.created_week, r.created_weekday, r.created_quarter) for r in got} == {(1, 1, 4)}


def metric(spark, name, rows, schema):
    return spark.createDataFrame(rows, schema).agg(F.expr(S.METRICS[name].spark)).first()[0]


def test_metrics_by_hand(spark):
    minutes = [(1.0,), (2.0,), (4.0,), (None,)]
    assert metric(spark, "mean_transport_time", minutes, "minutes double") == 2.333333 and metric(spark, "median_transport_time", minutes, "minutes double") == 2.0
    assert metric(spark, "p25_transport_time", minutes, "minutes double") == 1.5 and metric(spark, "p90_transport_time", minutes, "minutes double") == 3.6
    flags = [(True,), (False,), (None,), (True,)]
    assert metric(spark, "resus_rate", flags, "requires_resus boolean") == 50 and metric(spark, "resus_rate", [], "requires_resus boolean") is None
    assert metric(spark, "infection_rate", [(1,), (None,), (None,), (None,)], "infection_id int") == 25
    assert metric(spark, "min_allocations_per_hospital", [(None,), (3,)], "allocations int") == 3 and metric(spark, "total_allocations", [(None,)], "allocations int") == 0
    assert metric(spark, "hospital_count", [(1,), (1,), (None,)], "hospital_id int") == 1


def test_shares_boxes_and_rates(spark):
    at = dt.datetime(2025, 1, 1)
    rows = spark.createDataFrame([(1, 1, True, 9.9, at), (1, 2, False, 20.7, at), (1, 1, None, None, at), (None, 1, True, 3.0, at), (2, 1, True, -2.5, at)], "gender_code int, urgency_code int, requires_resus boolean, minutes double, created_at timestamp_ntz")
    got = {(r.bucket, r.series): (r["count"], r.percent_of_total, r.percent_of_bucket) for r in analysis.analyse(Analysis("gender", "urgency", ("count", "percent_of_total", "percent_of_bucket")), rows, None).collect()}
    assert got == {("1", "1"): (2, 50.0, 66.67), ("1", "2"): (1, 25.0, 33.33), ("2", "1"): (1, 25.0, 100.0)}
    box = {r.bucket: tuple(r)[1:] for r in analysis.analyse(Analysis("urgency", metrics=("transport_time_distribution",)), rows, None).collect()}
    assert box == {"1": (-2, 0.25, 3.0, 6.45, 9), "2": (20, 20.7, 20.7, 20.7, 20)}
    more = rows.withColumn("requires_cathlab", F.lit(False))
    rates = {(r.bucket, r.series): r.prevalence_rate for r in analysis.analyse(Analysis("clinical_resources", "gender", ("prevalence_rate",)), more, None).collect()}
    assert rates == {("resus", "1"): pytest.approx(33.333333), ("cathlab", "1"): 0, ("resus", "2"): 100, ("cathlab", "2"): 0}


def test_slices_are_the_same_counted_fine(spark):
    rows = spark.range(300).selectExpr("CAST(id % 3 AS INT) AS a", "CASE WHEN id % 4 > 0 THEN CAST(id % 4 AS INT) END AS b", "id % 5 = 0 AS c")
    kinds, values = [("one", "a", None), ("two", "a", "b"), ("three", "b", None)], {"n": "count(*)", "m": "count(CASE WHEN c THEN 1 END)"}
    plain, fine = (sorted(map(str, slices.grouping_slice(rows, kinds, values, ("three",), f).collect())) for f in (False, True))
    assert plain == fine and len(plain) == 3 + 12 + 3
