"""The semantic layer, dashboards and upkeep, on golden rows and against DuckDB."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from allocspark import catalog
from allocspark.operators import maintenance, usage
from allocspark.plans import analysis
from allocspark.plans.spec import Analysis, Period, Scope
from allocspark.sources import binding

SF = "/root/testdata/sf0.001"
SOME = ("view_gender_over_time", "view_hospitals_by_tier_compare", "view_clinical_features_by_urgency", "view_beds_distribution_by_tier", "semantic_metrics_shares", "semantic_scope_empty", "semantic_double_unpivot", "overview_slice", "top_entities", "profile_rank_shift", "usage_transitions", "usage_funnel", "dedup_report", "kpi_daily", "disclosed_matrix")


def rows(names, values):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def fact(spark, created, arrival, **more):
    base = {n: None for n in binding.RAW} | {"hospital_id": 1, "fact_key": "a", "created_at": created, "arrival_at": arrival} | more
    kinds = {"gender_code": "int", "urgency_code": "int", "transport_type_code": "int", "age": "int", "import_id": "int", "fact_key": "string", "created_at": "timestamp_ntz", "arrival_at": "timestamp_ntz"}
    schema = ", ".join(f"{n} {kinds.get(n, 'boolean' if n.startswith(('is_', 'requires_', 'department_was')) else 'bigint')}" for n in base)
    return spark.createDataFrame([tuple(base.values())], schema)


def projected(spark, *rows_):
    out = rows_[0]
    for r in rows_[1:]:
        out = out.unionByName(r)
    return binding.projected(out, spark.createDataFrame([(1, 1, 1)], "hospital_id bigint, tier_code int, location_code int"))


def test_projection_of_a_row(spark):
    r = projected(spark, fact(spark, dt.datetime(2025, 6, 15, 10), dt.datetime(2025, 6, 15, 11, 30))).first()
    assert (r.created_year, r.created_quarter, r.created_month, r.created_day, r.created_hour) == (2025, 2, 6, 15, 10)
    assert (r.created_week, r.created_weekday, r.day_time_code, r.shift_code, r.rounded_minutes) == (24, 7, 2, 2, 90)


def test_precise_and_rounded_minutes(spark):
    at = dt.datetime(2025, 1, 1, 23)
    f = projected(spark, *[fact(spark, at, at + dt.timedelta(minutes=m)) for m in (20.5, 20, 21.5, 9.5)])
    three = f.where("minutes >= 20").agg(F.expr("percentile(minutes, 0.5)"), F.avg("minutes"), F.expr("percentile(rounded_minutes, 0.5)")).first()
    assert tuple(three) == (20.5, pytest.approx(20.666666666666668), 21.0)
    out = {r.bucket: r["count"] for r in analysis.analyse(Analysis("transport_time_bucket"), f, None).collect()}
    assert out == {"10_20": 1, "20_30": 3}


def test_specifications_are_checked():
    for bad in (lambda: Analysis("nothing"), lambda: Analysis("gender", metrics=("prevalence_rate",)), lambda: Analysis("gender", metrics=("percent_of_bucket",)), lambda: Analysis("gender", metrics=("sum_beds",))):
        with pytest.raises(ValueError):
            bad()
    now = dt.datetime(2026, 2, 3)
    assert Period.resolve("all", now) == Period(dt.datetime(2025, 3, 1))
    assert Period.resolve("quarter", now, 2025, quarter=9) == Period(dt.datetime(2025, 10, 1), dt.datetime(2026, 1, 1))
    assert Scope(hospital_ids=()).sql() == ["1 = 0"] and Scope().sql() == []
    assert Analysis("gender", filters=(("gender", ("1",)),)).conditions() == []


def test_shaping(spark):
    r = spark.createDataFrame([("a", "x", 5), ("a", "y", 1), ("b", "x", 3), ("c", "x", 1)], "bucket string, series string, count bigint")
    assert {tuple(x) for x in analysis.pivoted(r, columns=["x", "y"]).collect()} == {("a", 5, 1), ("b", 3, 0), ("c", 1, 0)}
    assert {tuple(x) for x in analysis.top_with_rest(r, 1).collect()} == {("a", 6), ("other", 4)}
    assert {(x.bucket, x.series): x["count"] for x in analysis.totals(r).collect()}[(None, None)] == 10
    assert analysis.table_percents(r).where("bucket = 'a' AND series = 'x'").first()["of_row"] == 83.33


def test_deduplication_keeps_the_newest_and_is_idempotent(spark):
    at = dt.datetime(2025, 1, 1)
    f = fact(spark, at, at, case_id=7, import_id=1)
    many = f.unionByName(fact(spark, at, at, case_id=7, import_id=2, fact_key="b")).unionByName(fact(spark, at, at, case_id=7, urgency_code=2, import_id=1, fact_key="c")).unionByName(fact(spark, at, at, import_id=1, fact_key="d")).unionByName(fact(spark, at, at, import_id=1, fact_key="e"))
    once = maintenance.deduplicated(many)
    assert sorted(r.fact_key for r in once.collect()) == ["b", "c", "d"]
    assert maintenance.deduplicated(once).count() == 3


def test_facts_are_replaced_by_import(spark, tmp_path):
    path = str(tmp_path / "facts")
    at = dt.datetime(2025, 1, 1)
    a, b = (projected(spark, fact(spark, at, at, import_id=i)) for i in (1, 2))
    maintenance.write_facts(a.unionByName(b), path)
    maintenance.write_facts(b, path)
    assert spark.read.parquet(path).count() == 2
    assert maintenance.unseen_hospitals(a, spark.read.parquet(path)).count() == 0


def test_daily_figures_of_all_days(spark, tmp_path):
    total = binding.facts(spark, SF).count()
    got = maintenance.kpi_daily(spark, SF)
    assert got.where("hospital_id IS NULL").agg(F.sum("n")).first()[0] == total > maintenance.kpi_daily(spark, SF, "created_year = 1997").where("hospital_id IS NULL").agg(F.sum("n")).first()[0]
    days = [dt.datetime(2025, 12, 28, 5), dt.datetime(2025, 12, 28, 6), dt.datetime(2026, 1, 2)]
    spark.createDataFrame([(i, 1, t, "view", 1.0, "{}") for i, t in enumerate(days)], "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in usage.daily(spark, str(tmp_path)).orderBy("day").collect()] == [("2025-12-28", 2, 2), ("2025-12-29", 0, 2), ("2025-12-30", 0, 2), ("2025-12-31", 0, 2), ("2026-01-01", 0, 2), ("2026-01-02", 1, 3)]
    assert [tuple(r) for r in usage.daily(spark, str(tmp_path), "2026-01-02", "2026-01-04").orderBy("day").collect()] == [("2026-01-02", 1, 3), ("2026-01-03", 0, 3), ("2026-01-04", 0, 1)]


def test_overview_of_all_hospitals(spark):
    f = binding.facts(spark, SF)
    r = catalog.queries()["overview_metrics_platform"](spark, SF).first()
    assert (r.total, r.scope_total) == (f.count(), f.where("hospital_id IN (1, 2, 3)").count())


@pytest.mark.parametrize("name", ["usage_daily", "kpi_daily_all", "overview_metrics_platform"])
def test_daily_as_duckdb(spark, name):
    test_same_as_duckdb(spark, name)


def test_recent_requests_at_the_edge_of_a_second(spark, tmp_path):
    stamps = ["2024-01-12 23:59:59.5", "2024-01-13 00:00:00.5", "2024-01-18 23:59:59.999999", "2024-01-19 00:00:00", "2024-01-19 23:59:59.5", "2024-01-20 00:00:00", "2024-01-20 00:00:00.5"]
    rows = spark.createDataFrame([(i, s, i, "view", 1.0, '{"k": 1}') for i, s in enumerate(stamps)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    f, sql = usage.QUERIES["usage_recent"]
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    assert tuple(f(spark, str(tmp_path)).select(*names).first()) == want.fetchone()
