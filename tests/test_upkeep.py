"""Written facts, upkeep of tables, filters, scopes, pages, benchmark and quality rules on rows of known results."""

from __future__ import annotations

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from allocspark import catalog
from allocspark.operators import benchmark, listing, population, upkeep
from allocspark.plans import analysis, filters
from allocspark.plans.spec import Analysis, Period, Scope
from allocspark.sources import binding

SF = "/root/testdata/sf0.001"


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_a_period_prunes_partitions_of_the_written_fact(spark):
    spec = Analysis("month", period=Period.resolve("quarter", dt.datetime(1998, 5, 5), 1997, quarter=2))
    plan = plan_of(catalog._spec_query(spec)(spark, SF))
    assert "PartitionFilters: [" in plan and "created_year" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert "lineitem" not in plan and "SortMergeJoin" not in plan and "ReadSchema: struct<created_at:timestamp_ntz>" in plan
    assert binding.facts(spark, SF).count() == binding.built_facts(spark, SF).count()
    first = binding._written[spark.sparkContext.applicationId, SF]
    assert binding.refreshed(spark, SF).count() > 0 and binding._written[spark.sparkContext.applicationId, SF] != first


def test_imports_come_and_go(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "import_id int, fact_key string")
    upkeep.write_partitions(rows, path, "import_id")
    upkeep.write_partitions(rows.where("import_id = 1").limit(1), path, "import_id")
    assert spark.read.parquet(path).count() == 2
    assert upkeep.clean_import(spark, {"t": path}, 1) == {"t": 1} and upkeep.delete_import(spark, path, 1) == 0
    assert [r.fact_key for r in spark.read.parquet(path).collect()] == ["c"]
    left = spark.createDataFrame([("c",), ("c",)], "fact_key string")
    assert upkeep.orphans(rows, left).count() == 2 and upkeep.without_orphans(rows, left).count() == 1


def test_backfill_is_told_before_and_done_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 7, None), (1, "b", 8, None), (1, "c", 7, 3), (2, "d", None, None)], "import_id int, fact_key string, indication_raw_id int, indication_id bigint")
    upkeep.write_partitions(rows, path, "import_id")
    raw = spark.createDataFrame([(7, 70), (8, None)], "raw_id int, normalized_id bigint")
    assert [upkeep.backfill(spark, path, raw, dry) for dry in (True, False, False)] == [1, 1, 0]
    assert {(r.fact_key, r.indication_id) for r in spark.read.parquet(path).collect()} == {("a", 70), ("b", None), ("c", 3), ("d", None)}


def test_days_are_replaced_and_empty_ones_go(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("2025-01-31", 1, 5), ("2025-02-01", 1, 6), ("2025-02-02", 1, 7), ("2025-02-03", 1, 8)], "day string, hospital_id int, n int")
    upkeep.upsert_days(spark, rows, path)
    upkeep.upsert_days(spark, rows.where("day = '2025-02-02'").withColumn("n", F.lit(9)), path, "2025-02-01", "2025-02-02")
    assert {(r.day, r.n) for r in spark.read.parquet(path).collect()} == {("2025-01-31", 5), ("2025-02-02", 9), ("2025-02-03", 8)}


def test_one_view_fails_and_others_go_on(spark, tmp_path):
    df = spark.range(3)

    def broken():
        raise ValueError("no")

    assert upkeep.refresh_views(spark, {"a": lambda: df, "b": broken, "c": lambda: df}, str(tmp_path)) == {"a": "refreshed", "b": "failed: ValueError", "c": "refreshed"}
    assert spark.read.parquet(f"{tmp_path}/c").count() == 3


def test_filters_of_ages_and_flags(spark):
    rows = spark.createDataFrame([(None, None), (0, 1), (17, None), (18, None), (80, 1), (99, 2), (100, None)], "age int, infection_id int")
    n = lambda f: analysis.restricted(rows, f.sql()).count()
    assert [n(filters.DrawerFilter(age_group=g)) for g in ("under_18", "0_18", "over_80", "80_89", "90_99", "of no meaning")] == [2, 3, 3, 1, 1, 7]
    assert [n(filters.DrawerFilter(is_infectious=x)) for x in (True, False)] == [3, 4] and n(filters.DrawerFilter(infection=2)) == 1
    assert len(filters.DrawerFilter(*[1] * 2, "0_18", 1, 1, *[True] * 8, 1).sql()) == 14
    assert filters.ListFilter(hospital_ids=()).sql() == ["1 = 0"] and filters.ListFilter().sql() == []
    at = [dt.datetime(2025, 1, 1, h) for h in (1, 2, 3)]
    arrivals = spark.createDataFrame([(t,) for t in at], "arrival_at timestamp_ntz")
    assert analysis.restricted(arrivals, filters.ListFilter(arrival=(at[0], at[1])).sql()).count() == 2
    names = spark.createDataFrame([("St. Ägidius",), ("a_b%",), (None,)], "name string")
    assert [filters.searched(names, "name", t).count() for t in ("ÄGI", "_", "%", "x")] == [1, 1, 1, 0]


def test_scopes_by_name(spark):
    f = spark.createDataFrame([(1, 9), (2, 9), (4, 8)], "hospital_id int, dispatch_area_id int")
    h = spark.createDataFrame([(1, 5, 1, 1), (2, 6, 2, 3), (3, 7, 2, 3)], "hospital_id int, hospital_state_id int, location_code int, tier_code int")
    scope = lambda *a, **k: filters.resolved_scope(a[0], f, h, *a[1:], **k)
    assert scope("public") == Scope() and scope("hospital", 3) == Scope((3,)) and scope("dispatch_area", 9) == Scope(dispatch_area_id=9)
    assert scope("state", 6) == Scope((2,)) and scope("state", 7) == Scope() and scope("cohort", "mixed_full") == Scope((2,), locations=(2,), tiers=(3,))
    assert scope("mine") == Scope(()) and scope("mine", mine=(1,)) == Scope((1,))
    assert {r.hospital_id for r in filters.hospitals_in_scope(h, f, Scope(dispatch_area_id=9)).collect()} == {1, 2}


def test_pages_meet_without_gaps(spark):
    at = dt.datetime(2025, 1, 1)
    rows = spark.createDataFrame([(at + dt.timedelta(hours=i // 3), f"k{i:02}") for i in range(10)], "arrival_at timestamp_ntz, fact_key string")
    seen, after = [], None
    while True:
        got, after = listing.keyset_page(rows, after, 4)
        seen += [r.fact_key for r in got]
        if after is None:
            break
    assert seen == [f"k{i:02}" for i in range(10)]
    assert listing.keyset_page(rows.limit(4), None, 4)[1] is None


def test_compared_shares_and_insights(spark):
    sides = spark.createDataFrame([("resus", 30, 100, 50, 500), ("cathlab", 5, 100, 50, 500), ("weekend", 30, 100, 152, 500), ("shock", 1, 100, 0, 500), ("physician", 12, 100, 50, 500)], "name string, n1 bigint, total1 bigint, n2 bigint, total2 bigint")
    r = {x.name: x for x in benchmark.compared(sides).collect()}
    assert (r["resus"].share1, r["resus"].share2, r["resus"].delta, r["resus"].relative, r["resus"].ratio) == (30, 10, 20, 200, 3) and (r["shock"].relative, r["shock"].ratio) == (0, 0)
    found = [(x.name, x.direction, x.severity, x.ratio, x.score) for x in benchmark.insights(sides).collect()]
    assert found == [("resus", "above", "critical", 3.0, 1312), ("cathlab_low", "below", "critical", 0.5, 829)]
    few = benchmark.compared(sides.withColumn("total1", F.lit(19))).first()
    assert few.ratio is None and few.relative is None and few.insufficient and benchmark.insights(sides.withColumn("total1", F.lit(99))).count() == 0


def test_quality_levels(spark):
    rows = [(i, i < 5, 10 * i, 100 if i < 4 else 99, ("small", "large")[i % 2], "basic", "urban", "x") for i in range(6)]
    h = spark.createDataFrame(rows, "hospital_id int, participating boolean, beds int, n bigint, size string, tier string, location string, area_name string")
    assert tuple(population.coverage(h).first()) == (6, 5, pytest.approx(0.833333), 2)
    cells = population.support_cells(h)
    assert cells.count() == 24 and {(r.kind, r.key): r.supported for r in cells.where("population > 0").collect()} == {("size", "small"): True, ("size", "large"): False, ("location", "urban"): True}
    s = population.support(cells, F.lit(6)).first()
    assert (s.relevant, s.supported, s.cell_share, s.score) == (3, 2, 0.6667, 2)
    v = population.volume(h).first()
    assert (v.total, v.p25, v.p50, v.p95, v.share, v.score) == (598, 99, 100, 100, 0.6667, 2)
    d = {r.dimension: (r.distance, r.score, r.most, r.least) for r in population.representativeness(h).collect()}
    assert d["size"] == (0.1, 3, "small", "large") and d["tier"][0] == 0
    assert population.representative_score(population.representativeness(h)).first().score == 3
    assert population.overall(h).first().overall == 2


def test_totals_and_grains(spark):
    r = spark.createDataFrame([("a", "x", 1, 10.0, 2), ("a", "y", 3, 20.0, 5), ("b", "x", 6, 40.0, 1)], "bucket string, series string, hospital_count bigint, avg_beds double, min_beds int")
    t = {(x.bucket, x.series): x for x in analysis.totals(r, ("hospital_count", "avg_beds", "min_beds")).where("level > 0").collect()}
    assert tuple(t[None, None])[2:5] == (10, 31.0, 1) and t["a", None].avg_beds == 17.5 and t[None, "x"].min_beds == 1
    f, h = binding.facts(spark, SF), binding.hospitals(spark, SF)
    n = {g: analysis.by_grain(Analysis("gender"), g, f, h).agg(F.sum("count")).first()[0] for g in analysis.GRAINS}
    assert set(n.values()) == {f.count()}
    with pytest.raises(ValueError):
        Analysis("hospital_size", metrics=("hospital_count",), source="hospitals", filters=(("gender", ("1",)),))


def test_facts_are_moved_by_the_columns_they_follow_from(spark):
    laid = binding.laid_out(spark, SF)
    plan = laid._jdf.queryExecution().optimizedPlan()
    moved = plan.toString().split("RebalancePartitions")[1].split("\n")[1]  # what is moved
    assert moved.count("#") < 60 and "case_id" not in moved and "fact_key" not in moved
    whole = binding.built_facts(spark, SF)
    assert sorted(laid.columns) == sorted(whole.columns) and dict(laid.dtypes) == dict(whole.dtypes)
    one = whole.select(*laid.columns)
    assert laid.exceptAll(one).count() == 0 and laid.count() == one.count()
