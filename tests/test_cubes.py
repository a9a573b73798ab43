"""Slices from cubes against slices of facts, through changes of imports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from allocspark.operators import cubes as C
from allocspark.operators.slices import grouping_slice
from allocspark.operators.store import Store, dropped_import
from allocspark.functions import semantics as S
from allocspark.sources.binding import facts

SF = "/root/testdata/sf0.001"


def shown(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def of_facts(rows, name):
    _, kinds, values, where, skip = C.SLICES[name]
    wide = rows.where(where or "TRUE").withColumns({"minutes_bucket": F.expr(S.minute_buckets()), "age_bucket": F.expr(S.ages(17))})
    return grouping_slice(wide, kinds, {k: f"count(CASE WHEN {c} THEN 1 END)" for k, c in values.items()}, skip)


def test_slices_follow_imports_without_reading_facts(spark, tmp_path):
    rows = facts(spark, SF).where("created_year IN (1996, 1997)")
    store = Store(spark, str(tmp_path))
    C.built(store, rows.where("import_id <> 199703"))
    C.replaced(store, 199703, rows)
    C.replaced(store, 199605, rows.where("gender_code = 1"))
    assert dropped_import(store, 199604) == {name: store.read(name, version=3).where("import_id = 199604").count() for name in C.CUBES}
    left = rows.where("import_id <> 199604 AND (import_id <> 199605 OR gender_code = 1)")
    for name, (cube, kinds, values, where, skip) in C.SLICES.items():
        got = C.rolled_up(store, cube, kinds, values, where, skip)
        assert shown(got) == shown(of_facts(left, name)), name
        assert all(str(tmp_path) in f for f in got.inputFiles())
    some = C.rolled_up(store, "by_hospital", *C.SLICES["overview"][1:3], imports=[199701, 199702])
    assert shown(some.where("slice_kind <> 'transport_type'")) == shown(of_facts(left.where("import_id IN (199701, 199702)"), "overview").where("slice_kind <> 'transport_type'"))
    with pytest.raises(ValueError, match="gender_age"):
        C.rolled_up(store, "by_hospital", [("gender_age", "gender_code", "age_bucket")], {"n": "TRUE"})


def test_a_slice_builds_its_own_cube_only(spark):
    for name, (cube, *_) in C.SLICES.items():
        C.QUERIES[f"cube_{name}_slice"][0](spark, SF)
        assert list(C._kept_cube(spark, SF, cube).state()) == [cube]
    assert C.SLICES["overview"][0] == "by_period"  # it puts no condition on hospitals


def test_kinds_counted_together_have_no_more_rows_than_the_facts(spark, tmp_path):
    rows, store = facts(spark, SF).where("created_year = 1997"), Store(spark, str(tmp_path))
    C.built(store, rows, ("by_hospital",))
    cube = store.read("by_hospital")
    assert cube.count() <= rows.count() == cube.agg(F.sum("n")).first()[0]
