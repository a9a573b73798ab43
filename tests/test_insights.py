"""Rules of insights on rows made by hand: edges of every kind, ranking, and what each page leaves out."""

from __future__ import annotations

import math

import pytest

from allocspark.functions.histogram import counted, percentiles
from allocspark.operators import insights as I
from allocspark.plans.sides import Side, by_side, masked
from allocspark.plans.spec import Scope


def found(spark, page, size1, size2, rates=(), values=()):
    """Insights of one subject. rates: name, n1, n2 (of all cases, or of a pair of totals); values: name, v1, v2."""
    rows = [("s", n, float(a), float(t[0] if t else size1), float(b), float(t[1] if t else size2), size1, size2) for n, a, b, *t in rates]
    rows += [("s", n, a, None, b, None, size1, size2) for n, a, b in values]
    return [(r.name, r.direction, r.severity, r.ratio, r.score) for r in sorted(I.evaluated(spark.createDataFrame(rows, I.MEASURED), page).collect(), key=lambda r: r.position)]


def score(priority, ratio, n):
    return round(priority * min(ratio, 5) * math.log(n))


def test_rates_of_two_sides(spark):
    got = found(spark, "benchmark", 500, 5000, [("physician", 400, 1000), ("resus", 20, 400), ("cpr", 18, 40), ("weekend", 130, 1000), ("shock", 60, 500), ("infectious", 300, 300)])
    assert got == [
        ("physician", "above", "critical", 4.0, score(100, 4, 500)),
        ("resus_low", "below", "critical", 0.5, score(95, 2, 500)),
        ("weekend", "above", "neutral", 1.3, score(55, 1.3, 500)),
    ]  # cpr: less than three points apart; shock: too near; infectious: not on this page
    assert found(spark, "benchmark", 99, 5000, [("physician", 90, 1000)]) == found(spark, "benchmark", 100, 499, [("physician", 90, 10)]) == []
    assert found(spark, "benchmark", 500, 5000, [("physician", 210, 2000)]) == []  # neutral ones aren't told
    assert [x[0] for x in found(spark, "benchmark", 500, 5000, [("physician", 100, 0), ("resus", 0, 500)])] == ["resus_low"]


def test_medians_of_two_sides(spark):
    values = lambda age, minutes: [("median_age", *age), ("median_minutes", *minutes)]
    assert found(spark, "benchmark", 500, 5000, values=values((85.0, 60.0), (72.0, 45.0))) == [("age_old", "above", "elevated", 1.416667, 65), ("transport_time_long", "above", "elevated", 1.6, 50)]
    assert found(spark, "benchmark", 500, 5000, values=values((45.0, 60.0), (30.0, 45.0))) == [("age_young", "below", "elevated", 0.75, 65), ("transport_time_short", "below", "elevated", 0.7, 45)]
    assert found(spark, "benchmark", 500, 5000, values=values((69.5, 60.0), (50.0, 45.0))) == []
    assert found(spark, "benchmark", 500, 5000, values=values((0.0, 60.0), (None, 45.0))) == []


def test_an_indication_beside_the_others(spark):
    got = found(spark, "indication", 100, 500, [("physician", 50, 250), ("male", 75, 250, 100, 500), ("female", 25, 250, 100, 500), ("resus", 1, 100)], [("median_age", 25.0, 40.0), ("median_minutes", 45.0, 30.0)])
    assert got == [
        ("gender_male_dominant", "above", "elevated", 1.5, 75),
        ("age_young", "below", "elevated", 15.0, 65),
        ("physician_neutral", "neutral", "neutral", 1.0, 50),
        ("transport_time_long", "above", "elevated", 1.5, 40),
    ]  # low rates aren't told here
    assert found(spark, "indication", 100, 500, [("male", 0, 0, 9, 500), ("female", 9, 300, 9, 500)]) == []
    assert found(spark, "indication", 100, 500, [("male", 0, 0, 50, 500), ("female", 50, 500, 50, 500)]) == []  # nobody to compare with
    assert found(spark, "indication", 100, 500, values=[("median_age", 72.0, 0.5)])[0][3] == 71.5
    many = [(n, 60, 50) for n, *_ in I.RATES]
    assert len(found(spark, "indication", 100, 500, many)) == 6


def test_pairs_show_a_neutral_insight_only_alone(spark):
    assert found(spark, "compare", 30, 30, [("physician", 15, 15)]) == [("physician_neutral", "neutral", "neutral", 1.0, 50)]
    assert [x[0] for x in found(spark, "compare", 30, 30, [("physician", 15, 15), ("resus", 20, 5)])] == ["resus"]
    assert found(spark, "compare", 29, 30, [("physician", 15, 15)]) == []


def test_equal_scores_keep_the_order_of_rules(spark):
    assert [x[0] for x in found(spark, "benchmark", 500, 5000, [("shock", 200, 1000), ("age_80_plus", 200, 1000)])] == ["age_80_plus", "shock"]


@pytest.mark.parametrize(("page", "n"), [("case_flow_hospital", 30), ("case_flow_system", 100)])
def test_case_flows(spark, page, n):
    rates = [("regional", 0.7 * n, 0, n, 0), ("full_tier", 0.5 * n, 35, n, 100), ("urgent_origin", 20, 0, 50, 0)]
    got = found(spark, page, n, 0, rates, [("mean_minutes", 30.0, 25.0)])
    assert [x[0] for x in got] == ["high_centralization", "predominantly_regional", "elevated_transport_time", "urgency_concentration_origin"]
    assert [x[4] for x in got] == [75, 70, 60, 48] and [x[2] for x in got] == ["elevated", "info", "elevated", "elevated"]
    assert found(spark, page, n - 1, 0, rates) == []
    assert [x[0] for x in found(spark, page, n, 0, [("full_tier", 0.5 * n, 40, n, 100)])] == []


def test_percentiles_from_counts(spark):
    import numpy as np

    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, None]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 7), ("c", None)], "k string, v int")
    got = {r.k: (r.p, r.q) for r in percentiles(counted(rows, ["k"], "v"), ["k"], {"p": 0.5, "q": 0.9}).collect()}
    real = [v for v in values if v is not None]
    assert got == {"a": (np.percentile(real, 50), np.percentile(real, 90)), "b": (7, 7)}
    assert percentiles(counted(rows.limit(0), ["k"], "v"), ["k"], {"p": 0.5}).count() == 0


def test_sides_are_bits_of_one_mask(spark):
    assert Side().sql() == "TRUE" and Side(scope=Scope(hospital_ids=())).sql() == "FALSE" and Side(scope=Scope((1,)), conditions=("x > 1",)).sql() == "(hospital_id IN (1)) AND (x > 1)"
    rows = spark.createDataFrame([(1, 5), (1, None), (2, 5), (3, 1)], "hospital_id int, x int")
    sides = {"all": Side(), "nobody": Side(scope=Scope(hospital_ids=())), "one": Side(scope=Scope((1,))), "large": Side(conditions=("x > 2",))}
    out = masked(rows, sides)
    assert sorted((r.hospital_id, r.x, r.mask) for r in out.where("x IS NOT NULL").collect()) == [(1, 5, 13), (2, 5, 9), (3, 1, 1)]
    n = by_side(out.groupBy("mask").count(), sides, [], ["count"])
    assert {r.side: r["count"] for r in n.collect()} == {"all": 4, "one": 2, "large": 2}
    assert masked(rows, {"nobody": sides["nobody"]}).count() == 0
