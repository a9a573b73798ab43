"""Aggregations over facts that Spark and DuckDB express alike."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.binding import DUCK, duck_with, facts, hospitals

Pair = tuple[Callable[[SparkSession, str], DataFrame], str | None]
Value = str | tuple[str, str]


def _of(value: Value, duck: bool) -> str:
    return value if isinstance(value, str) else value[duck]


def aggregate(values: dict[str, Value], keys: dict[str, Value] | None = None, where: str = "", having: str = "", hospital: bool = False) -> Pair:
    """Group facts (joined with all hospital columns, if asked for) and aggregate; a value is SQL for both engines or a pair of SQL."""
    keys = keys or {}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = facts(spark, sf_dir)
        if hospital:
            rows = rows.join(hospitals(spark, sf_dir).drop("tier_code", "location_code"), "hospital_id")
        rows = rows.where(where) if where else rows
        rows = rows.withColumns({k: F.expr(_of(v, False)) for k, v in keys.items()}) if keys else rows
        out = rows.groupBy(*keys).agg(*[F.expr(_of(v, False)).alias(n) for n, v in values.items()])
        return out.where(having) if having else out

    source = "fact JOIN (SELECT * EXCLUDE (tier_code, location_code) FROM hospital) USING (hospital_id)" if hospital else "fact"
    shown = [f"{_of(v, True)} AS {k}" for k, v in (keys | values).items()]
    by = f" GROUP BY {', '.join(_of(v, True) for v in keys.values())}" if keys else ""
    sql = f"SELECT {', '.join(shown)} FROM {source}{f' WHERE {where}' if where else ''}{by}"
    return run, duck_with() + (f"SELECT * FROM ({sql}) WHERE {having}" if having else sql)


def median(value: str, condition: str = "") -> Value:
    """The exact median, of the rows that meet a condition."""
    of = f"CASE WHEN {condition} THEN {value} END" if condition else value
    return S.quantile(of, 0.5, "spark"), S.quantile(of, 0.5, DUCK)


def count(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


CLINICAL = {"resus": "requires_resus", "cathlab": "requires_cathlab", "cpr": "is_cpr", "ventilated": "is_ventilated", "shock": "is_shock", "pregnant": "is_pregnant", "work_accident": "is_work_accident", "with_physician": "is_with_physician", "infectious": "infection_id IS NOT NULL"}
NIGHT, WEEKEND = "day_time_code = 1", "created_weekday IN (6, 7)"


def headline(side: str = "", prefix: str = "") -> dict[str, Value]:
    """The counts of a dashboard, of the rows on one side."""
    both = lambda c: f"({c}) AND ({side})" if side else c
    out: dict[str, Value] = {f"{prefix}total": count(side or "TRUE")}
    out |= {f"{prefix}{k}": count(both(c)) for k, c in CLINICAL.items()}
    out |= {f"{prefix}night": count(both(NIGHT)), f"{prefix}weekend": count(both(WEEKEND))}
    out |= {f"{prefix}gender_{n}": count(both(f"gender_code = {k}")) for k, n in S.GENDER.items()}
    out |= {f"{prefix}urgency_{k}": count(both(f"urgency_code = {k}")) for k in (1, 2, 3)}
    return out


def age_counts(side: str = "TRUE", prefix: str = "") -> dict[str, Value]:
    names = ["0_17", "18_29"] + [f"{a}_{a + 9}" for a in range(30, 100, 10)] + [S.UNKNOWN]
    return {f"{prefix}age_{n}": count(f"({S.ages(17)}) = '{n}' AND ({side})") for n in names}


def middles(side: str = "", prefix: str = "") -> dict[str, Value]:
    mean = f"round(avg(CASE WHEN {side or 'TRUE'} THEN minutes END), 6)"
    return {f"{prefix}median_age": median("age", side), f"{prefix}median_minutes": median("minutes", side), f"{prefix}mean_minutes": mean}


def series(spark_key: str, duck_key: str) -> Value:
    return (spark_key, duck_key)


MONTH = series("date_format(created_at, 'yyyy-MM')", "strftime(created_at, '%Y-%m')")
DAY = series("date_format(created_at, 'yyyy-MM-dd')", "strftime(created_at, '%Y-%m-%d')")
CAL = series("concat('cal-', lpad(CAST(created_month AS STRING), 2, '0'))", "concat('cal-', lpad(CAST(created_month AS STRING), 2, '0'))")
PRIMARY = "created_year = 1997 AND hospital_id % 2 = 0"
COMPARISON = "created_year = 1996"
SCOPE = "hospital_id IN (1, 2, 3)"
INDICATION, OTHER = "indication_id IN (3, 4, 5)", "(indication_id IS NULL OR indication_id NOT IN (3, 4, 5))"
SIDE_A, SIDE_B = "indication_id = 7", "indication_id = 8"
CASES = {"cases": "count(*)", "n_hospitals": "count(DISTINCT hospital_id)"}


def _named(code: str, names: dict[int, str]) -> str:
    return f"coalesce({S.coded(code, names)}, 'unknown')"


QUERIES: dict[str, Pair] = {
    "overview_metrics": aggregate(headline() | age_counts() | middles(), where="hospital_id % 3 = 1"),
    "overview_metrics_platform": aggregate(headline() | age_counts() | middles() | headline(SCOPE, "scope_") | age_counts(SCOPE, "scope_") | middles(SCOPE, "scope_")),
    "overview_summary": aggregate({"total": "count(*)", **{k: count(c) for k, c in CLINICAL.items()}}),
    "overview_scoped_totals": aggregate({"platform": "count(*)", "scoped": count("hospital_id IN (1, 2, 3)")}),
    "overview_gender": aggregate({"n": "count(*)"}, {"gender": S.coded("gender_code", S.GENDER)}, "gender_code IS NOT NULL"),
    "overview_urgency": aggregate({"n": "count(*)"}, {"urgency": S.text("urgency_code")}, "urgency_code IS NOT NULL"),
    "hospitals_per_state": aggregate({"n": "count(DISTINCT hospital_id)"}, {"state": "state_name"}, hospital=True),
    "hospitals_per_area": aggregate({"n": "count(DISTINCT hospital_id)"}, {"area": "area_name"}, hospital=True),
    "hospitals_per_cohort": aggregate({"n": "count(DISTINCT hospital_id)"}, {"cohort": S.cohort_key()}),
    "eligible_states": aggregate({"n": "count(DISTINCT hospital_id)"}, {"state": "hospital_state_id"}, having="n >= 2", hospital=True),
    "eligible_areas": aggregate({"n": "count(DISTINCT hospital_id)"}, {"area": "area_id"}, having="n >= 2", hospital=True),
    **{f"series_{n}": aggregate({"n": "count(*)"}, {"at": k}) for n, k in (("month", MONTH), ("day", DAY), ("calendar_month", CAL))},
    **{f"series_{n}_by_{d}": aggregate({"n": "count(*)"}, {"at": k, "key": S.text(c)}, f"{c} IS NOT NULL") for n, k in (("month", MONTH), ("day", DAY), ("calendar_month", CAL)) for d, c in (("gender", "gender_code"), ("urgency", "urgency_code"))},
    **{f"features_{n}": aggregate({k: count(c) for k, c in S.FEATURES.items()} | {"with_any": count(" OR ".join(f"coalesce({c}, FALSE)" if "NULL" not in c else c for c in S.FEATURES.values()))}, {"at": k}) for n, k in (("month", MONTH), ("day", DAY), ("calendar_month", CAL))},
    **{f"resources_{n}": aggregate({k: count(c) for k, c in S.RESOURCES.items()} | {"with_any": count("coalesce(requires_resus, FALSE) OR coalesce(requires_cathlab, FALSE)")}, {"at": k}) for n, k in (("month", MONTH), ("day", DAY), ("calendar_month", CAL))},
    "first_year": aggregate({"year": "min(created_year)", "before": count("created_year < 1997")}),
    "first_day": aggregate({"day": (DAY[0].replace("created_at", "min(created_at)"), DAY[1].replace("created_at", "min(created_at)")), "before": ("count_if(created_at < TIMESTAMP_NTZ '1997-05-17 00:00:00')", "count(*) FILTER (WHERE created_at < TIMESTAMP '1997-05-17')")}),
    **{f"series_year{suffix}": aggregate({"n": "count(*)"}, {"at": "created_year"} | keys, where) for suffix, keys, where in (("", {}, ""), ("_by_gender", {"key": S.text("gender_code")}, "gender_code IS NOT NULL"), ("_by_urgency", {"key": S.text("urgency_code")}, "urgency_code IS NOT NULL"))},
    "catalog_dates": aggregate({"n": "count(*)", **{k: (DAY[0].replace("created_at", f"{f}(created_at)"), DAY[1].replace("created_at", f"{f}(created_at)")) for k, f in (("first", "min"), ("last", "max"))}}, {"infection_id": "infection_id"}, "infection_id IS NOT NULL"),
    "profile_unknown": aggregate({"n": "count(*)", "without_times": count("minutes IS NULL"), "negative": count("rounded_minutes < 0")}, where=f"({S.minute_buckets()}) = '{S.UNKNOWN}'"),
    "indication_metrics": aggregate(headline(INDICATION, "ind_") | age_counts(INDICATION, "ind_") | middles(INDICATION, "ind_") | headline(OTHER, "base_") | middles(OTHER, "base_")),
    "indication_group_members": aggregate({"total": "count(*)", "resus": count("requires_resus"), "cpr": count("is_cpr"), "emergencies": count("urgency_code = 1")}, {"indication": "indication_id"}, INDICATION),
    "indication_compare": aggregate(headline(SIDE_A, "a_") | middles(SIDE_A, "a_") | headline(SIDE_B, "b_") | middles(SIDE_B, "b_"), where=f"{SIDE_A} OR {SIDE_B}"),
    "benchmark_metrics": aggregate(headline(PRIMARY, "p_") | middles(PRIMARY, "p_") | headline(COMPARISON, "c_") | middles(COMPARISON, "c_"), where=f"({PRIMARY}) OR ({COMPARISON})"),
    "benchmark_slim": aggregate({f"{s}_{k}": count(f"({c}) AND ({side})") for s, side in (("p", PRIMARY), ("c", COMPARISON)) for k, c in CLINICAL.items()}, where=f"({PRIMARY}) OR ({COMPARISON})"),
    "case_flow_baseline": aggregate({"mean_minutes": "round(avg(minutes), 6)", "median_minutes": median("minutes"), "full_tier_share": S.rate("tier_code = 3")}),
    "case_flow_regional": aggregate({"total": "count(*)", "regional": count("dispatch_area_id = area_id"), "full_tier": count("tier_code = 3"), "emergencies": count("urgency_code = 1"), "mean_minutes": "round(avg(minutes), 6)", "median_minutes": median("minutes")}, where="created_year = 1997", hospital=True),
    "case_flow_origin": aggregate({"cases": "count(*)", "emergencies": count("urgency_code = 1")}, {"origin": "dispatch_area_id"}),
    **{f"case_flow_by_{n}": aggregate(CASES, {"group_key": _named(c, names)}, hospital=True) for n, c, names in (("tier", "tier_code", S.TIER), ("location", "location_code", S.LOCATION), ("size", "size_code", S.SIZE))},
    "case_flow_matrix": aggregate(CASES, {"origin": "dispatch_area_id", "tier": _named("tier_code", S.TIER)}),
    "case_flow_transport": aggregate({"cases": "count(*)"}, {"minutes_bucket": S.minute_buckets()}),
    "case_flow_urgency": aggregate({"cases": "count(*)"}, {"minutes_bucket": S.minute_buckets(), "urgency": "urgency_code"}),
    "quality_hospital_counts": aggregate({"n": "count(*)"}, {"hospital_id": "hospital_id"}, "created_year = 1997"),
    "catalog_coverage": aggregate({"n": "count(*)", "n_hospitals": "count(DISTINCT hospital_id)", "n_areas": "count(DISTINCT dispatch_area_id)", "n_states": "count(DISTINCT state_id)", "first_year": "min(created_year)", "last_year": "max(created_year)"}, {"speciality_id": "speciality_id"}),
    "catalog_years": aggregate({"n": "CASE WHEN count(*) > 0 AND count(*) < 5 THEN NULL ELSE count(*) END"}, {"department_id": "department_id", "year": "created_year"}),
    "pattern_age_groups": aggregate({"n": "count(*)"}, {"tier": "tier_code", "location": "location_code", "age_bucket": S.steps([(18, "'0-17'"), (40, "'18-39'"), (65, "'40-64'")], "age", "'65-99'")}),
    "pattern_minutes": aggregate({f"p{int(p * 100)}": (S.quantile("rounded_minutes", p, "spark"), S.quantile("rounded_minutes", p, DUCK)) for p in (0.25, 0.5, 0.75, 0.9)}, {"tier": "tier_code", "location": "location_code"}),
    "kpi_by_import": aggregate({"n": "count(*)", "closed": count("department_was_closed"), "first_at": (MONTH[0].replace("created_at", "min(created_at)"), MONTH[1].replace("created_at", "min(created_at)"))}, {"import_id": "import_id"}),
}


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
