"""Dimensions and metrics of the semantic layer, as SQL that Spark and DuckDB both take."""

from __future__ import annotations

from dataclasses import dataclass

from ..sources.binding import DUCK, steps

#: The display keys of the integer codes.
GENDER = {1: "male", 2: "female", 3: "other"}
TIER = {1: "basic", 2: "extended", 3: "full"}
LOCATION = {1: "urban", 2: "mixed", 3: "rural"}
SIZE = {1: "small", 2: "medium", 3: "large"}
#: Clinical indicators of the two unpivoted dimensions.
RESOURCES = {"resus": "requires_resus", "cathlab": "requires_cathlab"}
FEATURES = {"with_physician": "is_with_physician", "cpr": "is_cpr", "ventilation": "is_ventilated", "shock": "is_shock", "pregnancy": "is_pregnant", "work_accident": "is_work_accident", "infection": "infection_id IS NOT NULL"}
UNKNOWN = "unknown"


def text(value: str) -> str:
    return f"CAST({value} AS STRING)"


def flag(value: str) -> str:
    return f"CASE WHEN {value} THEN '1' WHEN NOT ({value}) THEN '0' END"


def coded(value: str, names: dict[int, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " END"


def ages(first: int) -> str:
    """Age groups up to ``first``, to 29, and by tens to 99; others and null are unknown."""
    bounds = [(first + 1, f"'0_{first}'"), (30, f"'{first + 1}_29'")] + [(a + 10, f"'{a}_{a + 9}'") for a in range(30, 100, 10)]
    return f"CASE WHEN age IS NULL OR age < 0 THEN '{UNKNOWN}' ELSE {steps(bounds, 'age', f"'{UNKNOWN}'")} END"


def minute_buckets() -> str:
    """Rounded minutes by tens up to an hour; null and negative ones are unknown."""
    bounds = [(10, "'under_10'")] + [(m + 10, f"'{m}_{m + 10}'") for m in range(10, 60, 10)]
    return f"CASE WHEN rounded_minutes IS NULL OR rounded_minutes < 0 THEN '{UNKNOWN}' ELSE {steps(bounds, 'rounded_minutes', "'over_60'")} END"


def cohort() -> str:
    return f"concat({coded('location_code', LOCATION)}, '_', {coded('tier_code', TIER)})"


def cohort_key() -> str:
    """Null where either part is."""
    return f"CASE WHEN location_code IS NOT NULL AND tier_code IS NOT NULL THEN {cohort()} END"


#: Allocation dimensions: key and text expression over the fact.
DIMENSIONS = {
    "year": text("created_year"), "quarter": text("created_quarter"), "month": text("created_month"), "week": text("created_week"), "hour": text("created_hour"), "weekday": text("created_weekday"),
    "gender": text("gender_code"), "urgency": text("urgency_code"), "age": text("age"), "age_group": ages(18), "hospital_cohort": cohort_key(),
    "department": text("department_id"), "speciality": text("speciality_id"), "occasion": text("occasion_id"), "assignment": text("assignment_id"), "indication": text("indication_id"), "secondary_indication": text("secondary_indication_id"), "infection": text("infection_id"), "hospital": text("hospital_id"), "dispatch_area": text("dispatch_area_id"), "state": text("state_id"),
    "transport_type": text("transport_type_code"), "day_time_bucket": text("day_time_code"), "shift_bucket": text("shift_code"), "transport_time_bucket": minute_buckets(),
    "resus": flag("requires_resus"), "cathlab": flag("requires_cathlab"), "cpr": flag("is_cpr"), "ventilation": flag("is_ventilated"), "shock": flag("is_shock"), "work_accident": flag("is_work_accident"), "pregnancy": flag("is_pregnant"), "with_physician": flag("is_with_physician"),
}
UNPIVOTED = {"clinical_resources": RESOURCES, "clinical_features": FEATURES}
#: Hospital dimensions over the hospital's columns (tier_code and location_code are the hospital's).
HOSPITAL_DIMENSIONS = {
    "hospital_tier": coded("tier_code", TIER), "hospital_size": coded("size_code", SIZE), "hospital_location": coded("location_code", LOCATION), "hospital_state": "state_name", "hospital_dispatch_area": "area_name", "hospital_entity": text("hospital_id"), "hospital_master_cohort": cohort_key(), "hospital_population_group": "population_group",
}


def quantile(value: str, p: float, dialect: str) -> str:
    return f"round(quantile_cont({value}, {p}), 6)" if dialect == DUCK else f"round(percentile({value}, {p}), 6)"


def rate(condition: str) -> str:
    return f"round(CAST(100 AS DOUBLE) * count(CASE WHEN {condition} THEN 1 END) / nullif(count(*), 0), 6)"


@dataclass(frozen=True)
class Metric:
    spark: str
    duck: str
    hospital: bool = False


def _both(sql: str, hospital: bool = False) -> Metric:
    return Metric(sql, sql, hospital)


def _quantile(p: float) -> Metric:
    return Metric(quantile("minutes", p, "spark"), quantile("minutes", p, DUCK))


FLAG_RATES = {"resus_rate": "requires_resus", "cpr_rate": "is_cpr", "shock_rate": "is_shock", "ventilation_rate": "is_ventilated", "cathlab_rate": "requires_cathlab", "pregnancy_rate": "is_pregnant", "work_accident_rate": "is_work_accident", "with_physician_rate": "is_with_physician", "infection_rate": "infection_id IS NOT NULL"}
METRICS = {
    "count": _both("count(*)"),
    "mean_transport_time": _both("round(avg(minutes), 6)"),
    "median_transport_time": _quantile(0.5), "p25_transport_time": _quantile(0.25), "p75_transport_time": _quantile(0.75), "p90_transport_time": _quantile(0.9),
    **{k: _both(rate(v)) for k, v in FLAG_RATES.items()},
    "hospital_count": _both("count(DISTINCT hospital_id)", True),
    "sum_beds": _both("CAST(sum(beds) AS BIGINT)", True), "avg_beds": _both("round(avg(beds), 6)", True), "min_beds": _both("CAST(min(beds) AS BIGINT)", True), "max_beds": _both("CAST(max(beds) AS BIGINT)", True),
    "total_allocations": _both("CAST(coalesce(sum(allocations), 0) AS BIGINT)", True), "avg_allocations_per_hospital": _both("round(avg(allocations), 6)", True), "min_allocations_per_hospital": _both("CAST(coalesce(min(allocations), 0) AS BIGINT)", True), "max_allocations_per_hospital": _both("CAST(coalesce(max(allocations), 0) AS BIGINT)", True),
}
#: Metrics over the aggregated rows, and those that need an unpivoted dimension or a box plot.
SHARES = ("percent_of_total", "percent_of_bucket")
BOXES = {"transport_time_distribution": "minutes", "beds_distribution": "beds", "allocations_per_hospital_distribution": "coalesce(allocations, 0)", "transport_time_per_hospital_distribution": "median_minutes"}
