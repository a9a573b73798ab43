"""All queries of the allocation analytics, with their DuckDB counterparts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.analysis import analyse
from .plans.duck import analysis_sql
from .plans.spec import Analysis, Period, Scope, views
from .sources.binding import facts, hospitals

Query = Callable[[SparkSession, str], DataFrame]


def specs() -> dict[str, Analysis]:
    """Ready-made views, then dimensions, metrics, scopes, periods and filters that they leave out."""
    y97 = Period.resolve("year", dt.datetime(1998, 5, 5), year=1997)
    more = {f"by_{d}": Analysis(d) for d in ("quarter", "week", "age", "hospital_cohort", "assignment", "indication", "hospital", "dispatch_area", "state", "work_accident", "pregnancy")}
    more |= {f"hospitals_by_{d}": Analysis(f"hospital_{d}", metrics=("hospital_count", "sum_beds", "min_beds", "max_beds", "min_allocations_per_hospital", "max_allocations_per_hospital"), source="hospitals", population="all") for d in ("state", "dispatch_area", "entity")}
    more |= {
        "metrics_transport_time": Analysis("urgency", metrics=("count", "mean_transport_time", "median_transport_time", "p25_transport_time", "p75_transport_time", "p90_transport_time")),
        "metrics_rates": Analysis("age_group", metrics=("resus_rate", "cpr_rate", "shock_rate", "ventilation_rate", "cathlab_rate", "pregnancy_rate", "work_accident_rate", "with_physician_rate", "infection_rate")),
        "metrics_shares": Analysis("gender", "urgency", ("count", "percent_of_total", "percent_of_bucket")),
        "period_quarter": Analysis("month", period=Period.resolve("quarter", dt.datetime(1998, 5, 5), year=1997, quarter=9)),
        "period_default": Analysis("month", "gender", period=Period.resolve("all", dt.datetime(1998, 5, 5))),
        "scope_hospitals": Analysis("weekday", scope=Scope(hospital_ids=(1, 3, 5))),
        "scope_empty": Analysis("weekday", scope=Scope(hospital_ids=())),
        "scope_cohort": Analysis("weekday", period=y97, scope=Scope(locations=(1, 2), tiers=(1,))),
        "scope_area": Analysis("gender", scope=Scope(dispatch_area_id=7)),
        "filters": Analysis("day_time_bucket", filters=(("gender", ("1", "2")), ("urgency", ("1",)), ("age_group", ("30_39", "40_49")))),
        "filter_on_axis": Analysis("gender", filters=(("gender", ("1",)), ("cpr", ("1",)))),
        "null_buckets": Analysis("gender", "transport_time_bucket", null_buckets=True),
        "double_unpivot": Analysis("clinical_resources", "clinical_features"),
        "hospital_scope_ids": Analysis("hospital_size", metrics=("hospital_count", "sum_beds"), source="hospitals", population="all", scope=Scope(hospital_ids=(1, 2, 3, 4, 5, 8))),
        "hospital_scope_area": Analysis("hospital_tier", metrics=("hospital_count", "total_allocations"), source="hospitals", scope=Scope(dispatch_area_id=7)),
        "hospital_scope_cohort": Analysis("hospital_location", metrics=("hospital_count", "avg_beds"), source="hospitals", population="compare", scope=Scope(locations=(1, 3), tiers=(2,))),
        "hospital_scope_empty": Analysis("hospital_size", metrics=("hospital_count",), source="hospitals", scope=Scope(hospital_ids=())),
    }
    return {f"view_{k}": v for k, v in views().items()} | {f"semantic_{k}": v for k, v in more.items()}


def _spec_query(spec: Analysis) -> Query:
    return lambda spark, sf_dir: analyse(spec, facts(spark, sf_dir), hospitals(spark, sf_dir))


def queries() -> dict[str, Query]:
    from .operators import registry

    return {name: _spec_query(spec) for name, spec in specs().items()} | registry.queries()


def oracle_sql() -> dict[str, str]:
    from .operators import registry

    return {name: analysis_sql(spec) for name, spec in specs().items()} | registry.oracle_sql()
