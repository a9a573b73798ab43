"""Query specifications: what to compute, without how."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from ..functions import semantics as S


@dataclass(frozen=True)
class Period:
    """Half-open range of created_at; either side may be open."""

    start: dt.datetime | None = None
    end: dt.datetime | None = None

    @classmethod
    def resolve(cls, name: str, now: dt.datetime, year: int | None = None, quarter: int = 1, month: int = 1) -> Period:
        """``all``: this and the eleven months before; ``all_time``; ``year``, ``quarter`` or ``month`` by reference values, clamped."""
        first = lambda y, m: dt.datetime(y + (m - 1) // 12, (m - 1) % 12 + 1, 1)
        year = year or now.year
        if name == "all":
            return cls(first(now.year - 1, now.month + 1))
        if name == "all_time":
            return cls()
        if name == "year":
            return cls(first(year, 1), first(year + 1, 1))
        if name == "quarter":
            q = min(4, max(1, quarter))
            return cls(first(year, 3 * q - 2), first(year, 3 * q + 1))
        if name == "month":
            m = min(12, max(1, month))
            return cls(first(year, m), first(year, m + 1))
        raise ValueError(f"unknown period {name}")

    def sql(self) -> list[str]:
        """Conditions on created_at, and on the partitions that can hold such rows."""
        stamp = lambda t: f"CAST('{t:%Y-%m-%d %H:%M:%S}' AS TIMESTAMP)"
        month = lambda t: t.year * 100 + t.month
        exact = [f"created_at {op} {stamp(t)}" for op, t in ((">=", self.start), ("<", self.end)) if t]
        first = [f"created_year * 100 + created_month >= {month(self.start)}"] if self.start else []
        last = [f"created_year * 100 + created_month <= {month(self.end - dt.timedelta(microseconds=1))}"] if self.end else []
        return exact + first + last


@dataclass(frozen=True)
class Scope:
    """hospital_ids: None is everyone, an empty tuple provably nobody; all parts must hold."""

    hospital_ids: tuple[int, ...] | None = None
    dispatch_area_id: int | None = None
    locations: tuple[int, ...] = ()
    tiers: tuple[int, ...] = ()

    @property
    def empty(self) -> bool:
        return self.hospital_ids == ()

    def sql(self) -> list[str]:
        if self.empty:
            return ["1 = 0"]
        inside = lambda c, v: [f"{c} IN ({', '.join(map(str, v))})"] if v else []
        area = [] if self.dispatch_area_id is None else [f"dispatch_area_id = {self.dispatch_area_id}"]
        return inside("hospital_id", self.hospital_ids or ()) + area + inside("location_code", self.locations) + inside("tier_code", self.tiers)


@dataclass(frozen=True)
class Analysis:
    """A semantic query: dimension, optional series, metrics, and what restricts the rows."""

    dimension: str
    series: str | None = None
    metrics: tuple[str, ...] = ("count",)
    source: str = "allocations"
    period: Period = field(default_factory=Period)
    scope: Scope = field(default_factory=Scope)
    filters: tuple[tuple[str, tuple[str, ...]], ...] = ()
    null_buckets: bool = False
    population: str = "participating"

    def __post_init__(self) -> None:
        known = S.HOSPITAL_DIMENSIONS if self.source == "hospitals" else S.DIMENSIONS | S.UNPIVOTED
        for d in filter(None, (self.dimension, self.series)):
            if d not in known:
                raise ValueError(f"{d} is no dimension of {self.source}")
        if "prevalence_rate" in self.metrics and self.dimension not in S.UNPIVOTED:
            raise ValueError("prevalence_rate needs an unpivoted dimension")
        if "percent_of_bucket" in self.metrics and not self.series:
            raise ValueError("percent_of_bucket needs a series")
        if self.source == "hospitals" and self.filters:
            raise ValueError("filters are of allocations; restrict hospitals by a scope")
        for m in self.metrics:
            if m in S.METRICS and S.METRICS[m].hospital != (self.source == "hospitals") and m != "count":
                raise ValueError(f"{m} does not fit {self.source}")
            if m not in S.METRICS and m not in S.SHARES and m not in S.BOXES and m != "prevalence_rate":
                raise ValueError(f"unknown metric {m}")

    def conditions(self) -> list[str]:
        axes = {self.dimension, self.series}
        kept = [f"{S.DIMENSIONS[d]} IN ({', '.join(repr(v) for v in values)})" for d, values in self.filters if d not in axes]
        return self.period.sql() + self.scope.sql() + kept


def views() -> dict[str, Analysis]:
    """The ready-made views."""
    a = {
        "allocations_over_time": Analysis("month"), "allocations_by_year": Analysis("year"), "gender_distribution": Analysis("gender"), "gender_over_time": Analysis("month", "gender"), "urgency_distribution": Analysis("urgency"), "urgency_over_time": Analysis("year", "urgency"),
        "age_group_distribution": Analysis("age_group"), "allocations_by_weekday": Analysis("weekday"), "allocations_by_department": Analysis("department"), "transport_type_distribution": Analysis("transport_type"), "day_time_bucket_distribution": Analysis("day_time_bucket"), "shift_bucket_distribution": Analysis("shift_bucket"),
        "with_physician_distribution": Analysis("with_physician"), "secondary_indication_distribution": Analysis("secondary_indication"), "transport_time_bucket_distribution": Analysis("transport_time_bucket"), "transport_time_distribution_by_urgency": Analysis("urgency", metrics=("transport_time_distribution",)),
        "allocations_weekday_by_day_time_heatmap": Analysis("weekday", "day_time_bucket"), "allocations_weekday_by_shift_heatmap": Analysis("weekday", "shift_bucket"), "allocations_by_hour": Analysis("hour"),
        "overview_clinical_resources": Analysis("clinical_resources", metrics=("prevalence_rate",)), "overview_clinical_features": Analysis("clinical_features", metrics=("prevalence_rate",)), "clinical_resources_by_gender": Analysis("clinical_resources", "gender", ("prevalence_rate",)), "clinical_features_by_urgency": Analysis("clinical_features", "urgency", ("prevalence_rate",)),
        "resus_distribution": Analysis("resus"), "cathlab_distribution": Analysis("cathlab"), "cpr_distribution": Analysis("cpr"), "ventilation_distribution": Analysis("ventilation"), "shock_distribution": Analysis("shock"),
        "allocations_by_speciality": Analysis("speciality"), "allocations_by_occasion": Analysis("occasion"), "allocations_by_infection": Analysis("infection"),
    }
    h = lambda d, s=None, m=("hospital_count",), p="participating": Analysis(d, s, m, "hospitals", population=p)
    per = ("total_allocations", "avg_allocations_per_hospital")
    return a | {
        "hospitals_by_cohort": h("hospital_master_cohort"), "hospitals_by_tier": h("hospital_tier"), "hospitals_by_tier_compare": h("hospital_tier", "hospital_population_group", p="compare"), "hospitals_by_size": h("hospital_size", m=("hospital_count", "avg_beds")), "hospital_tier_by_location": h("hospital_tier", "hospital_location"),
        "allocations_per_hospital_tier": h("hospital_tier", m=per), "beds_distribution_by_tier": h("hospital_tier", m=("beds_distribution",)), "allocations_distribution_by_tier": h("hospital_tier", m=("allocations_per_hospital_distribution",)), "transport_time_distribution_by_tier": h("hospital_tier", m=("transport_time_per_hospital_distribution",)),
        "hospitals_by_location": h("hospital_location"), "beds_distribution_by_location": h("hospital_location", m=("beds_distribution",)), "allocations_per_hospital_size": h("hospital_size", m=per), "allocations_per_hospital_location": h("hospital_location", m=per),
    }
