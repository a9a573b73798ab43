"""Optional filters of dashboards and lists, and scopes by name: conditions that Spark and any SQL engine take."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from .spec import Scope

#: Age ranges by the names that filters use (both ends inclusive, None is open).
AGE_RANGES = {"under_18": (None, 17), "over_80": (80, None), "0_18": (None, 18), "19_29": (19, 29)} | {f"{a}_{a + 9}": (a, a + 9) for a in range(30, 100, 10)}


def literal(value: object) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def age_condition(name: str, column: str = "age") -> list[str]:
    """An unknown name restricts nothing."""
    low, high = AGE_RANGES.get(name, (None, None))
    return ([f"{column} >= {low}"] if low is not None else []) + ([f"{column} <= {high}"] if high is not None else [])


def _equals(spec: object, columns: dict[str, str]) -> list[str]:
    return [f"{column} = {literal(v)}" for name, column in columns.items() if (v := getattr(spec, name)) is not None]


@dataclass(frozen=True)
class DrawerFilter:
    """Fourteen optional predicates of a dashboard; what is None restricts nothing."""

    gender: int | None = None
    urgency: int | None = None
    age_group: str | None = None
    department: int | None = None
    speciality: int | None = None
    requires_resus: bool | None = None
    requires_cathlab: bool | None = None
    is_ventilated: bool | None = None
    is_shock: bool | None = None
    is_cpr: bool | None = None
    is_pregnant: bool | None = None
    is_work_accident: bool | None = None
    is_infectious: bool | None = None
    infection: int | None = None

    def sql(self) -> list[str]:
        columns = {"gender": "gender_code", "urgency": "urgency_code", "department": "department_id", "speciality": "speciality_id", "infection": "infection_id"}
        flags = {f.name: f.name for f in fields(self) if f.name.startswith(("requires_", "is_")) and f.name != "is_infectious"}
        infectious = [] if self.is_infectious is None else [f"infection_id IS {'NOT ' if self.is_infectious else ''}NULL"]
        return _equals(self, columns | flags) + age_condition(self.age_group or "") + infectious


@dataclass(frozen=True)
class ListFilter:
    """Optional predicates of the list of allocations. hospital_ids: an empty tuple is nobody. arrival: both ends inclusive."""

    import_id: int | None = None
    hospital_ids: tuple[int, ...] | None = None
    tier: int | None = None
    location: int | None = None
    size: int | None = None
    urgency: int | None = None
    state: int | None = None
    dispatch_area: int | None = None
    requires_resus: bool | None = None
    requires_cathlab: bool | None = None
    is_ventilated: bool | None = None
    is_shock: bool | None = None
    is_cpr: bool | None = None
    is_pregnant: bool | None = None
    is_work_accident: bool | None = None
    is_infectious: bool | None = None
    infection: int | None = None
    indication: int | None = None
    secondary_transport: int | None = None
    department: int | None = None
    speciality: int | None = None
    assignment: int | None = None
    occasion: int | None = None
    department_was_closed: bool | None = None
    transport_type: int | None = None
    arrival: tuple[dt.datetime, dt.datetime] | None = None

    def sql(self) -> list[str]:
        codes = {"import_id": "import_id", "tier": "tier_code", "location": "location_code", "size": "size_code", "urgency": "urgency_code", "transport_type": "transport_type_code", "department_was_closed": "department_was_closed"}
        ids = {n: f"{n}_id" for n in ("state", "dispatch_area", "infection", "indication", "secondary_transport", "department", "speciality", "assignment", "occasion")}
        flags = {f.name: f.name for f in fields(self) if f.name.startswith(("requires_", "is_")) and f.name != "is_infectious"}
        infectious = [] if self.is_infectious is None else [f"infection_id IS {'NOT ' if self.is_infectious else ''}NULL"]
        range_ = [] if self.arrival is None else [f"arrival_at >= CAST('{self.arrival[0]:%Y-%m-%d %H:%M:%S}' AS TIMESTAMP)", f"arrival_at <= CAST('{self.arrival[1]:%Y-%m-%d %H:%M:%S}' AS TIMESTAMP)"]
        return Scope(self.hospital_ids).sql() + _equals(self, codes | ids | flags) + infectious + range_


def searched(rows: DataFrame, column: str, term: str) -> DataFrame:
    """Rows whose text holds the term, whatever the case; signs of patterns are plain characters."""
    return rows.where(F.contains(F.lower(column), F.lower(F.lit(term))))


def resolved_scope(name: str, facts: DataFrame, hospitals: DataFrame, value: object = None, mine: tuple[int, ...] = ()) -> Scope:
    """A scope by name. The hospitals of a state or cohort are those with allocations; where there are none the scope is everyone's, as in the reference.

    public; hospital, dispatch_area and state by id; cohort by its name (location_tier); anything
    else is the hospitals of one's own. Only ids of hospitals are collected, a small table.
    """
    ids = lambda where: tuple(sorted(r[0] for r in facts.select("hospital_id").distinct().join(hospitals.where(where), "hospital_id", "left_semi").collect())) or None
    if name == "public":
        return Scope()
    if name == "hospital" and value is not None:
        return Scope((int(value),))
    if name == "state" and value is not None:
        return Scope(ids(f"hospital_state_id = {int(value)}"))
    if name == "dispatch_area" and value is not None:
        return Scope(dispatch_area_id=int(value))
    if name == "cohort" and value is not None:
        codes = {f"{loc}_{tier}": (i, j) for i, loc in S.LOCATION.items() for j, tier in S.TIER.items()}
        location, tier = codes[str(value)]
        return Scope(ids(f"location_code = {location} AND tier_code = {tier}"), locations=(location,), tiers=(tier,))
    return Scope(mine)


def hospitals_in_scope(hospitals: DataFrame, facts: DataFrame, scope: Scope) -> DataFrame:
    """Hospitals of a scope; a dispatch area means those with allocations from it."""
    rows = hospitals
    for condition in Scope(scope.hospital_ids, None, scope.locations, scope.tiers).sql():
        rows = rows.where(condition)
    if scope.dispatch_area_id is not None:
        rows = rows.join(facts.where(f"dispatch_area_id = {scope.dispatch_area_id}").select("hospital_id").distinct(), "hospital_id", "left_semi")
    return rows
