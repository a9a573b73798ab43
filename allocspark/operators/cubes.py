"""Counts by fine grain, kept by import, from which slices of dashboards are rolled up without reading facts.

A cube has axes, on which sides and scopes put conditions, and kinds, the distributions that
slices show: a row counts an import's allocations by axes and one kind's values, or, where axes are so fine that
hardly two rows share them, by axes and the values of all kinds together. Counts are
additive, so an import is added or withdrawn with its part of the cube, in the same change as
its facts, and any slice is a sum over parts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..session import shared_dir
from ..sources.binding import facts
from .aggregates import COMPARISON, INDICATION, PRIMARY, SIDE_A, SIDE_B, Pair
from .slices import HEAT, MINUTES, PEOPLE, SERIES, TYPE, Kind, _duck_slice, grouping_slice
from .store import Store, dropped_import, replaced_import


@dataclass(frozen=True)
class Cube:
    """Columns that conditions may use, the distributions that it can give, and whether these are counted together: at most a row for each allocation, not one for each kind."""

    axes: tuple[str, ...]
    kinds: tuple[Kind, ...]
    together: bool = False


CUBES = {
    "by_period": Cube(("created_year", "created_month"), (SERIES, MINUTES, TYPE, *HEAT)),
    "by_hospital": Cube(("created_year", "created_month", "hospital_id"), (SERIES, MINUTES, TYPE, *PEOPLE, *HEAT, ("indication", "indication_id", None), ("speciality", "speciality_id", None), ("month", "created_month", None)), together=True),
    "by_indication": Cube(("indication_id",), (SERIES, MINUTES, *PEOPLE, *HEAT, ("gender_age", "gender_code", "age_bucket"), ("gender_urgency", "gender_code", "urgency_code"))),
}


def cells(rows: DataFrame, cube: Cube) -> DataFrame:
    """import_id, axes, slice_kind, dim1, dim2 (as texts) and n of the rows; of kinds counted together import_id, axes, all kinds' keys and n."""
    wide = rows.withColumns({"minutes_bucket": F.expr(S.minute_buckets()), "age_bucket": F.expr(S.ages(17))})
    if cube.together:
        return wide.groupBy(*dict.fromkeys(("import_id", *cube.axes, *(k for _, a, b in cube.kinds for k in (a, b) if k)))).agg(F.count(F.lit(1)).alias("n"))
    text = lambda k: F.expr(S.text(k)) if k else F.lit(None).cast("string")
    shown = F.explode(F.array(*[F.struct(F.lit(name).alias("slice_kind"), text(a).alias("dim1"), text(b).alias("dim2")) for name, a, b in cube.kinds])).alias("cell")
    keys = ("import_id", *cube.axes)
    return wide.select(*keys, shown).groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n")).select(*keys, "cell.*", "n")


def built(store: Store, rows: DataFrame, names: tuple[str, ...] = tuple(CUBES)) -> None:
    """All cubes, or those named, of all imports, in one change."""
    with store.change() as change:
        for name in names:
            change.replace_by(name, F.col("import_id"), cells(rows, CUBES[name]))


def replaced(store: Store, import_id: int, rows: DataFrame, names: tuple[str, ...] = tuple(CUBES)) -> None:
    """An import's counts in all cubes, or those named, from its rows now."""
    own = rows.where(F.col("import_id") == import_id)
    replaced_import(store, import_id, {name: cells(own, CUBES[name]) for name in names})


def rolled_up(store: Store, cube: str, kinds: list[Kind], values: dict[str, str], where: str = "", skip_null: tuple[str, ...] = (), imports: list[int] | None = None) -> DataFrame:
    """slice_kind, dim1, dim2 and the values (name and condition on the axes) of a slice; of some imports only, if they are given."""
    unknown = {name for name, _, _ in kinds} - {name for name, _, _ in CUBES[cube].kinds}
    if unknown:
        raise ValueError(f"{cube} has no {', '.join(sorted(unknown))}")
    rows = store.read(cube, imports)
    rows = rows.where(where) if where else rows
    if CUBES[cube].together:
        counted = rows.withColumns({name: F.expr(f"CASE WHEN {c} THEN n ELSE 0 END") for name, c in ({} if values == {"n": "TRUE"} else values).items()})
        return grouping_slice(counted, kinds, {name: f"sum({name})" for name in values}, skip_null)
    rows = rows.where(F.col("slice_kind").isin([name for name, _, _ in kinds]))
    if skip_null:
        rows = rows.where(~(F.col("slice_kind").isin(list(skip_null)) & F.col("dim1").isNull()))
    return rows.groupBy("slice_kind", "dim1", "dim2").agg(*[F.sum(F.expr(f"CASE WHEN {c} THEN n ELSE 0 END")).alias(name) for name, c in values.items()])


#: The slices of four dashboards: cube, kinds, values, rows that count, kinds without their nulls.
SLICES = {
    "overview": ("by_period", [SERIES, MINUTES, TYPE, *HEAT], {"n": "TRUE"}, "", ("transport_type",)),
    "indication": ("by_indication", [SERIES, MINUTES, *PEOPLE, *HEAT, ("gender_age", "gender_code", "age_bucket"), ("gender_urgency", "gender_code", "urgency_code")], {"n": "TRUE"}, INDICATION, ()),
    "compare": ("by_indication", [SERIES, MINUTES, *PEOPLE, *HEAT], {"n1": SIDE_A, "n2": SIDE_B}, f"{SIDE_A} OR {SIDE_B}", ()),
    "benchmark": ("by_hospital", [MINUTES, TYPE, *PEOPLE, *HEAT, ("indication", "indication_id", None), ("speciality", "speciality_id", None), ("month", "created_month", None)], {"n1": PRIMARY, "n2": COMPARISON}, f"({PRIMARY}) OR ({COMPARISON})", ()),
}
#: What is left of the facts after one import was replaced by a part of itself, and another one withdrawn.
LEFT = "import_id <> 199606 AND (import_id <> 199605 OR hospital_id % 2 = 0)"
_kept: dict[tuple[str, str, str], Store] = {}


def _kept_cube(spark: SparkSession, d: str, cube: str) -> Store:
    """One cube of a folder of tables, built once an application, then changed by two imports. A slice pays for its own grain only."""
    key = (spark.sparkContext.applicationId, d, cube)
    if key not in _kept:
        store, rows = Store(spark, f"{shared_dir(spark)}/cubes-{uuid.uuid4().hex}"), facts(spark, d)
        built(store, rows, (cube,))
        replaced(store, 199605, rows.where("hospital_id % 2 = 0"), (cube,))
        dropped_import(store, 199606)
        _kept[key] = store
    return _kept[key]


def _pair(name: str) -> Pair:
    cube, kinds, values, where, skip = SLICES[name]
    counts = {k: f"count(CASE WHEN {c} THEN 1 END)" for k, c in values.items()}
    return (lambda spark, d: rolled_up(_kept_cube(spark, d, cube), cube, kinds, values, where, skip)), _duck_slice(kinds, counts, f"({LEFT}) AND ({where or 'TRUE'})", skip)


QUERIES: dict[str, Pair] = {f"cube_{name}_slice": _pair(name) for name in SLICES}
