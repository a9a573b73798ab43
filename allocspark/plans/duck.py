"""DuckDB SQL for specifications, built apart from the DataFrame plans."""

from __future__ import annotations

from ..functions import semantics as S
from ..sources.binding import DUCK, duck_with
from .spec import Analysis


def _where(conditions: list[str]) -> str:
    return f" WHERE {' AND '.join(f'({c})' for c in conditions)}" if conditions else ""


def analysis_sql(spec: Analysis) -> str:
    if spec.source == "hospitals":
        return _hospital_sql(spec)
    if spec.dimension in S.UNPIVOTED:
        return _unpivot_sql(spec)
    keys = {"bucket": S.DIMENSIONS[spec.dimension]} | ({"series": S.DIMENSIONS[spec.series]} if spec.series else {})
    inner = f"SELECT *, {', '.join(f'{e} AS {k}' for k, e in keys.items())} FROM fact{_where(spec.conditions())}"
    return duck_with(f"x AS ({inner})") + _grouped_sql(spec, list(keys))


def _grouped_sql(spec: Analysis, keys: list[str]) -> str:
    conditions = [] if spec.null_buckets else [f"{k} IS NOT NULL AND {k} <> '{S.UNKNOWN}'" for k in keys]
    columns = [f"{S.METRICS[m].duck} AS {m}" for m in spec.metrics if m in S.METRICS]
    for box in (m for m in spec.metrics if m in S.BOXES):
        v = S.BOXES[box]
        conditions.append(f"{v} IS NOT NULL")
        columns += [f"CAST(trunc(min({v})) AS INTEGER) AS low", *[f"{S.quantile(v, p, DUCK)} AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], f"CAST(trunc(max({v})) AS INTEGER) AS high"]
    k = ", ".join(keys)
    shares = [m for m in spec.metrics if m in S.SHARES]
    if not shares:
        return f"SELECT {k}, {', '.join(columns)} FROM x{_where(conditions)} GROUP BY {k}"
    over = {"percent_of_total": "OVER ()", "percent_of_bucket": "OVER (PARTITION BY bucket)"}
    shown = [*keys, *[m for m in spec.metrics if m in S.METRICS], *[f"round(100 * n / sum(n) {over[m]}, 2) AS {m}" for m in shares]]
    return f"SELECT {', '.join(shown)} FROM (SELECT {k}, {', '.join([*columns, 'count(*)::DOUBLE AS n'])} FROM x{_where(conditions)} GROUP BY {k})"


def _unpivot_sql(spec: Analysis) -> str:
    def values(d: str, alias: str) -> tuple[str, str]:
        keys = ", ".join(f"('{k}')" for k in S.UNPIVOTED[d])
        cases = " ".join(f"WHEN '{k}' THEN {c}" for k, c in S.UNPIVOTED[d].items())
        return f"(VALUES {keys}) AS {alias}(k)", f"CASE {alias}.k {cases} END"

    table, holds = values(spec.dimension, "v")
    if spec.series in S.UNPIVOTED:
        other, too = values(spec.series, "w")
        return duck_with() + f"SELECT v.k AS bucket, w.k AS series, count(*) FILTER (WHERE ({holds}) AND ({too})) AS count FROM fact CROSS JOIN {table} CROSS JOIN {other}{_where(spec.conditions())} GROUP BY ALL"
    out = {"count": f"count(*) FILTER (WHERE {holds})", "prevalence_rate": f"round(100.0::DOUBLE * count(*) FILTER (WHERE {holds}) / count(*), 6)"}
    conditions = spec.conditions()
    series = S.DIMENSIONS.get(spec.series or "")
    if series and not spec.null_buckets:
        conditions = [*conditions, f"{series} IS NOT NULL AND {series} <> '{S.UNKNOWN}'"]
    keys = ["v.k AS bucket"] + ([f"{series} AS series"] if series else [])
    return duck_with() + f"SELECT {', '.join([*keys, *[f'{out[m]} AS {m}' for m in spec.metrics]])} FROM fact CROSS JOIN {table}{_where(conditions)} GROUP BY ALL"


def _hospital_sql(spec: Analysis) -> str:
    boxed = any(m in S.BOXES for m in spec.metrics)
    per = f"per AS (SELECT hospital_id, count(*) AS allocations, quantile_cont(minutes, 0.5) AS median_minutes FROM fact{_where(spec.period.sql())} GROUP BY 1)"
    base = "SELECT h.*, allocations, median_minutes FROM hospital h LEFT JOIN per USING (hospital_id)"
    inside = ["participating"] if spec.population == "participating" else []
    if spec.scope.hospital_ids is not None:
        inside.append(f"h.hospital_id IN ({', '.join(map(str, spec.scope.hospital_ids))})" if spec.scope.hospital_ids else "FALSE")
    if spec.scope.dispatch_area_id is not None:
        inside.append(f"EXISTS (SELECT 1 FROM fact f WHERE f.hospital_id = h.hospital_id AND f.dispatch_area_id = {spec.scope.dispatch_area_id})")
    for column, codes in (("location_code", spec.scope.locations), ("tier_code", spec.scope.tiers)):
        if codes:
            inside.append(f"list_contains([{', '.join(map(str, codes))}], h.{column})")
    if inside:
        base += f" WHERE {' AND '.join(inside)}"
    if spec.population == "compare":
        own = "participating = (population_group = 'participating')"
        base = f"SELECT * FROM ({base}) CROSS JOIN (VALUES ('participating'), ('non_participating')) AS g(population_group)"
        base = f"SELECT * FROM ({base}) WHERE {own}" if boxed else f"SELECT * REPLACE (CASE WHEN {own} THEN hospital_id END AS hospital_id) FROM ({base})"
    keys = {"bucket": S.HOSPITAL_DIMENSIONS[spec.dimension]} | ({"series": S.HOSPITAL_DIMENSIONS[spec.series]} if spec.series else {})
    return duck_with(per, f"b AS ({base})", f"x AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in keys.items())} FROM b)") + _grouped_sql(spec, list(keys))
