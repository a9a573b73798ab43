"""From a specification to a DataFrame: one scan, one aggregation, small windows over its result."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from .filters import hospitals_in_scope
from .spec import Analysis


def restricted(df: DataFrame, conditions: list[str]) -> DataFrame:
    return reduce(lambda d, c: d.where(c), conditions, df)


def _shares(out: DataFrame, metrics: tuple[str, ...], drop_count: bool) -> DataFrame:
    """Shares of the returned rows, 0 for an empty total."""
    for name, window in (("percent_of_total", Window.partitionBy(F.lit(1))), ("percent_of_bucket", Window.partitionBy("bucket"))):
        if name in metrics:
            total = F.sum("count").over(window)
            out = out.withColumn(name, F.when(total > 0, F.round(100 * F.col("count").cast("double") / total, 2)).otherwise(F.lit(0.0)))
    return out.drop("count") if drop_count else out


def analyse(spec: Analysis, facts: DataFrame, hospitals: DataFrame) -> DataFrame:
    """bucket, series (where asked for) and a column for each metric (five for a box plot)."""
    if spec.source == "hospitals":
        return _hospital_rows(spec, facts, hospitals)
    rows = restricted(facts, spec.conditions())
    if spec.dimension in S.UNPIVOTED:
        return _unpivoted(spec, rows)
    keys = {"bucket": S.DIMENSIONS[spec.dimension]} | ({"series": S.DIMENSIONS[spec.series]} if spec.series else {})
    rows = rows.withColumns({k: F.expr(e) for k, e in keys.items()})
    return _grouped(spec, rows, list(keys))


def _grouped(spec: Analysis, rows: DataFrame, keys: list[str]) -> DataFrame:
    if not spec.null_buckets:
        rows = restricted(rows, [f"{k} IS NOT NULL AND {k} <> '{S.UNKNOWN}'" for k in keys])
    wanted = [m for m in spec.metrics if m in S.METRICS]
    shares = [m for m in spec.metrics if m in S.SHARES]
    columns = [F.expr(S.METRICS[m].spark).alias(m) for m in dict.fromkeys([*wanted, *(["count"] if shares else [])])]
    for box in (m for m in spec.metrics if m in S.BOXES):
        value = S.BOXES[box]
        rows = rows.where(f"{value} IS NOT NULL")
        # the five numbers; both ends are cut to whole numbers
        columns += [F.expr(f"CAST(min({value}) AS INT)").alias("low"), *[F.expr(S.quantile(value, p, "spark")).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], F.expr(f"CAST(max({value}) AS INT)").alias("high")]
    return _shares(rows.groupBy(*keys).agg(*columns), spec.metrics, bool(shares) and "count" not in spec.metrics)


def _unpivoted(spec: Analysis, rows: DataFrame) -> DataFrame:
    """One pass counts every indicator of a group; the counts then become rows. Rates are of all rows of the group."""
    indicators = S.UNPIVOTED[spec.dimension]
    if spec.series in S.UNPIVOTED:
        return co_occurrence(rows, indicators, S.UNPIVOTED[spec.series])
    keys = ["series"] if spec.series else []
    if spec.series:
        rows = rows.withColumn("series", F.expr(S.DIMENSIONS[spec.series]))
        rows = rows if spec.null_buckets else rows.where(f"series IS NOT NULL AND series <> '{S.UNKNOWN}'")
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(c)).alias(k) for k, c in indicators.items()])
    pairs = ", ".join(f"'{k}', {k}" for k in indicators)
    long = counted.where("n > 0").select(*keys, "n", F.expr(f"stack({len(indicators)}, {pairs}) AS (bucket, count)"))
    out = {"count": F.col("count"), "prevalence_rate": F.round(100 * F.col("count").cast("double") / F.col("n"), 6)}
    return long.select("bucket", *keys, *[out[m].alias(m) for m in spec.metrics])


def co_occurrence(rows: DataFrame, first: dict[str, str], second: dict[str, str]) -> DataFrame:
    """Counts of rows where an indicator of each kind holds."""
    counted = rows.agg(*[F.count_if(F.expr(f"({a}) AND ({b})")).alias(f"{i}__{j}") for i, a in first.items() for j, b in second.items()])
    cells = ", ".join(f"'{i}', '{j}', {i}__{j}" for i in first for j in second)
    return counted.select(F.expr(f"stack({len(first) * len(second)}, {cells}) AS (bucket, series, count)"))


def hospital_rows(facts: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Hospitals with the number of their allocations and the median of their minutes (null without any). Facts are aggregated before the join."""
    per = facts.groupBy("hospital_id").agg(F.count(F.lit(1)).alias("allocations"), F.expr("percentile(minutes, 0.5)").alias("median_minutes"))
    return hospitals.join(per, "hospital_id", "left")


def _hospital_rows(spec: Analysis, facts: DataFrame, hospitals: DataFrame) -> DataFrame:
    """The scope restricts the hospitals (a dispatch area: those with allocations from it), the period their allocations."""
    rows = hospital_rows(restricted(facts, spec.period.sql()), hospitals_in_scope(hospitals, facts, spec.scope))
    boxed = any(m in S.BOXES for m in spec.metrics)
    if spec.population == "participating":
        rows = rows.where("participating")
    if spec.population == "compare":
        groups = F.explode(F.array(F.lit("participating"), F.lit("non_participating")))
        rows = rows.withColumn("population_group", groups)
        own = "participating = (population_group = 'participating')"
        # The number of hospitals and box plots are of a group's own; other metrics are of all hospitals in both groups.
        rows = rows.where(own) if boxed else rows.withColumn("counted", F.expr(f"CASE WHEN {own} THEN hospital_id END"))
    keys = {"bucket": S.HOSPITAL_DIMENSIONS[spec.dimension]} | ({"series": S.HOSPITAL_DIMENSIONS[spec.series]} if spec.series else {})
    rows = rows.withColumns({k: F.expr(e) for k, e in keys.items()})
    if spec.population == "compare" and not boxed:
        rows = rows.withColumn("hospital_id", F.col("counted"))
    return _grouped(spec, rows, list(keys))


def pivoted(rows: DataFrame, value: str = "count", columns: list[str] | None = None) -> DataFrame:
    """A matrix of bucket by series; missing cells are 0."""
    return rows.groupBy("bucket").pivot("series", columns).agg(F.first(value)).na.fill(0)


#: Metrics whose totals are sums; means are weighted by the number of hospitals.
ADDITIVE = ("count", "hospital_count", "sum_beds", "total_allocations", "percent_of_total")
EXTREMES = {"min_beds": F.min, "max_beds": F.max, "min_allocations_per_hospital": F.min, "max_allocations_per_hospital": F.max}


def totals(rows: DataFrame, metrics: tuple[str, ...] = ("count",)) -> DataFrame:
    """Row, column and grand totals, with null for all: sums of additive metrics (a grand total of percents is 100), means weighted by hospital_count (plain ones without it), extremes of extremes, null for others."""
    keys = [k for k in ("bucket", "series") if k in rows.columns]

    def total(m: str):
        if m in ADDITIVE:
            return F.sum(m)
        if m in EXTREMES:
            return EXTREMES[m](m)
        if m.startswith(("avg_", "mean_")):
            return F.sum(F.col(m) * F.col("hospital_count")) / F.sum(F.when(F.col(m).isNotNull(), F.col("hospital_count"))) if "hospital_count" in rows.columns else F.avg(m)
        return F.lit(None).cast("double")

    return rows.cube(*keys).agg(*[total(m).alias(m) for m in metrics], F.grouping_id().alias("level"))


#: The dimension of each time grain; none for the total.
GRAINS = {"total": None, "month": "month", "quarter": "quarter", "week": "week", "year": "year"}


def by_grain(spec: Analysis, grain: str, facts: DataFrame, hospitals: DataFrame) -> DataFrame:
    """The specification with its temporal dimension chosen by a grain; ``total`` is one row without buckets."""
    dimension = GRAINS[grain]
    if dimension:
        return analyse(replace(spec, dimension=dimension), facts, hospitals)
    return restricted(facts, spec.conditions()).agg(*[F.expr(S.METRICS[m].spark).alias(m) for m in spec.metrics])


def top_with_rest(rows: DataFrame, k: int, value: str = "count", rest: str = "other") -> DataFrame:
    """The k largest buckets (by total, then name); the others are one."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("total"), "bucket")
    ranked = rows.groupBy("bucket").agg(F.sum(value).alias("total")).withColumn("rank", F.row_number().over(order))
    return ranked.groupBy(F.when(F.col("rank") <= k, F.col("bucket")).otherwise(F.lit(rest)).alias("bucket")).agg(F.sum("total").alias(value))


def table_percents(rows: DataFrame, value: str = "count") -> DataFrame:
    """Each cell's percent of all and of its bucket, null where there is nothing to divide by."""
    for name, window in (("of_total", Window.partitionBy(F.lit(1))), ("of_row", Window.partitionBy("bucket"))):
        total = F.sum(value).over(window)
        rows = rows.withColumn(name, F.when(total > 0, F.round(100 * F.col(value).cast("double") / total, 2)))
    return rows
