"""Hospitals that take part, beside all: coverage, representativeness, support of subgroups, volumes, an overall level, and what allocations rest on.

Allocations are counted by hospital once; the rest works on one row a hospital.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.binding import duck_with, facts, hospitals
from .aggregates import Pair

#: Limits of levels (below the first low, below the second medium), participants that a cell needs, cells from which the population's share counts, allocations that a hospital needs.
COVERAGE, SHARES, SCORES, DISTANCE = (0.20, 0.90), (0.50, 0.80), (1.5, 2.5), (0.10, 0.25)
CELL, CELLS, VOLUME = 5, 5, 100
LEVELS = {1: "low", 2: "medium", 3: "high"}


def by_hospital(spark: SparkSession, d: str, within: str = "TRUE") -> DataFrame:
    """One row a hospital: its groups as text and the number of its allocations (null without any)."""
    n = facts(spark, d).where(within).groupBy("hospital_id").agg(F.count(F.lit(1)).alias("n"))
    text = lambda code, names: F.coalesce(F.expr(S.coded(code, names)), F.lit("unknown"))
    return hospitals(spark, d).join(n, "hospital_id", "left").select("hospital_id", "participating", "beds", "n", text("size_code", S.SIZE).alias("size"), text("tier_code", S.TIER).alias("tier"), text("location_code", S.LOCATION).alias("location"), "area_name")


def level(value: Column, limits: tuple[float, float]) -> Column:
    """1, 2 or 3."""
    return F.when(value < limits[0], 1).when(value < limits[1], 2).otherwise(3)


def coverage(rows: DataFrame) -> DataFrame:
    """Participants and all hospitals, their ratio and its level."""
    c = rows.agg(F.count(F.lit(1)).alias("population"), F.count_if("participating").alias("participants"))
    ratio = F.when(F.col("population") > 0, F.col("participants").cast("double") / F.col("population")).otherwise(F.lit(0.0))
    return c.withColumn("ratio", F.round(ratio, 6)).withColumn("score", level(ratio, COVERAGE))


def distribution_table(rows: DataFrame) -> DataFrame:
    """Size by tier, every cell there: all hospitals, participants, their shares of all and how far apart these are in points."""
    spine = rows.sparkSession.createDataFrame([(a, b) for a in S.SIZE.values() for b in (*S.TIER.values(), "unknown")], "size string, tier string")
    cells = rows.groupBy("size", "tier").agg(F.count(F.lit(1)).alias("population"), F.count_if("participating").alias("participants"))
    full = spine.join(cells, ["size", "tier"], "left").na.fill(0, ["population", "participants"])
    w = Window.partitionBy(F.lit(1))  # twelve rows
    part = lambda c: F.when(F.sum(c).over(w) > 0, 100 * F.col(c).cast("double") / F.sum(c).over(w)).otherwise(F.lit(0.0))
    full = full.withColumns({"a": part("population"), "b": part("participants")})
    return full.select("size", "tier", "population", "participants", F.round("a", 6).alias("share_of_all"), F.round("b", 6).alias("share_of_participants"), F.round(F.col("b") - F.col("a"), 6).alias("points"))


def representativeness(rows: DataFrame) -> DataFrame:
    """Each dimension's distance between participants' and all hospitals' shares, its level, and the groups furthest above and below."""
    long = rows.select("participating", F.expr("stack(4, 'size', size, 'tier', tier, 'location', location, 'area', area_name) AS (dimension, key)"))
    cells = long.groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("participating").alias("p"))
    w = Window.partitionBy("dimension")
    delta = F.coalesce(F.col("p").cast("double") / F.nullif(F.sum("p").over(w), F.lit(0)), F.lit(0.0)) - F.col("n").cast("double") / F.sum("n").over(w)
    cells = cells.withColumn("delta", F.round(delta, 9))
    out = cells.groupBy("dimension").agg((F.sum(F.abs("delta")) / 2).alias("distance"), F.min_by("key", F.struct(-F.col("delta"), "key")).alias("most"), F.min_by("key", F.struct("delta", "key")).alias("least"))
    score = F.when(F.col("distance") <= DISTANCE[0], 3).when(F.col("distance") <= DISTANCE[1], 2).otherwise(1)
    return out.select("dimension", F.round("distance", 4).alias("distance"), score.alias("score"), "most", "least")


def representative_score(details: DataFrame) -> DataFrame:
    """The mean of the dimensions' scores as a level; any dimension that isn't high keeps it from being high."""
    a = details.agg(F.avg("score").alias("mean"), F.min("score").alias("worst"), F.round(F.avg("distance"), 4).alias("distance"))
    plain = level(F.col("mean"), SCORES)
    return a.select("distance", F.when((plain == 3) & (F.col("worst") < 3), 2).otherwise(plain).alias("score"))


def support_cells(rows: DataFrame) -> DataFrame:
    """24 cells of size or location by tier: supported with five participants, or as many as there are hospitals; empty ones are not."""
    long = rows.select("participating", "tier", F.expr("stack(2, 'size', size, 'location', location) AS (kind, key)"))
    cells = long.groupBy("kind", "key", "tier").agg(F.count(F.lit(1)).alias("population"), F.count_if("participating").alias("participants"))
    spine = [(k, a, b) for k, names in (("size", S.SIZE), ("location", S.LOCATION)) for a in names.values() for b in (*S.TIER.values(), "unknown")]
    full = rows.sparkSession.createDataFrame(spine, "kind string, key string, tier string").join(cells, ["kind", "key", "tier"], "left").na.fill(0, ["population", "participants"])
    return full.withColumn("supported", (F.col("population") > 0) & (F.col("participants") >= F.least(F.lit(CELL), F.col("population"))))


def support(cells: DataFrame, hospitals_: Column) -> DataFrame:
    """Shares of supported cells and of hospitals in supported cells; the first rates under five populated cells, else the second."""
    a = cells.agg(F.count_if(F.col("population") > 0).alias("relevant"), F.count_if("supported").alias("supported"), F.sum(F.when(F.col("supported"), F.col("population")).otherwise(0)).alias("inside"))
    by_cell = F.when(F.col("relevant") > 0, F.col("supported").cast("double") / F.col("relevant")).otherwise(F.lit(0.0))
    by_hospital_ = F.when(hospitals_ > 0, F.col("inside").cast("double") / hospitals_).otherwise(F.lit(0.0))
    return a.select("relevant", "supported", F.round(by_hospital_, 4).alias("population_share"), F.round(by_cell, 4).alias("cell_share"), level(F.when(F.col("relevant") < CELLS, by_cell).otherwise(by_hospital_), SHARES).alias("score"))


def volume(rows: DataFrame) -> DataFrame:
    """Allocations by hospital that has any: mean, floor-index percentiles, and the share of hospitals with enough."""
    place = lambda p: F.expr(f"a[CAST(floor({p} * (size(a) - 1)) AS INT)]")
    a = rows.where("n IS NOT NULL").agg(F.count(F.lit(1)).alias("hospitals"), F.sum("n").alias("total"), F.count_if(F.col("n") >= VOLUME).alias("enough"), F.sort_array(F.collect_list("n")).alias("a"))  # one number a hospital
    share = F.when(F.col("hospitals") > 0, F.col("enough").cast("double") / F.col("hospitals")).otherwise(F.lit(0.0))
    return a.select("hospitals", "total", F.round(F.col("total") / F.col("hospitals"), 1).alias("mean"), place(0.25).alias("p25"), place(0.5).alias("p50"), place(0.75).alias("p75"), place(0.95).alias("p95"), F.array_max("a").alias("most"), F.round(share, 4).alias("share"), F.when(F.col("hospitals") > 0, level(share, SHARES)).otherwise(1).alias("score"))


def overall(rows: DataFrame) -> DataFrame:
    """The four levels and the overall one: their mean, and never high while one is low."""
    one = [coverage(rows), representative_score(representativeness(rows)), support(support_cells(rows), F.lit(rows.count())), volume(rows)]
    joined = None
    for name, df in zip(("coverage", "representative", "support", "volume"), one, strict=True):
        part = df.select(F.col("score").alias(name))
        joined = part if joined is None else joined.crossJoin(part)  # one row each
    mean = sum((F.col(c) for c in joined.columns), F.lit(0)) / 4
    plain = level(mean, SCORES)
    return joined.withColumn("overall", F.when((plain == 3) & (F.least(*joined.columns) == 1), 2).otherwise(plain))


def allocation_basis(rows: DataFrame) -> DataFrame:
    """Of hospitals with allocations, by size, tier and location and by two crossings: hospitals, allocations and their share, mean and median of a hospital."""
    sets = [["size"], ["tier"], ["location"], ["size", "tier"], ["location", "tier"]]
    g = rows.where("n > 0").groupingSets(sets, "size", "tier", "location").agg(F.count(F.lit(1)).alias("hospitals"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.expr("round(percentile(n, 0.5), 6)").alias("median"), F.grouping_id().alias("level"))
    whole = F.sum(F.when(F.col("level") == 3, F.col("total"))).over(Window.partitionBy(F.lit(1)))
    return g.withColumn("share", F.round(100 * F.col("total").cast("double") / whole, 6))


_SIZE, _TIER, _LOC = (f"coalesce({S.coded(c, n)}, 'unknown')" for c, n in (("size_code", S.SIZE), ("tier_code", S.TIER), ("location_code", S.LOCATION)))
_H = f"h AS (SELECT hospital_id, participating AS p, beds, n, {_SIZE} AS size, {_TIER} AS tier, {_LOC} AS location, area_name FROM hospital LEFT JOIN (SELECT hospital_id, count(*) AS n FROM fact WHERE created_year = 1997 GROUP BY 1) USING (hospital_id))"
_COVER = "cover AS (SELECT count(*) AS population, count(*) FILTER (WHERE p) AS participants, count(*) FILTER (WHERE p)::DOUBLE / count(*) AS q FROM h)"
_REP = "l AS (SELECT unnest(['size', 'tier', 'location', 'area']) AS dimension, unnest([size, tier, location, area_name]) AS key, p FROM h), e AS (SELECT dimension, key, round(count(*) FILTER (WHERE p)::DOUBLE / (SELECT count(*) FROM h WHERE p) - count(*)::DOUBLE / (SELECT count(*) FROM h), 9) AS delta FROM l GROUP BY 1, 2), rep AS (SELECT dimension, sum(abs(delta)) / 2 AS distance, arg_min(key, (-delta, key)) AS most, arg_min(key, (delta, key)) AS least FROM e GROUP BY 1), reps AS (SELECT dimension, round(distance, 4) AS distance, CASE WHEN distance <= 0.10 THEN 3 WHEN distance <= 0.25 THEN 2 ELSE 1 END AS score, most, least FROM rep)"
_CELLS = "spine AS (SELECT 'size' AS kind, unnest(['small', 'medium', 'large']) AS key UNION ALL SELECT 'location', unnest(['urban', 'mixed', 'rural'])), t4 AS (SELECT unnest(['basic', 'extended', 'full', 'unknown']) AS tier), cells AS (SELECT kind, key, t4.tier, (SELECT count(*) FROM h WHERE h.tier = t4.tier AND CASE kind WHEN 'size' THEN h.size ELSE h.location END = key) AS population, (SELECT count(*) FROM h WHERE p AND h.tier = t4.tier AND CASE kind WHEN 'size' THEN h.size ELSE h.location END = key) AS participants FROM spine CROSS JOIN t4), cell AS (SELECT *, population > 0 AND (participants >= 5 OR participants >= population) AS supported FROM cells)"
_SUP = "sup AS (SELECT count(*) FILTER (WHERE population > 0) AS relevant, count(*) FILTER (WHERE supported) AS supported, coalesce(sum(population) FILTER (WHERE supported), 0)::DOUBLE / (SELECT count(*) FROM h) AS a, count(*) FILTER (WHERE supported)::DOUBLE / count(*) FILTER (WHERE population > 0) AS b FROM cell), sups AS (SELECT relevant, supported, round(a, 4) AS population_share, round(b, 4) AS cell_share, CASE WHEN r < 0.5 THEN 1 WHEN r < 0.8 THEN 2 ELSE 3 END AS score FROM (SELECT *, CASE WHEN relevant < 5 THEN b ELSE a END AS r FROM sup))"
_VOL = "vol AS (SELECT count(*) AS hospitals, CAST(sum(n) AS BIGINT) AS total, round(sum(n) / count(*), 1) AS mean, list_sort(list(n)) AS a, count(*) FILTER (WHERE n >= 100)::DOUBLE / count(*) AS s FROM h WHERE n IS NOT NULL)"
_VOLS = "SELECT hospitals, total, mean, " + ", ".join(f"a[1 + CAST(floor({p} * (len(a) - 1)) AS BIGINT)] AS p{int(100 * p)}" for p in (0.25, 0.5, 0.75, 0.95)) + ", a[-1] AS most, round(s, 4) AS share, CASE WHEN s < 0.5 THEN 1 WHEN s < 0.8 THEN 2 ELSE 3 END AS score FROM vol"
YEAR = "created_year = 1997"
QUERIES: dict[str, Pair] = {
    "population_coverage": (lambda s, d: coverage(by_hospital(s, d, YEAR)), duck_with(_H, _COVER) + "SELECT population, participants, round(q, 6) AS ratio, CASE WHEN q < 0.2 THEN 1 WHEN q < 0.9 THEN 2 ELSE 3 END AS score FROM cover"),
    "population_table": (lambda s, d: distribution_table(by_hospital(s, d, YEAR)), duck_with(_H, "s AS (SELECT * FROM (SELECT unnest(['small', 'medium', 'large']) AS size) CROSS JOIN (SELECT unnest(['basic', 'extended', 'full', 'unknown']) AS tier))", "c AS (SELECT s.size, s.tier, count(h.hospital_id) AS population, count(h.hospital_id) FILTER (WHERE p) AS participants FROM s LEFT JOIN h ON h.size = s.size AND h.tier = s.tier GROUP BY 1, 2)", "x AS (SELECT *, 100 * population::DOUBLE / sum(population) OVER () AS a, 100 * participants::DOUBLE / sum(participants) OVER () AS b FROM c)") + "SELECT size, tier, population, participants, round(a, 6) AS share_of_all, round(b, 6) AS share_of_participants, round(b - a, 6) AS points FROM x"),
    "population_representative": (lambda s, d: representativeness(by_hospital(s, d, YEAR)), duck_with(_H, _REP) + "SELECT * FROM reps"),
    "population_representative_score": (lambda s, d: representative_score(representativeness(by_hospital(s, d, YEAR))), duck_with(_H, _REP) + "SELECT round(avg(distance), 4) AS distance, CASE WHEN avg(score) < 1.5 THEN 1 WHEN avg(score) < 2.5 OR min(score) < 3 THEN 2 ELSE 3 END AS score FROM reps"),
    "population_support_cells": (lambda s, d: support_cells(by_hospital(s, d, YEAR)), duck_with(_H, _CELLS) + "SELECT * FROM cell"),
    "population_support": (lambda s, d: support(support_cells(by_hospital(s, d, YEAR)), F.lit(hospitals(s, d).count())), duck_with(_H, _CELLS, _SUP) + "SELECT * FROM sups"),
    "population_volume": (lambda s, d: volume(by_hospital(s, d, YEAR)), duck_with(_H, _VOL) + _VOLS),
    "population_overall": (lambda s, d: overall(by_hospital(s, d, YEAR)), duck_with(_H, _COVER, _REP, _CELLS, _SUP, _VOL, f"v AS ({_VOLS})", "x AS (SELECT (SELECT CASE WHEN q < 0.2 THEN 1 WHEN q < 0.9 THEN 2 ELSE 3 END FROM cover) AS coverage, (SELECT CASE WHEN avg(score) < 1.5 THEN 1 WHEN avg(score) < 2.5 OR min(score) < 3 THEN 2 ELSE 3 END FROM reps) AS representative, (SELECT score FROM sups) AS support, (SELECT score FROM v) AS volume)") + "SELECT *, CASE WHEN coverage + representative + support + volume < 6 THEN 1 WHEN coverage + representative + support + volume < 10 OR least(coverage, representative, support, volume) = 1 THEN 2 ELSE 3 END AS overall FROM x"),
    "population_allocation_basis": (lambda s, d: allocation_basis(by_hospital(s, d, YEAR)).drop("level"), duck_with(_H, "w AS (SELECT sum(n) AS t FROM h)") + " UNION ALL ".join(f"SELECT {a} AS size, {b} AS tier, {c} AS location, count(*) AS hospitals, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(100 * sum(n)::DOUBLE / (SELECT t FROM w), 6) AS share FROM h WHERE n > 0 GROUP BY {k}" for a, b, c, k in (("size", "NULL", "NULL", "size"), ("NULL", "tier", "NULL", "tier"), ("NULL", "NULL", "location", "location"), ("size", "tier", "NULL", "size, tier"), ("NULL", "tier", "location", "location, tier")))),
    "population_inputs": (lambda s, d: by_hospital(s, d, YEAR).where("participating AND n IS NOT NULL").select("hospital_id", "n", "size", "tier"), duck_with(_H) + "SELECT hospital_id, n, size, tier FROM h WHERE p AND n > 0"),
}
