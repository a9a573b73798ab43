"""Deduplication, projection upkeep, daily figures, materialised dimensions, data quality and disclosure control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.binding import allocations_by_import, duck_with, facts, hospitals, projected
from .aggregates import Pair

#: Limits of data quality and of disclosure control.
EDGES, MIN_ROWS, MIN_CASES, MIN_POOL, ORIGINS = (25, 100, 250), 100, 10, 2, 8
#: What names an event, in the survey's order (both times stand as text), and the columns that make a row more complete.
PRINT = ("hospital_id", "created_at", "arrival_at", "age", "gender_code", "urgency_code", "speciality_id", "department_id", "assignment_id", "dispatch_area_id", "indication_raw_id")
OPTIONAL = ("notes", "assessment_id", "secondary_indication_id", "occasion_id", "infection_id")


def cased(rows: DataFrame) -> DataFrame:
    """Rows with ``event``, ``complete`` and ``case_key`` (bytes). A case is a hospital's case id and event; without a case id the event alone."""
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c.endswith("_at") else F.col(c).cast("string") for c in PRINT]
    event = F.unhex(F.md5(F.concat_ws("|", *shown).cast("binary")))
    complete = sum(((F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("int") for c in OPTIONAL), F.lit(0))
    case = F.when(F.col("case_id").isNotNull(), F.concat("event", F.concat_ws("|", F.lit("c"), "hospital_id", "case_id").cast("binary"))).otherwise(F.col("event"))
    return rows.withColumn("event", event).withColumn("complete", complete).withColumn("case_key", case)


def ranked_copies(rows: DataFrame) -> DataFrame:
    """``rn`` = 1 for the row of each case to keep: the newest import, then the most complete, then the least key."""
    order = Window.partitionBy("case_key").orderBy(F.desc("import_id"), F.desc("complete"), "fact_key")
    return cased(rows).repartition("case_key").withColumn("rn", F.row_number().over(order))  # moved first, so that rows are sorted once


def deduplicated(rows: DataFrame) -> DataFrame:
    return ranked_copies(rows).where("rn = 1").drop("event", "complete", "case_key", "rn")


def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and removed rows of each import and strategy. Imports are dealt anew, so that cases repeat."""
    rows = _repeated(spark, d)
    return ranked_copies(rows).groupBy("import_id", F.col("case_id").isNotNull().alias("by_case_id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rn") > 1, 1)).alias("removed"))


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    """Allocations of which every third comes again in a later import without notes, and others once more in the same import."""
    a = allocations_by_import(spark, d)
    later = a.where("speciality_id % 3 = 0").withColumns({"import_id": F.col("import_id") + 1, "fact_key": F.concat("fact_key", F.lit("-b")), "notes": F.lit(None).cast("string")})
    return a.unionByName(later).unionByName(a.where("speciality_id = 4").withColumns({"fact_key": F.concat("fact_key", F.lit("-c")), "notes": F.lit("")}))


DEDUP = duck_with(
    "two AS (SELECT * FROM alloc UNION ALL SELECT * REPLACE (CAST(import_id + 1 AS INTEGER) AS import_id, concat(fact_key, '-b') AS fact_key, NULL AS notes) FROM alloc WHERE speciality_id % 3 = 0 UNION ALL SELECT * REPLACE (concat(fact_key, '-c') AS fact_key, '' AS notes) FROM alloc WHERE speciality_id = 4)",
    "e AS (SELECT *, md5(concat_ws('|', CAST(hospital_id AS VARCHAR), strftime(created_at, '%Y-%m-%d %H:%M:%S'), strftime(arrival_at, '%Y-%m-%d %H:%M:%S'), CAST(age AS VARCHAR), CAST(gender_code AS VARCHAR), CAST(urgency_code AS VARCHAR), CAST(speciality_id AS VARCHAR), CAST(department_id AS VARCHAR), CAST(assignment_id AS VARCHAR), CAST(dispatch_area_id AS VARCHAR), CAST(indication_raw_id AS VARCHAR))) AS event FROM two)",
    "k AS (SELECT *, CASE WHEN case_id IS NOT NULL THEN concat_ws('|', 'c', hospital_id, case_id, event) ELSE concat_ws('|', 'e', event) END AS case_key, CAST(coalesce(notes, '') <> '' AS INT) + CAST(assessment_id IS NOT NULL AS INT) + CAST(secondary_indication_id IS NOT NULL AS INT) + CAST(occasion_id IS NOT NULL AS INT) + CAST(infection_id IS NOT NULL AS INT) AS complete FROM e)",
    "r AS (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY import_id DESC, complete DESC, fact_key) AS rn FROM k)",
) + "SELECT import_id, case_id IS NOT NULL AS by_case_id, count(*) AS n, count(CASE WHEN rn > 1 THEN 1 END) AS removed FROM r GROUP BY 1, 2"


def write_facts(rows: DataFrame, path: str) -> None:
    """Replace the imports that ``rows`` hold, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(path)


def rebuild(allocations: DataFrame, codes: DataFrame, path: str) -> None:
    write_facts(projected(allocations, codes), path)


def unseen_hospitals(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Hospitals of an import that the facts don't hold yet."""
    return rows.select("hospital_id").distinct().join(known.select("hospital_id").distinct(), "hospital_id", "left_anti")


def only_in_import(spark: SparkSession, d: str) -> DataFrame:
    """Departments of a hospital, each with its import, whose rows all belong to one import."""
    keys = ("hospital_id", "department_id", "indication_id")
    return facts(spark, d).groupBy(*keys).agg(F.min("import_id").alias("import_id"), F.max("import_id").alias("z")).where("import_id = z").select(*keys, "import_id")


def kpi_daily(spark: SparkSession, d: str, within: str = "TRUE") -> DataFrame:
    """A row for each day and hospital, and one for all hospitals of a day, from one pass; of all days, or of a range."""
    rows = facts(spark, d).where(within).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    out = rows.groupingSets([["day", "hospital_id"], ["day"]], "day", "hospital_id").agg(F.count(F.lit(1)).alias("n"), F.expr("count(CASE WHEN department_was_closed THEN 1 END)").alias("closed"))
    return out


def volume_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Hospitals by their number of allocations, and those with enough."""
    n = facts(spark, d).where("created_year = 1997").groupBy("hospital_id").agg(F.count(F.lit(1)).alias("n"))
    bounds = S.steps([(EDGES[0], "'0_24'"), (EDGES[1], "'25_99'"), (EDGES[2], "'100_249'")], "n", "'250_plus'")
    return n.groupBy(F.expr(bounds).alias("bucket")).agg(F.count(F.lit(1)).alias("n_hospitals"), F.count(F.when(F.col("n") >= MIN_ROWS, 1)).alias("enough"), F.sum("n").alias("n_rows"))


def representativeness(spark: SparkSession, d: str) -> DataFrame:
    """Half the sum of the differences between participants' and all hospitals' shares, for each dimension."""
    h = hospitals(spark, d)
    long = h.select("participating", F.expr(f"stack(4, 'tier', {S.coded('tier_code', S.TIER)}, 'location', {S.coded('location_code', S.LOCATION)}, 'size', {S.coded('size_code', S.SIZE)}, 'state', state_name) AS (dimension, key)"))
    cells = long.groupBy("dimension", F.coalesce("key", F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("participating"), 1)).alias("p"))
    w = Window.partitionBy("dimension")
    shares = cells.withColumn("delta", F.abs(F.col("p").cast("double") / F.sum("p").over(w) - F.col("n").cast("double") / F.sum("n").over(w)))
    tvd = shares.groupBy("dimension").agg(F.round(F.sum("delta") / 2, 6).alias("distance"))
    return tvd.withColumn("level", F.expr("CASE WHEN distance <= 0.10 THEN 'high' WHEN distance <= 0.25 THEN 'medium' ELSE 'low' END"))


def subgroup_support(spark: SparkSession, d: str) -> DataFrame:
    """Cells of size and tier: supported with as many participants as there are hospitals, or five."""
    h = hospitals(spark, d).withColumns({"size": F.expr(S.coded("size_code", S.SIZE)), "tier": F.expr(f"coalesce({S.coded('tier_code', S.TIER)}, 'unknown')")})
    c = h.groupBy("size", "tier").agg(F.count(F.lit(1)).alias("population"), F.count(F.when(F.col("participating"), 1)).alias("participants"))
    return c.withColumn("supported", F.col("participants") >= F.least(F.lit(5), F.col("population")))


def descriptive(spark: SparkSession, d: str) -> DataFrame:
    """Number, sum, range, mean, population deviation and interpolated percentiles of beds by size; and the floor-index median."""
    h = hospitals(spark, d).withColumn("size", F.expr(S.coded("size_code", S.SIZE)))
    p = [F.expr(f"round(percentile(beds, {q}), 6)").alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.95)]
    return h.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("beds").alias("total"), F.min("beds").alias("low"), F.max("beds").alias("high"), F.round(F.avg("beds"), 6).alias("mean"), F.round(F.stddev_pop("beds"), 6).alias("sd"), *p, F.expr("sort_array(collect_list(beds))[CAST(floor(0.5 * (count(beds) - 1)) AS INT)]").alias("floor_median"))


def disclosed_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Cases by origin and tier; cells of under 10 cases or 2 hospitals are merged into one of each tier before anything is shown."""
    cells = facts(spark, d).where("created_year = 1997").groupBy("dispatch_area_id", "tier_code").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct("hospital_id").alias("pool"))
    seen = F.expr(f"cases >= {MIN_CASES} AND pool >= {MIN_POOL}")
    return cells.groupBy(F.when(seen, F.col("dispatch_area_id").cast("string")).otherwise("suppressed").alias("origin"), F.coalesce(F.col("tier_code").cast("string"), F.lit("unknown")).alias("tier")).agg(F.sum("cases").alias("cases"))


def disclosed_origins(spark: SparkSession, d: str) -> DataFrame:
    """The eight largest origins; smaller ones and those of under 10 cases are one."""
    n = facts(spark, d).groupBy("dispatch_area_id").agg(F.count(F.lit(1)).alias("cases"))
    r = n.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("cases"), "dispatch_area_id")))
    own = (F.col("rank") <= ORIGINS) & (F.col("cases") >= MIN_CASES)
    return r.groupBy(F.when(own, F.col("dispatch_area_id").cast("string")).otherwise("other").alias("origin")).agg(F.sum("cases").alias("cases"))


def month_report(spark: SparkSession, d: str) -> DataFrame:
    """Cases, rates and medians of a month beside the month and the year before: changes in percent, null from nothing to something."""
    keys = {"now": "created_year = 1998 AND created_month = 3", "previous": "created_year = 1998 AND created_month = 2", "year_before": "created_year = 1997 AND created_month = 3"}
    rows = facts(spark, d).where(" OR ".join(f"({c})" for c in keys.values()))
    a = rows.agg(*[F.expr(f"count(CASE WHEN {c} THEN 1 END)").alias(k) for k, c in keys.items()], F.expr(f"round(percentile(CASE WHEN {keys['now']} THEN minutes END, 0.5), 6)").alias("median_now"))
    change = lambda p: F.when(F.col(p) > 0, F.round(100 * (F.col("now") - F.col(p)).cast("double") / F.col(p), 1)).when(F.col("now") == 0, F.lit(0.0))
    return a.select("*", change("previous").alias("mom"), change("year_before").alias("yoy"))


def mix(spark: SparkSession, d: str) -> DataFrame:
    """Indications of both sides with enough cases, and the ratio of their shares."""
    n = facts(spark, d).groupBy("indication_id").agg(F.expr("count(CASE WHEN created_year = 1997 THEN 1 END)").alias("n1"), F.expr("count(CASE WHEN created_year <> 1997 THEN 1 END)").alias("n2"))
    w = Window.partitionBy(F.lit(1))
    s = n.withColumns({"t1": F.sum("n1").over(w), "t2": F.sum("n2").over(w)}).where("indication_id IS NOT NULL AND n1 >= 20 AND n2 >= 50")
    return s.select("indication_id", "n1", "n2", F.round((F.col("n1").cast("double") / F.col("t1")) / (F.col("n2").cast("double") / F.col("t2")), 6).alias("ratio"))


_H = "SELECT *, coalesce({tier}, 'unknown') AS tier, {size} AS size, {loc} AS loc FROM hospital".format(tier=S.coded("tier_code", S.TIER), size=S.coded("size_code", S.SIZE), loc=S.coded("location_code", S.LOCATION))
_NOW, _PREV, _YEAR = "created_year = 1998 AND created_month = 3", "created_year = 1998 AND created_month = 2", "created_year = 1997 AND created_month = 3"
_C = lambda c: f"count(CASE WHEN {c} THEN 1 END)"
_CH = lambda p: f"CASE WHEN {p} > 0 THEN round(100 * (now - {p})::DOUBLE / {p}, 1) WHEN now = 0 THEN 0.0::DOUBLE END"
QUERIES: dict[str, Pair] = {
    "dedup_report": (dedup_report, DEDUP),
    "dedup_kept": (lambda s, d: deduplicated(_repeated(s, d)).groupBy("import_id").agg(F.count(F.lit(1)).alias("n")), DEDUP[: DEDUP.rindex("SELECT import_id")] + "SELECT import_id, count(*) AS n FROM r WHERE rn = 1 GROUP BY 1"),
    "single_import_departments": (only_in_import, duck_with() + "SELECT DISTINCT hospital_id, department_id, indication_id, import_id FROM fact f WHERE NOT EXISTS (SELECT 1 FROM fact g WHERE g.hospital_id = f.hospital_id AND g.department_id = f.department_id AND g.indication_id IS NOT DISTINCT FROM f.indication_id AND g.import_id <> f.import_id)"),
    "kpi_daily": (lambda s, d: kpi_daily(s, d, "created_year = 1997 AND created_month = 3"), duck_with("k AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM fact WHERE created_year = 1997 AND created_month = 3)") + f"SELECT day, hospital_id, count(*) AS n, {_C('department_was_closed')} AS closed FROM k GROUP BY 1, 2 UNION ALL SELECT day, NULL, count(*), {_C('department_was_closed')} FROM k GROUP BY 1"),
    "kpi_daily_all": (kpi_daily, duck_with("k AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM fact)") + f"SELECT day, hospital_id, count(*) AS n, {_C('department_was_closed')} AS closed FROM k GROUP BY 1, 2 UNION ALL SELECT day, NULL, count(*), {_C('department_was_closed')} FROM k GROUP BY 1"),
    "quality_volume": (volume_histogram, duck_with("n AS (SELECT hospital_id, count(*) AS n FROM fact WHERE created_year = 1997 GROUP BY 1)") + "SELECT CASE WHEN n >= 250 THEN '250_plus' WHEN n >= 100 THEN '100_249' WHEN n >= 25 THEN '25_99' ELSE '0_24' END AS bucket, count(*) AS n_hospitals, count(CASE WHEN n >= 100 THEN 1 END) AS enough, CAST(sum(n) AS BIGINT) AS n_rows FROM n GROUP BY 1"),
    "quality_representativeness": (representativeness, duck_with(f"h AS ({_H})", "l AS (SELECT 'tier' AS dimension, tier AS key, participating FROM h UNION ALL SELECT 'location', coalesce(loc, 'unknown'), participating FROM h UNION ALL SELECT 'size', coalesce(size, 'unknown'), participating FROM h UNION ALL SELECT 'state', state_name, participating FROM h)", "c AS (SELECT dimension, key, count(*) AS n, count(CASE WHEN participating THEN 1 END) AS p FROM l GROUP BY 1, 2)", "t AS (SELECT dimension, abs(p::DOUBLE / sum(p) OVER (PARTITION BY dimension) - n::DOUBLE / sum(n) OVER (PARTITION BY dimension)) AS delta FROM c)", "q AS (SELECT dimension, round(sum(delta) / 2, 6) AS distance FROM t GROUP BY 1)") + "SELECT *, CASE WHEN distance <= 0.10 THEN 'high' WHEN distance <= 0.25 THEN 'medium' ELSE 'low' END AS level FROM q"),
    "quality_subgroups": (subgroup_support, duck_with(f"h AS ({_H})") + "SELECT size, tier, count(*) AS population, count(CASE WHEN participating THEN 1 END) AS participants, count(CASE WHEN participating THEN 1 END) >= least(5, count(*)) AS supported FROM h GROUP BY 1, 2"),
    "population_descriptive": (descriptive, duck_with(f"h AS ({_H})") + "SELECT size, count(*) AS n, CAST(sum(beds) AS BIGINT) AS total, min(beds) AS low, max(beds) AS high, round(avg(beds), 6) AS mean, round(stddev_pop(beds), 6) AS sd, " + ", ".join(f"round(quantile_cont(beds, {q}), 6) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.95)) + ", list_sort(list(beds))[1 + CAST(floor(0.5 * (count(beds) - 1)) AS BIGINT)] AS floor_median FROM h GROUP BY 1"),
    "disclosed_matrix": (disclosed_matrix, duck_with("c AS (SELECT dispatch_area_id, tier_code, count(*) AS n, count(DISTINCT hospital_id) AS pool FROM fact WHERE created_year = 1997 GROUP BY 1, 2)") + "SELECT CASE WHEN n >= 10 AND pool >= 2 THEN CAST(dispatch_area_id AS VARCHAR) ELSE 'suppressed' END AS origin, coalesce(CAST(tier_code AS VARCHAR), 'unknown') AS tier, CAST(sum(n) AS BIGINT) AS cases FROM c GROUP BY 1, 2"),
    "disclosed_origins": (disclosed_origins, duck_with("c AS (SELECT dispatch_area_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, dispatch_area_id) AS r FROM fact GROUP BY 1)") + "SELECT CASE WHEN r <= 8 AND n >= 10 THEN CAST(dispatch_area_id AS VARCHAR) ELSE 'other' END AS origin, CAST(sum(n) AS BIGINT) AS cases FROM c GROUP BY 1"),
    "month_report": (month_report, duck_with(f"a AS (SELECT {_C(_NOW)} AS now, {_C(_PREV)} AS previous, {_C(_YEAR)} AS year_before, round(quantile_cont(CASE WHEN {_NOW} THEN minutes END, 0.5), 6) AS median_now FROM fact)") + f"SELECT *, {_CH('previous')} AS mom, {_CH('year_before')} AS yoy FROM a"),
    "benchmark_mix": (mix, duck_with("n AS (SELECT indication_id, count(CASE WHEN created_year = 1997 THEN 1 END) AS n1, count(CASE WHEN created_year <> 1997 THEN 1 END) AS n2 FROM fact GROUP BY 1)", "t AS (SELECT sum(n1) AS t1, sum(n2) AS t2 FROM n)") + "SELECT indication_id, n1, n2, round((n1::DOUBLE / t1) / (n2::DOUBLE / t2), 6) AS ratio FROM n, t WHERE indication_id IS NOT NULL AND n1 >= 20 AND n2 >= 50"),
}
