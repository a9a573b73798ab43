"""Tables that follow imports: delete, cascade, backfill, orphans, upserts by day, materialised views and their triggers, and the review of raw indications.

Tables are folders partitioned by import (or day). A change rewrites whole partitions and
goes through Spark's commit protocol: an import that is run again leaves the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.binding import duck_with, facts, hospitals, raw_allocations
from .aggregates import Pair


def write_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of a key that ``rows`` hold, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def delete_import(spark: SparkSession, path: str, import_id: int) -> int:
    """Drop an import's partition; the number of rows that were in it, 0 where there was none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/import_id={import_id}")
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return 0
    n = spark.read.parquet(path).where(F.col("import_id") == import_id).count()
    store.delete(hadoop, True)
    return n


def clean_import(spark: SparkSession, paths: dict[str, str], import_id: int) -> dict[str, int]:
    """Drop an import from all tables that derive from it."""
    return {name: delete_import(spark, path, import_id) for name, path in paths.items()}


def orphans(projection: DataFrame, allocations: DataFrame) -> DataFrame:
    """Rows of the projection whose allocation is gone."""
    return projection.join(allocations.select("fact_key"), "fact_key", "left_anti")


def without_orphans(projection: DataFrame, allocations: DataFrame) -> DataFrame:
    return projection.join(allocations.select("fact_key").distinct(), "fact_key", "left_semi")


def backfilled(allocations: DataFrame, raw: DataFrame) -> DataFrame:
    """Normalised indications that allocations lack, from their raw indications. raw: raw_id, normalized_id. ``filled`` marks rows that change."""
    known = raw.select(F.col("raw_id").alias("indication_raw_id"), "normalized_id")
    joined = allocations.join(known, "indication_raw_id", "left")
    return joined.withColumn("filled", F.col("indication_id").isNull() & F.col("normalized_id").isNotNull()).withColumn("indication_id", F.coalesce("indication_id", "normalized_id")).drop("normalized_id")


def backfill(spark: SparkSession, path: str, raw: DataFrame, dry_run: bool = False) -> int:
    """Rewrite the imports of a written table that hold rows to fill; their number (of rows) is all that a dry run gives."""
    rows = backfilled(spark.read.parquet(path), raw)
    n = rows.where("filled").count()
    if n and not dry_run:
        touched = rows.where("filled").select("import_id").distinct()
        staged = f"{path}-staged-{uuid.uuid4().hex}"  # a table can't be overwritten while it is read
        rows.join(touched, "import_id", "left_semi").drop("filled").write.parquet(staged)
        write_partitions(spark.read.parquet(staged), path, "import_id")
    return n


def kpi_days(rows: DataFrame) -> DataFrame:
    """By day and hospital, and for all hospitals of a day (hospital_id null): imports, successful and failed ones, rows and rejects of those that are final. imports: day, hospital_id, status, n_rows, n_rejected."""
    final = rows.where("status IN ('completed', 'partial', 'failed')")
    return final.groupingSets([["day", "hospital_id"], ["day"]], "day", "hospital_id").agg(
        F.count(F.lit(1)).alias("imports"), F.count_if(F.col("status") != "failed").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n_rejected"), F.lit(0)).alias("n_rejected"))


def upsert_days(spark: SparkSession, rows: DataFrame, path: str, first: str | None = None, last: str | None = None) -> None:
    """Replace the days from first to last (all, where they are None) by those of ``rows``; a day without rows goes. The table is partitioned by month, and only months of the range are rewritten."""
    month = F.substring("day", 1, 7).alias("month")
    new = rows.select("*", month)
    if first and last:
        inside = F.col("month").between(first[:7], last[:7])
        kept = spark.read.parquet(path).where(inside & ~F.col("day").between(first, last)).withColumn("month", F.substring("day", 1, 7))
        new = new.where(inside & F.col("day").between(first, last)).unionByName(kept)
        staged = f"{path}-staged-{uuid.uuid4().hex}"  # a table can't be overwritten while it is read
        new.write.parquet(staged)
        new = spark.read.parquet(staged)
    write_partitions(new.hint("rebalance", "month"), path, "month")


def refresh_views(spark: SparkSession, views: dict[str, Callable[[], DataFrame]], path: str) -> dict[str, str]:
    """Recompute each view and overwrite it; ``refreshed``, or what went wrong with it, while the others go on."""
    out = {}
    for name, make in views.items():
        try:
            make().write.mode("overwrite").parquet(f"{path}/{name}")
            out[name] = "refreshed"
        except Exception as e:
            out[name] = f"failed: {type(e).__name__}"
    return out


def hospital_views(rows: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Hospitals with allocations by state, by area and by cohort."""
    view = lambda *keys: lambda: rows.dropna(subset=list(keys)).select(*keys, "hospital_id").distinct()
    return {"hospitals_by_state": view("state_id"), "hospitals_by_area": view("dispatch_area_id"), "hospitals_by_cohort": view("location_code", "tier_code")}


def brings_unseen(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Hospitals of an import that a table doesn't hold yet; views are refreshed only if there is one."""
    return rows.select("hospital_id").distinct().join(known.select("hospital_id").distinct(), "hospital_id", "left_anti")


def review(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """Each raw indication's use as first and second indication, and how its rows agree with its normalised one. raw: raw_id, normalized_id."""
    first = rows.groupBy(F.col("indication_raw_id").alias("raw_id")).agg(F.count(F.lit(1)).alias("n_first"), F.count_if(F.col("indication_id").isNull()).alias("n_missing"), F.collect_set("indication_id").alias("used"))
    second = rows.where("secondary_indication_raw_id IS NOT NULL").groupBy(F.col("secondary_indication_raw_id").alias("raw_id")).agg(F.count(F.lit(1)).alias("n_second"))
    both = raw.join(first, "raw_id", "left").join(second, "raw_id", "left").na.fill(0, ["n_first", "n_second", "n_missing"])
    odd = F.size(F.array_except(F.coalesce("used", F.array().cast("array<bigint>")), F.array("normalized_id"))) > 0
    status = F.when(F.col("n_first") + F.col("n_second") == 0, "unused").when(F.col("normalized_id").isNull(), "open").when(odd, "mismatch").when(F.col("n_missing") > 0, "incomplete").otherwise("done")
    return both.select("raw_id", "normalized_id", "n_first", "n_second", "n_missing", status.alias("status"))


def raw_indications(spark: SparkSession) -> DataFrame:
    """The bound table of raw indications: every seventh has no normalised one, a few have another than the allocations."""
    return spark.range(160).select(F.col("id").cast("int").alias("raw_id"), F.expr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 40 = 3 THEN id % 50 + 1 ELSE id % 50 END").alias("normalized_id"))


def import_log(spark: SparkSession, d: str) -> DataFrame:
    """The bound log of imports: one for each order, on its day."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    status = "CASE o_orderkey % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'running' ELSE 'completed' END"
    return o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.expr("o_custkey % 10").alias("hospital_id"), F.expr(status).alias("status"), F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END").alias("n_rows"), F.expr("o_orderkey % 7").alias("n_rejected"))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _deleted(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).where("created_year = 1996")
    paths = {"facts": _fresh(spark, "facts-by-import"), "notes": _fresh(spark, "notes-by-import")}
    write_partitions(rows, paths["facts"], "import_id")
    write_partitions(rows.select("fact_key", "notes", "import_id"), paths["notes"], "import_id")
    gone = clean_import(spark, paths, 199605)
    again = clean_import(spark, paths, 199605)
    left = [spark.read.parquet(p).groupBy("import_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(n)) for n, p in paths.items()]
    report = spark.createDataFrame([(-k, n, name) for k, found in ((1, gone), (2, again)) for name, n in found.items()], "import_id int, n long, name string")
    return left[0].unionByName(left[1]).unionByName(report)


def _filled(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "backfill")
    write_partitions(raw_allocations(spark, d).select("fact_key", "indication_raw_id", "indication_id", "import_id"), path, "import_id")
    counts = [backfill(spark, path, raw_indications(spark), dry) for dry in (True, False, False)]
    done = spark.read.parquet(path).groupBy("indication_id").agg(F.count(F.lit(1)).alias("n"))
    return done.unionByName(spark.createDataFrame([(-k - 1, c) for k, c in enumerate(counts)], "indication_id long, n long"))


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    """All days, then two weeks of one month again, without imports of hospital 3."""
    log, path = import_log(spark, d), _fresh(spark, "kpi-days")
    upsert_days(spark, kpi_days(log), path)
    upsert_days(spark, kpi_days(log.where("hospital_id <> 3")), path, "1997-03-01", "1997-03-14")
    return spark.read.parquet(path).drop("month")


def _refreshed(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _fresh(spark, "views"), facts(spark, d)
    told = refresh_views(spark, hospital_views(rows), path)
    out = [spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), F.lit(t).alias("told"), "n") for n, t in told.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_RAW = "raw AS (SELECT CAST(i AS INTEGER) AS raw_id, CASE WHEN i % 7 = 0 THEN NULL WHEN i % 40 = 3 THEN i % 50 + 1 ELSE i % 50 END AS normalized_id FROM (SELECT unnest(range(160)) AS i))"
_LOG = "log AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey % 10 AS hospital_id, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderkey % 9 = 1 THEN 'partial' WHEN o_orderkey % 9 = 2 THEN 'running' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END AS n_rows, o_orderkey % 7 AS n_rejected FROM orders)"
_KPI = "count(*) AS imports, count(*) FILTER (WHERE status IN ('completed', 'partial')) AS successful, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(coalesce(sum(n_rows), 0) AS BIGINT) AS n_rows, CAST(coalesce(sum(n_rejected), 0) AS BIGINT) AS n_rejected"
QUERIES: dict[str, Pair] = {
    "upkeep_delete_import": (_deleted, duck_with("y AS (SELECT import_id FROM fact WHERE created_year = 1996)", "t AS (SELECT unnest(['facts', 'notes']) AS name)") + "SELECT import_id, count(*) AS n, name FROM y, t WHERE import_id <> 199605 GROUP BY ALL UNION ALL SELECT -1, (SELECT count(*) FROM y WHERE import_id = 199605), name FROM t UNION ALL SELECT -2, 0, name FROM t"),
    "upkeep_backfill": (_filled, duck_with(_RAW, "a AS (SELECT coalesce(indication_id, normalized_id) AS indication_id, indication_id IS NULL AND normalized_id IS NOT NULL AS filled FROM alloc LEFT JOIN raw ON raw_id = indication_raw_id)") + "SELECT indication_id, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT -1, count(*) FROM a WHERE filled UNION ALL SELECT -2, count(*) FROM a WHERE filled UNION ALL SELECT -3, 0"),
    "upkeep_orphans": (lambda s, d: orphans(facts(s, d), raw_allocations(s, d).where("speciality_id <> 2")).groupBy("import_id").agg(F.count(F.lit(1)).alias("n")), duck_with() + "SELECT import_id, count(*) AS n FROM fact WHERE fact_key NOT IN (SELECT fact_key FROM alloc WHERE speciality_id <> 2) GROUP BY 1"),
    "upkeep_without_orphans": (lambda s, d: without_orphans(facts(s, d), raw_allocations(s, d).where("speciality_id <> 2")).groupBy("speciality_id").agg(F.count(F.lit(1)).alias("n")), duck_with() + "SELECT speciality_id, count(*) AS n FROM fact WHERE EXISTS (SELECT 1 FROM alloc a WHERE a.fact_key = fact.fact_key AND a.speciality_id <> 2) GROUP BY 1"),
    "upkeep_kpi_days": (_upserted, f"WITH {_LOG}, f AS (SELECT * FROM log WHERE status <> 'running' AND NOT (day BETWEEN '1997-03-01' AND '1997-03-14' AND hospital_id = 3)) SELECT day, hospital_id, {_KPI} FROM f GROUP BY 1, 2 UNION ALL SELECT day, NULL, {_KPI} FROM f GROUP BY 1"),
    "upkeep_views": (_refreshed, duck_with("n AS (SELECT count(DISTINCT (state_id, hospital_id)) AS a, count(DISTINCT (dispatch_area_id, hospital_id)) AS b, count(DISTINCT hospital_id) FILTER (WHERE location_code IS NOT NULL AND tier_code IS NOT NULL) AS c FROM fact)") + "SELECT unnest(['hospitals_by_state', 'hospitals_by_area', 'hospitals_by_cohort']) AS name, 'refreshed' AS told, unnest([a, b, c]) AS n FROM n"),
    "upkeep_unseen_hospitals": (lambda s, d: brings_unseen(facts(s, d).where("created_year = 1998"), facts(s, d).where("created_year < 1998 AND hospital_id % 4 <> 1")), duck_with() + "SELECT DISTINCT hospital_id FROM fact WHERE created_year = 1998 AND hospital_id NOT IN (SELECT hospital_id FROM fact WHERE created_year < 1998 AND hospital_id % 4 <> 1)"),
    "review_raw_indications": (lambda s, d: review(facts(s, d), raw_indications(s)), duck_with(_RAW, "a AS (SELECT indication_raw_id AS raw_id, count(*) AS n, count(*) FILTER (WHERE indication_id IS NULL) AS m FROM fact GROUP BY 1)", "b AS (SELECT secondary_indication_raw_id AS raw_id, count(*) AS n FROM fact WHERE secondary_indication_raw_id IS NOT NULL GROUP BY 1)") + "SELECT raw_id, normalized_id, coalesce(a.n, 0) AS n_first, coalesce(b.n, 0) AS n_second, coalesce(a.m, 0) AS n_missing, CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) = 0 THEN 'unused' WHEN normalized_id IS NULL THEN 'open' WHEN EXISTS (SELECT 1 FROM fact f WHERE f.indication_raw_id = raw.raw_id AND f.indication_id <> raw.normalized_id) THEN 'mismatch' WHEN coalesce(a.m, 0) > 0 THEN 'incomplete' ELSE 'done' END AS status FROM raw LEFT JOIN a USING (raw_id) LEFT JOIN b USING (raw_id)"),
    "review_summary": (lambda s, d: review(facts(s, d), raw_indications(s)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_first").alias("rows")), None),
    "hospitals_with_data": (lambda s, d: hospitals(s, d).join(facts(s, d).select("hospital_id").distinct(), "hospital_id", "left_semi").select("hospital_id"), duck_with() + "SELECT hospital_id FROM hospital WHERE hospital_id IN (SELECT hospital_id FROM fact)"),
}
_REVIEW = QUERIES["review_raw_indications"][1]
QUERIES["review_summary"] = (QUERIES["review_summary"][0], f"SELECT status, count(*) AS n, CAST(sum(n_first) AS BIGINT) AS rows FROM ({_REVIEW}) GROUP BY 1")
