"""Review of raw indications: use as first and second indication by the raw id, segments by review status, newest samples; and imports whose removal would take hospitals away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.binding import duck_with, facts, hospitals
from .aggregates import Pair

#: States of review, those that are open, days for which an open one is new, samples shown, open ones shown by use.
STATES, OPEN, NEW_DAYS, SAMPLES, TOP = ("unreviewed", "needs_review", "matched", "not_matchable", "ignored"), ("unreviewed", "needs_review"), 30, 5, 10


def uses(rows: DataFrame) -> DataFrame:
    """A row for each use of a raw indication by an allocation: raw_id, first and second (0 or 1). Both uses of one allocation are one row."""
    ids = F.array_distinct(F.filter(F.array("indication_raw_id", "secondary_indication_raw_id"), lambda x: x.isNotNull()))
    used = rows.withColumn("raw_id", F.explode(ids))
    one = lambda c: F.coalesce((F.col(c) == F.col("raw_id")).cast("int"), F.lit(0))
    return used.withColumns({"first": one("indication_raw_id"), "second": one("secondary_indication_raw_id")})


def occurrences(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """raw_id, n (uses of either kind), n_first and n_second of all raw indications."""
    n = uses(rows).groupBy("raw_id").agg(F.sum("first").alias("n_first"), F.sum("second").alias("n_second"))
    both = raw.select("raw_id").join(n, "raw_id", "left").na.fill(0, ["n_first", "n_second"])
    return both.select("raw_id", (F.col("n_first") + F.col("n_second")).alias("n"), "n_first", "n_second")


def segments(raw: DataFrame, now: str) -> DataFrame:
    """Number of raw indications of each segment of the review list, from one pass. raw: raw_id, review_status, created_at."""
    status = F.col("review_status")
    is_open = status.isin(*OPEN)
    conditions = {"open": is_open, "new": is_open & (F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {NEW_DAYS} DAYS")), **{s: status == s for s in STATES}}
    counts = raw.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), F.col(k).alias("n")) for k in conditions])).alias("s")).select("s.*")


def top_open(rows: DataFrame, raw: DataFrame, shown: int = TOP) -> DataFrame:
    """Open raw indications that are used most."""
    waiting = raw.where(F.col("review_status").isin(*OPEN))
    return occurrences(rows, waiting).orderBy(F.desc("n"), "raw_id").limit(shown)


def samples(rows: DataFrame, homes: DataFrame, shown: int = SAMPLES) -> DataFrame:
    """The newest allocations that use each raw indication, with the hospital's name (null where it is gone)."""
    newest = Window.partitionBy("raw_id").orderBy(F.desc("created_at"), "fact_key")
    used = uses(rows).select("raw_id", "fact_key", "created_at", "hospital_id").withColumn("position", F.row_number().over(newest)).where(F.col("position") <= shown)
    return used.join(homes.select("hospital_id", "hospital_name"), "hospital_id", "left").select("raw_id", "position", "fact_key", "created_at", "hospital_name")


def hospitals_of_one_import(projection: DataFrame) -> DataFrame:
    """Hospitals all of whose rows are of one import, with it."""
    per = projection.groupBy("hospital_id").agg(F.min("import_id").alias("import_id"), F.max("import_id").alias("last"))
    return per.where("import_id = last").select("hospital_id", "import_id")


def removals(projection: DataFrame) -> DataFrame:
    """For each import whether its removal takes hospitals out of the projection, and how many."""
    alone = hospitals_of_one_import(projection).groupBy("import_id").agg(F.count(F.lit(1)).alias("n"))
    every = projection.select("import_id").distinct().join(alone, "import_id", "left").na.fill(0, ["n"])
    return every.select("import_id", (F.col("n") > 0).alias("removes"), F.col("n").alias("n_hospitals"))


def introduces(rows: DataFrame, projection: DataFrame) -> bool:
    """Whether an import's rows bring a hospital that the projection doesn't have."""
    return bool(rows.select("hospital_id").join(projection.select("hospital_id"), "hospital_id", "left_anti").head(1))


NOW = "1997-06-30 00:00:00"


def raw_indications(spark: SparkSession, d: str) -> DataFrame:
    """The bound table of raw indications: one for each part's number modulo 160, with its state and time of creation."""
    part = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 160).cast("int").alias("raw_id")).distinct()
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("raw_id") % 5 + 1).cast("int"))
    return part.select("raw_id", state.alias("review_status"), F.expr("TIMESTAMP_NTZ '1997-05-01 00:00:00' + make_dt_interval(raw_id % 90)").alias("created_at"))


#: The projection of W6: every seventh hospital has sent one import only.
ONE_IMPORT = "hospital_id % 7 <> 3 OR import_id = 199501 + hospital_id % 12"
_RAW = "raw AS (SELECT DISTINCT CAST(p_partkey % 160 AS INTEGER) AS raw_id FROM part), st AS (SELECT raw_id, ['unreviewed', 'needs_review', 'matched', 'not_matchable', 'ignored'][1 + raw_id % 5] AS status, TIMESTAMP '1997-05-01' + to_days(raw_id % 90) AS made FROM raw)"
_USE = "a AS (SELECT indication_raw_id AS raw_id, count(*) AS n FROM alloc GROUP BY 1), b AS (SELECT secondary_indication_raw_id AS raw_id, count(*) AS n FROM alloc GROUP BY 1), o AS (SELECT st.*, coalesce(a.n, 0) AS n_first, coalesce(b.n, 0) AS n_second FROM st LEFT JOIN a ON a.raw_id = st.raw_id LEFT JOIN b ON b.raw_id = st.raw_id)"
_PROJECTION = f"p AS (SELECT hospital_id, import_id FROM fact WHERE {ONE_IMPORT})"
QUERIES: dict[str, Pair] = {
    "review_occurrences": (lambda s, d: occurrences(facts(s, d), raw_indications(s, d)), duck_with(_RAW, _USE) + "SELECT raw_id, n_first + n_second AS n, n_first, n_second FROM o"),
    "review_segments": (
        lambda s, d: segments(raw_indications(s, d), NOW),
        f"WITH {_RAW} SELECT 'open' AS segment, count(*) AS n FROM st WHERE raw_id % 5 < 2 UNION ALL SELECT 'new', count(*) FROM st WHERE raw_id % 5 < 2 AND made >= TIMESTAMP '1997-05-31' UNION ALL SELECT status, count(*) FROM st GROUP BY 1",
    ),
    "review_top_open": (lambda s, d: top_open(facts(s, d), raw_indications(s, d)), duck_with(_RAW, _USE) + "SELECT raw_id, n_first + n_second AS n, n_first, n_second FROM o WHERE status IN ('unreviewed', 'needs_review') ORDER BY n DESC, raw_id LIMIT 10"),
    "review_samples": (
        lambda s, d: samples(facts(s, d), hospitals(s, d)),
        duck_with("u AS (SELECT indication_raw_id AS raw_id, fact_key, created_at, hospital_id FROM alloc UNION SELECT secondary_indication_raw_id, fact_key, created_at, hospital_id FROM alloc WHERE secondary_indication_raw_id IS NOT NULL)", "w AS (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY created_at DESC, fact_key) AS k FROM u)")
        + "SELECT raw_id, CAST(k AS INTEGER) AS position, fact_key, created_at, hospital_name FROM w LEFT JOIN hospital USING (hospital_id) WHERE k <= 5",
    ),
    "single_import_hospitals": (
        lambda s, d: hospitals_of_one_import(facts(s, d).where(ONE_IMPORT)),
        duck_with(_PROJECTION) + "SELECT DISTINCT hospital_id, import_id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.hospital_id = p.hospital_id AND q.import_id <> p.import_id)",
    ),
    "import_removals": (
        lambda s, d: removals(facts(s, d).where(ONE_IMPORT)),
        duck_with(_PROJECTION, "l AS (SELECT hospital_id, any_value(import_id) AS import_id FROM p GROUP BY 1 HAVING count(DISTINCT import_id) = 1)") + "SELECT i.import_id, count(l.hospital_id) > 0 AS removes, count(l.hospital_id) AS n_hospitals FROM (SELECT DISTINCT import_id FROM p) i LEFT JOIN l ON l.import_id = i.import_id GROUP BY 1",
    ),
}
