"""Several distributions of one slice in one pass: grouping sets instead of a union of scans, and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..plans.analysis import analyse, by_grain, pivoted, table_percents, top_with_rest, totals
from ..plans.spec import Analysis
from ..sources.binding import duck_with, facts, hospitals
from .aggregates import COMPARISON, INDICATION, PRIMARY, SIDE_A, SIDE_B, Pair, count

Kind = tuple[str, str, str | None]


def grouping_slice(rows: DataFrame, kinds: list[Kind], values: dict[str, str], skip_null: tuple[str, ...] = (), fine: bool = False) -> DataFrame:
    """slice_kind, dim1, dim2 and values (counts) for each kind (name, key, second key), from one aggregation over grouping sets.

    Grouping sets copy each row once for each set. ``fine``: rows are counted by all keys together
    first, so only those counts are copied; of use where the keys have few combinations.
    """
    keys = list(dict.fromkeys(k for _, a, b in kinds for k in (a, b) if k))
    names = {k: f"k{i}" for i, k in enumerate(keys)}
    wide = rows.withColumns({n: F.expr(S.text(k)) for k, n in names.items()})
    sets = [[names[k] for k in (a, b) if k] for _, a, b in kinds]
    order = list(names.values())
    if fine:
        wide = wide.groupBy(*order).agg(*[F.expr(v).alias(n) for n, v in values.items()])
        values = {n: f"sum({n})" for n in values}
    grouped = wide.groupingSets(sets, *order).agg(F.grouping_id().alias("g"), *[F.expr(v).alias(n) for n, v in values.items()])
    out = None
    for (name, a, b), s in zip(kinds, sets, strict=True):
        level = sum(1 << (len(order) - 1 - order.index(k)) for k in order if k not in s)  # a set bit is a key left out
        hit = F.col("g") == level
        cell = F.struct(F.lit(name).alias("slice_kind"), F.col(names[a]).alias("dim1"), (F.col(names[b]) if b else F.lit(None).cast("string")).alias("dim2"))
        out = F.when(hit, cell) if out is None else out.when(hit, cell)
    result = grouped.select(out.alias("c"), *values).select("c.*", *values)
    for name in skip_null:
        result = result.where(~((F.col("slice_kind") == name) & F.col("dim1").isNull()))
    return result


def _duck_slice(kinds: list[Kind], values: dict[str, str], where: str = "", skip_null: tuple[str, ...] = ()) -> str:
    shown = ", ".join(f"{v} AS {n}" for n, v in values.items())
    parts = [f"SELECT '{n}' AS slice_kind, {S.text(a)} AS dim1, {S.text(b) if b else 'CAST(NULL AS STRING)'} AS dim2, {shown} FROM s{f' WHERE {a} IS NOT NULL' if n in skip_null else ''} GROUP BY 1, 2, 3" for n, a, b in kinds]
    return duck_with(f"s AS (SELECT *, {S.minute_buckets()} AS minutes_bucket, {S.ages(17)} AS age_bucket FROM fact{f' WHERE {where}' if where else ''})") + " UNION ALL ".join(parts)


def sliced(kinds: list[Kind], values: dict[str, str], where: str = "", skip_null: tuple[str, ...] = (), fine: bool = False) -> Pair:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = facts(spark, sf_dir)
        rows = rows.where(where) if where else rows
        rows = rows.withColumns({"minutes_bucket": F.expr(S.minute_buckets()), "age_bucket": F.expr(S.ages(17))})
        return grouping_slice(rows, kinds, values, skip_null, fine)

    return run, _duck_slice(kinds, values, where, skip_null)


SERIES: Kind = ("time_series", "created_year", "created_month")
MINUTES: Kind = ("transport_time", "minutes_bucket", None)
TYPE: Kind = ("transport_type", "transport_type_code", None)
HEAT: list[Kind] = [("day_time_heatmap", "created_weekday", "day_time_code"), ("shift_heatmap", "created_weekday", "shift_code")]
PEOPLE: list[Kind] = [("gender", "gender_code", None), ("urgency", "urgency_code", None), ("age", "age_bucket", None)]
#: Names of the top lists and the ids that they count.
ENTITIES = {"department": "department_id", "speciality": "speciality_id", "occasion": "occasion_id", "infection": "infection_id", "assignment": "assignment_id", "indication": "indication_id"}


def top_entities(rows: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each entity (ties by name; null is unknown), from one pass."""
    pairs = ", ".join(f"'{n}', CAST({c} AS STRING)" for n, c in ENTITIES.items())
    long = rows.select(F.expr(f"stack({len(ENTITIES)}, {pairs}) AS (entity, name)")).withColumn("name", F.coalesce("name", F.lit("Unknown")))
    counted = long.groupBy("entity", "name").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "name"))
    return counted.withColumn("position", rank).where(F.col("position") <= k)


def _top_duck(k: int, where: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT '{n}' AS entity, coalesce(CAST({c} AS STRING), 'Unknown') AS name, count(*) AS n FROM fact{f' WHERE {where}' if where else ''} GROUP BY ALL" for n, c in ENTITIES.items())
    return duck_with(f"t AS ({parts})", "r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, name) AS position FROM t)") + f"SELECT entity, name, n, CAST(position AS INTEGER) AS position FROM r WHERE position <= {k}"


def profile_top(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The k most frequent departments, specialities and indications of each transport-time bucket."""
    rows = facts(spark, sf_dir).withColumn("bucket", F.expr(S.minute_buckets())).where(f"bucket <> '{S.UNKNOWN}'")
    pairs = ", ".join(f"'{n}', CAST({n}_id AS INT)" for n in ("department", "speciality", "indication"))
    long = rows.select("bucket", F.expr(f"stack(3, {pairs}) AS (kind, id)")).where("id IS NOT NULL")
    counted = long.groupBy("kind", "bucket", "id").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("position", F.row_number().over(Window.partitionBy("kind", "bucket").orderBy(F.desc("n"), "id"))).where(F.col("position") <= k)


PROFILE_TOP = duck_with(
    f"b AS (SELECT *, {S.minute_buckets()} AS bucket FROM fact)",
    "t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS kind, bucket, CAST({n}_id AS INTEGER) AS id, count(*) AS n FROM b WHERE bucket <> 'unknown' AND {n}_id IS NOT NULL GROUP BY ALL" for n in ("department", "speciality", "indication")) + ")",
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind, bucket ORDER BY n DESC, id) AS INTEGER) AS position FROM t)",
) + "SELECT * FROM r WHERE position <= 5"


def rank_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A department's rise from one transport-time bucket to the next; entered: it was not among the first five before."""
    top = profile_top(spark, sf_dir).where("kind = 'department'")
    at = F.expr("CASE bucket WHEN 'under_10' THEN 0 WHEN 'over_60' THEN 6 ELSE try_cast(substring(bucket, 1, 1) AS INT) END")
    top = top.withColumn("at", at)
    filled = top.select("at").distinct().withColumn("before", F.lag("at").over(Window.partitionBy(F.lit(1)).orderBy("at")))
    previous = top.select(F.col("at").alias("before"), "id", F.col("position").alias("was"))
    return top.join(filled, "at").join(previous, ["before", "id"], "left").where("before IS NOT NULL").select("bucket", "id", "position", (F.col("was") - F.col("position")).alias("rise"), F.col("was").isNull().alias("entered"))


RANK_SHIFT = PROFILE_TOP.replace("SELECT * FROM r WHERE position <= 5", "").rstrip().rstrip(",") + """,
d AS (SELECT *, CASE bucket WHEN 'under_10' THEN 0 WHEN 'over_60' THEN 6 ELSE try_cast(substring(bucket, 1, 1) AS INTEGER) END AS pos FROM r WHERE kind = 'department' AND position <= 5),
o AS (SELECT pos, lag(pos) OVER (ORDER BY pos) AS before FROM (SELECT DISTINCT pos FROM d))
SELECT d.bucket, d.id, d.position, p.position - d.position AS rise, p.position IS NULL AS entered
FROM d JOIN o USING (pos) LEFT JOIN d p ON p.pos = o.before AND p.id = d.id WHERE o.before IS NOT NULL"""


def hospital_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hospitals with the number of their allocations."""
    counts = facts(spark, sf_dir).groupBy("hospital_id").agg(F.count(F.lit(1)).alias("n"))
    return hospitals(spark, sf_dir).join(counts, "hospital_id", "left").select("hospital_id", "hospital_name", "state_name", "area_name", "beds", "participating", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyset pagination: 25 rows after a (sort value, key) cursor, in order of arrival and key."""
    rows = facts(spark, sf_dir).select("arrival_at", "fact_key", "hospital_id", "urgency_code")
    after = "arrival_at > CAST('1997-03-01 12:00:00' AS TIMESTAMP_NTZ) OR (arrival_at = CAST('1997-03-01 12:00:00' AS TIMESTAMP_NTZ) AND fact_key > '500')"
    return rows.where(after).orderBy("arrival_at", "fact_key").limit(25).select("fact_key", "hospital_id", "urgency_code")


def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset pagination over hospitals: the third page of ten."""
    return hospitals(spark, sf_dir).select("hospital_id", "hospital_name").orderBy("hospital_name", "hospital_id").offset(20).limit(10)


def _counts(spark: SparkSession, d: str, bucket: str, series: str) -> DataFrame:
    """Counts by two dimensions, as the explorer shows them."""
    return analyse(Analysis(bucket, series), facts(spark, d), hospitals(spark, d))


def catalog_share(spark: SparkSession, d: str) -> DataFrame:
    """Each department's share of all allocations; a count from 1 to 4 isn't shown, nor its share."""
    n = facts(spark, d).groupBy("department_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row a department
    shown = (F.col("n") == 0) | (F.col("n") >= 5)
    return n.withColumn("t", total).select("department_id", F.when(shown, F.col("n")).alias("n"), F.when(shown, F.round(100 * F.col("n").cast("double") / F.col("t"), 2)).alias("share"))


_CELLS = duck_with("c AS (SELECT CAST(created_weekday AS VARCHAR) AS bucket, CAST(gender_code AS VARCHAR) AS series, count(*) AS count FROM fact WHERE gender_code IS NOT NULL GROUP BY 1, 2)")
COUNT = {"n": "count(*)"}
SIDES = {"n1": count(PRIMARY), "n2": count(COMPARISON)}
QUERIES: dict[str, Pair] = {
    "overview_slice": sliced([SERIES, MINUTES, TYPE, *HEAT], COUNT, skip_null=("transport_type",), fine=True),
    "indication_slice": sliced([SERIES, MINUTES, *PEOPLE, *HEAT, ("gender_age", "gender_code", "age_bucket"), ("gender_urgency", "gender_code", "urgency_code")], COUNT, INDICATION),
    "indication_compare_slice": sliced([SERIES, MINUTES, *PEOPLE, *HEAT], {"n1": count(SIDE_A), "n2": count(SIDE_B)}, f"{SIDE_A} OR {SIDE_B}"),
    "benchmark_slice": sliced([MINUTES, TYPE, *PEOPLE, *HEAT, ("indication", "indication_id", None), ("speciality", "speciality_id", None), ("month", "created_month", None)], SIDES, f"({PRIMARY}) OR ({COMPARISON})"),
    "profile_slice": sliced([MINUTES, *[(f"{n}_by_minutes", "minutes_bucket", c) for n, c in (("gender", "gender_code"), ("urgency", "urgency_code"), ("type", "transport_type_code"))]], COUNT | {"physician": count("is_with_physician"), "resus": count("requires_resus"), "cathlab": count("requires_cathlab")}, fine=True),
    "profile_top": (profile_top, PROFILE_TOP),
    "explorer_pivot": (lambda spark, d: pivoted(_counts(spark, d, "weekday", "gender"), columns=["1", "2", "3"]), _CELLS + "SELECT bucket, " + ", ".join(f"coalesce(CAST(sum(count) FILTER (WHERE series = '{k}') AS BIGINT), 0) AS \"{k}\"" for k in (1, 2, 3)) + " FROM c GROUP BY 1"),
    "explorer_totals": (lambda spark, d: totals(_counts(spark, d, "weekday", "gender")).drop("level"), _CELLS + "SELECT bucket, series, CAST(sum(count) AS BIGINT) AS count FROM c GROUP BY CUBE (bucket, series)"),
    "explorer_top_with_rest": (lambda spark, d: top_with_rest(_counts(spark, d, "weekday", "gender"), 5), _CELLS + "SELECT CASE WHEN r <= 5 THEN bucket ELSE 'other' END AS bucket, CAST(sum(t) AS BIGINT) AS count FROM (SELECT bucket, sum(count) AS t, row_number() OVER (ORDER BY sum(count) DESC, bucket) AS r FROM c GROUP BY 1) GROUP BY 1"),
    "explorer_percents": (lambda spark, d: table_percents(_counts(spark, d, "weekday", "gender")), _CELLS + "SELECT *, round(100 * count::DOUBLE / sum(count) OVER (), 2) AS of_total, round(100 * count::DOUBLE / sum(count) OVER (PARTITION BY bucket), 2) AS of_row FROM c"),
    "explorer_by_week": (lambda spark, d: by_grain(Analysis("gender"), "week", facts(spark, d), hospitals(spark, d)), duck_with() + "SELECT CAST(created_week AS VARCHAR) AS bucket, count(*) AS count FROM fact GROUP BY 1"),
    "explorer_total": (lambda spark, d: by_grain(Analysis("gender", metrics=("count", "mean_transport_time")), "total", facts(spark, d), hospitals(spark, d)), duck_with() + "SELECT count(*) AS count, round(avg(minutes), 6) AS mean_transport_time FROM fact"),
    "catalog_share": (catalog_share, duck_with("n AS (SELECT department_id, count(*) AS n FROM fact GROUP BY 1)") + "SELECT department_id, CASE WHEN n >= 5 THEN n END AS n, CASE WHEN n >= 5 THEN round(100 * n::DOUBLE / (SELECT sum(n) FROM n), 2) END AS share FROM n"),
    "profile_rank_shift": (rank_shift, RANK_SHIFT),
    "top_entities": (lambda spark, d: top_entities(facts(spark, d), 10), _top_duck(10)),
    "top_diagnoses": (lambda spark, d: top_entities(facts(spark, d).where("created_year = 1997"), 25).where("entity = 'indication'"), f"SELECT * FROM ({_top_duck(25, 'created_year = 1997')}) WHERE entity = 'indication'"),
    "hospital_population": (hospital_population, duck_with() + "SELECT h.hospital_id, hospital_name, state_name, area_name, beds, participating, count(f.hospital_id) AS n FROM hospital h LEFT JOIN fact f USING (hospital_id) GROUP BY ALL"),
    "list_keyset_page": (page, duck_with() + "SELECT fact_key, hospital_id, urgency_code FROM fact WHERE arrival_at > TIMESTAMP '1997-03-01 12:00:00' OR (arrival_at = TIMESTAMP '1997-03-01 12:00:00' AND fact_key > '500') ORDER BY arrival_at, fact_key LIMIT 25"),
    "list_offset_page": (offset_page, duck_with() + "SELECT hospital_id, hospital_name FROM hospital ORDER BY hospital_name, hospital_id LIMIT 10 OFFSET 20"),
}
