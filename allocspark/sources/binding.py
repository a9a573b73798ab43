"""Binding of the star-schema tables to allocation facts and hospitals.

A line item is one allocation: its supplier is the hospital, its customer's nation the
dispatch area of origin, times and clinical attributes follow from its keys by fixed
arithmetic. Expressions are plain SQL, with the few that differ between engines given for
both, so that a DuckDB oracle can be built over the same definitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SPARK, DUCK = "spark", "duck"

#: Expressions over lineitem, orders, customer, nation and the hospital's columns.
RAW = {
    "import_id": "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT)",
    "case_id": "CASE WHEN l_partkey % 10 <> 0 THEN l_orderkey * 10 + l_linenumber END",
    "hospital_id": "l_suppkey",
    "dispatch_area_id": "c_nationkey",
    "state_id": "n_regionkey",
    "speciality_id": "l_partkey % 6",
    "department_id": "l_partkey % 25",
    "assignment_id": "l_orderkey % 4",
    "occasion_id": "CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey % 5 END",
    "infection_id": "CASE WHEN l_partkey % 11 < 3 THEN l_partkey % 11 END",
    "indication_id": "CASE WHEN l_partkey % 29 <> 0 THEN l_partkey % 50 END",
    "indication_raw_id": "CAST(l_partkey % 150 AS INT)",
    "secondary_indication_raw_id": "CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_partkey * 11 % 150 AS INT) END",
    "secondary_indication_id": "CASE WHEN l_orderkey % 4 = 0 THEN l_partkey * 7 % 50 END",
    "secondary_transport_id": "CASE WHEN l_orderkey % 6 = 0 THEN l_orderkey % 3 END",
    "age": "CASE WHEN l_partkey % 17 <> 0 THEN CAST(l_partkey % 103 AS INT) END",
    "gender_code": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN CASE WHEN l_partkey % 3 = 0 THEN 3 END END",
    "urgency_code": "CAST(1 + l_linenumber % 3 AS INT)",
    "transport_type_code": "CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 1 ELSE 2 END",
    "requires_resus": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_partkey % 7 = 0 END",
    "requires_cathlab": "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_orderkey % 9 = 0 END",
    "is_cpr": "l_partkey % 19 = 0",
    "is_ventilated": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_partkey % 8 = 0 END",
    "is_shock": "l_orderkey % 21 = 0",
    "is_pregnant": "l_partkey % 31 = 0",
    "is_work_accident": "l_orderkey % 17 = 0",
    "is_with_physician": "CASE WHEN l_orderkey % 15 = 0 THEN NULL ELSE l_quantity < 20 END",
    "department_was_closed": "l_orderkey % 14 = 0",
    "notes": "CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_orderkey % 5 < 3 THEN l_linestatus END",
    "assessment_id": "CASE WHEN l_partkey % 12 < 5 THEN l_partkey % 12 END",
    "fact_key": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))",
}
HOSPITAL = {
    "hospital_id": "s_suppkey",
    "hospital_name": "s_name",
    "area_id": "n_nationkey",
    "area_name": "n_name",
    "hospital_state_id": "r_regionkey",
    "state_name": "r_name",
    "tier_code": "CASE WHEN s_suppkey % 4 < 3 THEN CAST(1 + s_suppkey % 4 AS INT) END",
    "location_code": "CAST(1 + s_suppkey % 3 AS INT)",
    "size_code": "CAST(1 + s_suppkey * 7 % 3 AS INT)",
    "beds": "CAST(50 + s_suppkey * 7 % 900 AS INT)",
    "participating": "s_suppkey % 5 <> 0",
}
CREATED = {SPARK: "timestampadd(MINUTE, CAST(l_orderkey * 37 % 1440 AS INT), o_orderdate)", DUCK: "o_orderdate + to_minutes(l_orderkey * 37 % 1440)"}
ARRIVAL = {SPARK: "timestampadd(SECOND, CAST(l_partkey * 53 % 5400 - 120 AS INT), created_at)", DUCK: "created_at + to_seconds(l_partkey * 53 % 5400 - 120)"}
MINUTES = {SPARK: "timestampdiff(SECOND, created_at, arrival_at) / 60D", DUCK: "date_diff('second', created_at, arrival_at) / 60.0::DOUBLE"}
WEEKDAY = {SPARK: "weekday(created_at) + 1", DUCK: "isodow(created_at)"}


def steps(edges: list[tuple[int, str]], value: str, last: str) -> str:
    """A CASE over rising upper bounds (exclusive)."""
    return "CASE " + " ".join(f"WHEN {value} < {edge} THEN {name}" for edge, name in edges) + f" ELSE {last} END"


def calendar(dialect: str) -> dict[str, str]:
    """Calendar parts, rounded minutes and the two shifts of a day, from created_at and minutes."""
    return {
        "created_year": "CAST(year(created_at) AS INT)",
        "created_quarter": "CAST(quarter(created_at) AS INT)",
        "created_month": "CAST(month(created_at) AS INT)",
        "created_week": "CAST(weekofyear(created_at) AS INT)",
        "created_day": "CAST(day(created_at) AS INT)",
        "created_weekday": f"CAST({WEEKDAY[dialect]} AS INT)",
        "created_hour": "CAST(hour(created_at) AS INT)",
        "day_time_code": steps([(6, "1"), (12, "2"), (18, "3")], "hour(created_at)", "4"),
        "shift_code": steps([(6, "1"), (14, "2"), (22, "3")], "hour(created_at)", "1"),
        "rounded_minutes": "CAST(round(minutes) AS INT)",
    }


def hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a hospital, with its area and state (both of a few rows)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    joined = read("supplier").join(read("nation"), F.expr("s_nationkey = n_nationkey")).join(read("region"), F.expr("n_regionkey = r_regionkey"))
    return joined.select(*[F.expr(e).alias(n) for n, e in HOSPITAL.items()])


#: Columns of the tables from which all attributes of an allocation follow.
NARROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "o_orderdate", "c_nationkey", "n_regionkey")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's day and customer's nation."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    origin = read("customer").join(read("nation"), F.expr("c_nationkey = n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    orders = read("orders").join(origin, F.expr("o_custkey = c_custkey"))
    return read("lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).select(*NARROW)


def timed(rows: DataFrame) -> DataFrame:
    """With created_at and arrival_at."""
    return rows.withColumn("created_at", F.expr(CREATED[SPARK])).withColumn("arrival_at", F.expr(ARRIVAL[SPARK]))


def raw_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocations before projection: attributes, created_at and arrival_at."""
    return timed(joined(spark, sf_dir)).select(*[F.expr(e).alias(n) for n, e in RAW.items()], "created_at", "arrival_at")


_by_import: dict[tuple[str, str], str] = {}


def allocations_by_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same allocations, read from where this application has written the few columns from which they follow, in parts by import. Conditions on the import prune files, and line items and orders are joined once."""
    key, rows = (spark.sparkContext.applicationId, sf_dir), joined(spark, sf_dir).withColumn("import_id", F.expr(RAW["import_id"]))
    if key not in _by_import:
        path = f"{shared_dir(spark)}/imports-{uuid.uuid4().hex}"
        rows.hint("rebalance", "import_id").write.partitionBy("import_id").parquet(path)
        _by_import[key] = path
    written = spark.read.schema(rows.schema).parquet(_by_import[key])  # an empty table has no file to tell the schema
    return timed(written).select("import_id", *[F.expr(e).alias(n) for n, e in RAW.items() if n != "import_id"], "created_at", "arrival_at")


#: Columns by which the written fact is partitioned; conditions on them prune files.
PARTITIONS = ("created_year", "created_month")
_written: dict[tuple[str, str], str] = {}


def built_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denormalised fact, computed: one row an allocation, its hospital's codes, calendar parts and minutes."""
    codes = hospitals(spark, sf_dir).select("hospital_id", "tier_code", "location_code")
    return projected(raw_allocations(spark, sf_dir), codes)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denormalised fact, read from where this application has written it; the first reader writes it.

    All queries read this one table: lineitem and orders are joined once, and periods and
    years prune partitions. ``refreshed`` writes it anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    return spark.read.parquet(_written[key]) if key in _written else refreshed(spark, sf_dir)


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the fact of a folder of tables anew, with files of even size in each partition."""
    path = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"
    laid_out(spark, sf_dir).write.partitionBy(*PARTITIONS).parquet(path)
    _written[spark.sparkContext.applicationId, sf_dir] = path
    return spark.read.parquet(path)


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact of ``built_facts`` in the order in which it is written. Only the few columns from which the others follow are moved and sorted; the wide rows are made where they are written."""
    codes = hospitals(spark, sf_dir).select(F.col("hospital_id").alias("l_suppkey"), "tier_code", "location_code")
    parts, made = calendar(SPARK), F.expr(CREATED[SPARK]).alias("created_at")
    narrow = joined(spark, sf_dir).join(codes, "l_suppkey").select("*", made).select(*NARROW, "tier_code", "location_code", *[F.expr(parts[n]).alias(n) for n in PARTITIONS])
    laid = timed(narrow.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS))
    wide = laid.select(*[F.expr(e).alias(n) for n, e in RAW.items()], "created_at", "arrival_at", "tier_code", "location_code", F.expr(MINUTES[SPARK]).alias("minutes"), *PARTITIONS)
    return wide.select("*", *[F.expr(e).alias(n) for n, e in parts.items() if n not in PARTITIONS])


def projected(allocations: DataFrame, codes: DataFrame) -> DataFrame:
    """Build facts from allocations and the hospitals' codes (tier_code, location_code by hospital_id)."""
    rows = allocations.join(codes, "hospital_id").withColumn("minutes", F.expr(MINUTES[SPARK]))
    return rows.select("*", *[F.expr(e).alias(n) for n, e in calendar(SPARK).items()])


def duck_with(*more: str) -> str:
    """WITH clause that defines hospital and fact for DuckDB; ``more``: further named queries."""
    pick = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())
    parts = [
        f"hospital AS (SELECT {pick(HOSPITAL)} FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
        f"src AS (SELECT *, {CREATED[DUCK]} AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
        f"src2 AS (SELECT *, {ARRIVAL[DUCK]} AS arrival_at FROM src)",
        f"alloc AS (SELECT {pick(RAW)}, created_at, arrival_at FROM src2)",
        f"fact1 AS (SELECT alloc.*, tier_code, location_code, {MINUTES[DUCK]} AS minutes FROM alloc JOIN hospital USING (hospital_id))",
        f"fact AS (SELECT *, {pick(calendar(DUCK))} FROM fact1)",
    ]
    return "WITH " + ",\n".join([*parts, *more]) + "\n"
