"""Lists and exports of allocations: joins for names, filters, search, pages, and cells for CSV files."""

from __future__ import annotations

import base64
import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..plans.analysis import restricted
from ..plans.filters import DrawerFilter, ListFilter, hospitals_in_scope, resolved_scope, searched
from ..plans.spec import Scope
from ..sources.binding import duck_with, facts, hospitals
from ..sources.csv_import import escaped
from .aggregates import Pair

#: Names of ids: table, its key and its name. Ids without an entry have none.
NAMES = {
    "department": ("nation", "n_nationkey", "n_name"), "dispatch_area": ("nation", "n_nationkey", "n_name"), "state": ("region", "r_regionkey", "r_name"), "speciality": ("region", "r_regionkey", "r_name"),
    "assignment": ("region", "r_regionkey", "r_name"), "occasion": ("region", "r_regionkey", "r_name"), "infection": ("region", "r_regionkey", "r_name"), "indication": ("part", "p_partkey", "p_name"), "secondary_indication": ("part", "p_partkey", "p_name"), "secondary_transport": ("region", "r_regionkey", "r_name"),
}
LISTED = ("dispatch_area", "state", "department", "speciality", "assignment", "occasion", "infection", "indication")
EXPORTED = (*LISTED, "secondary_indication", "secondary_transport")


def named(rows: DataFrame, spark: SparkSession, d: str, kinds: tuple[str, ...]) -> DataFrame:
    """Left joins for the names of ids. The tables of names are small; whether they are small enough to go to every task is the optimizer's measure."""
    for kind in kinds:
        table, key, name = NAMES[kind]
        known = spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).cast("long").alias(f"_{kind}"), F.col(name).alias(f"{kind}_name"))
        rows = rows.join(known, F.col(f"{kind}_id").cast("long") == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    return rows


def listed(spark: SparkSession, d: str, filter_: ListFilter, kinds: tuple[str, ...] = LISTED) -> DataFrame:
    """Allocations with their hospital and the names of their ids, filtered before names are joined."""
    h = hospitals(spark, d).select("hospital_id", "hospital_name", "size_code")
    return named(restricted(facts(spark, d).join(h, "hospital_id"), filter_.sql()), spark, d, kinds)


def cursor(value: dt.datetime, key: str) -> str:
    """An opaque text for a place in (arrival, key) order."""
    return base64.urlsafe_b64encode(json.dumps([value.isoformat(), key]).encode()).decode().rstrip("=")


def uncursor(text: str) -> tuple[dt.datetime, str]:
    at, key = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    return dt.datetime.fromisoformat(at), key


def keyset_page(rows: DataFrame, after: str | None, size: int = 25) -> tuple[list, str | None]:
    """A page of rows behind a cursor, and the cursor of the next page: one row more is read to know whether there is one."""
    if after:
        at, key = uncursor(after)
        rows = rows.where((F.col("arrival_at") > F.lit(at).cast("timestamp_ntz")) | ((F.col("arrival_at") == F.lit(at).cast("timestamp_ntz")) & (F.col("fact_key") > key)))
    got = rows.orderBy("arrival_at", "fact_key").limit(size + 1).collect()
    return got[:size], cursor(got[size - 1]["arrival_at"], got[size - 1]["fact_key"]) if len(got) > size else None


def export(spark: SparkSession, d: str, filter_: ListFilter) -> DataFrame:
    """The rows of an export, in order of arrival and key."""
    names = [f"{k}_name" for k in EXPORTED]
    return listed(spark, d, filter_, EXPORTED).select("fact_key", "arrival_at", "hospital_name", *names, "age", "urgency_code").orderBy("arrival_at", "fact_key")


def decimal(value: Column) -> Column:
    """Ten decimals without the zeros at their end."""
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.10f", value.cast("double")), r"0+$", ""), r"\.$", ""))


def csv_cells(rows: DataFrame, quote: str = '"', sep: str = ",") -> DataFrame:
    """One line of CSV text for each row: fractions plain, null empty, no cell that a spreadsheet takes for a formula, quotes where they are needed."""
    def cell(name: str, kind: str) -> Column:
        text = decimal(F.col(name)) if kind in ("double", "float") or kind.startswith("decimal") else F.col(name).cast("string")
        text = F.coalesce(escaped(text) if kind == "string" else text, F.lit(""))
        return F.when(text.rlike(f"[{sep}{quote}\\r\\n\\t ]"), F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(text)

    return rows.select(F.concat_ws(sep, *[cell(n, k) for n, k in rows.dtypes]).alias("line"))


def write_csv(rows: DataFrame, path: str, header: bool = True) -> None:
    """A folder of CSV files with a byte order mark in front of each header."""
    names = ["﻿" + rows.columns[0], *rows.columns[1:]] if header else rows.columns
    plain = rows.select(*[escaped(F.col(n)).alias(m) if k == "string" else decimal(F.col(n)).alias(m) if k in ("double", "float") else F.col(n).alias(m) for (n, k), m in zip(rows.dtypes, names, strict=True)])
    plain.write.csv(path, header=header, escape='"')


def explorer_export(rows: DataFrame) -> DataFrame:
    """A result as lines of CSV: its rows with percents of all and of their bucket, in order, and a line of totals at the end."""
    total, per = F.sum("count").over(_all()), F.sum("count").over(_all("bucket"))
    share = lambda t: F.when(t > 0, F.round(100 * F.col("count").cast("double") / t, 2))
    body = rows.withColumns({"of_total": share(total), "of_row": share(per)}).withColumn("at", F.lit(0))
    foot = rows.agg(F.sum("count").alias("count")).select(F.lit("Total").alias("bucket"), F.lit(None).cast("string").alias("series"), "count", F.lit(100.0).alias("of_total"), F.lit(None).cast("double").alias("of_row"), F.lit(1).alias("at"))
    both = body.select("bucket", "series", "count", "of_total", "of_row", "at").unionByName(foot)
    lines = csv_cells(both.drop("at")).columns
    keyed = both.select("at", "bucket", "series", F.struct("bucket", "series", "count", "of_total", "of_row").alias("r"))
    return csv_cells(keyed.orderBy("at", "bucket", "series").select("r.*")).select(*lines)


def _all(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*(keys or (F.lit(1),)))


def groups_of_indications(spark: SparkSession, d: str) -> DataFrame:
    """Which indication belongs to which group; one may belong to several (two bound ones for each of half of all ids)."""
    ids = spark.range(50).select(F.col("id").alias("indication_id"))
    return ids.where("indication_id % 2 = 0").select("indication_id", F.explode(F.array(F.col("indication_id") % 5, F.col("indication_id") % 7 + 10)).alias("group_id"))


def top_groups(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Groups of indications by their allocations, which count in each of their groups."""
    n = facts(spark, d).groupBy("indication_id").agg(F.count(F.lit(1)).alias("n"))  # counted before the join multiplies rows
    return n.join(groups_of_indications(spark, d), "indication_id").groupBy("group_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "group_id").limit(k)


def group_filter(spark: SparkSession, d: str, group: int) -> DataFrame:
    """Allocations of a group's indications by urgency; a group without any has none."""
    members = groups_of_indications(spark, d).where(F.col("group_id") == group).select("indication_id").distinct()
    return facts(spark, d).join(members, "indication_id", "left_semi").groupBy("urgency_code").agg(F.count(F.lit(1)).alias("n"))


DRAWER = DrawerFilter(gender=1, urgency=2, age_group="40_49", requires_resus=False, is_cpr=False, is_infectious=False, is_work_accident=False)
DRAWER_SQL = "gender_code = 1 AND urgency_code = 2 AND age BETWEEN 40 AND 49 AND NOT requires_resus AND NOT is_cpr AND infection_id IS NULL AND NOT is_work_accident"
LIST = ListFilter(hospital_ids=tuple(range(1, 8)), tier=1, urgency=1, is_pregnant=False, department_was_closed=False, is_infectious=False)
LIST_SQL = "hospital_id BETWEEN 1 AND 7 AND tier_code = 1 AND urgency_code = 1 AND is_pregnant = FALSE AND department_was_closed = FALSE AND infection_id IS NULL"
RANGE = (dt.datetime(1997, 3, 1), dt.datetime(1997, 3, 31, 23, 59, 59))
_JOINS = {k: f"LEFT JOIN (SELECT {key} AS k, {name} AS {k}_name FROM {t}) t_{k} ON t_{k}.k = f.{k}_id" for k, (t, key, name) in NAMES.items()}
_LIST = lambda kinds, where: f"FROM (SELECT fact.*, hospital_name, size_code FROM fact JOIN (SELECT hospital_id, hospital_name, size_code FROM hospital) USING (hospital_id)) f {' '.join(_JOINS[k] for k in kinds)} WHERE {where}"
_GROUPS = "g AS (SELECT i AS indication_id, unnest([i % 5, i % 7 + 10]) AS group_id FROM (SELECT unnest(range(0, 50, 2)) AS i))"
_NAMED = ", ".join(f"{k}_name" for k in LISTED)
_FMT = lambda e: f"CASE WHEN {e} IS NULL THEN '' ELSE rtrim(rtrim(printf('%.10f', {e}), '0'), '.') END"
QUERIES: dict[str, Pair] = {
    "list_allocations": (lambda s, d: listed(s, d, LIST).select("fact_key", "hospital_name", "age", *[f"{k}_name" for k in LISTED]), duck_with() + f"SELECT fact_key, hospital_name, age, {_NAMED} {_LIST(LISTED, LIST_SQL)}"),
    "list_drawer": (lambda s, d: restricted(facts(s, d), DRAWER.sql()).groupBy("hospital_id").agg(F.count(F.lit(1)).alias("n")), duck_with() + f"SELECT hospital_id, count(*) AS n FROM fact WHERE {DRAWER_SQL} GROUP BY 1"),
    "list_drawer_over_80": (lambda s, d: restricted(facts(s, d), DrawerFilter(age_group="over_80", is_infectious=True, infection=1).sql()).groupBy("speciality_id").agg(F.count(F.lit(1)).alias("n")), duck_with() + "SELECT speciality_id, count(*) AS n FROM fact WHERE age >= 80 AND infection_id = 1 GROUP BY 1"),
    "list_arrival_range": (lambda s, d: listed(s, d, ListFilter(arrival=RANGE), ("state",)).groupBy("state_name").agg(F.count(F.lit(1)).alias("n"), F.min("arrival_at").cast("string").alias("first"), F.max("arrival_at").cast("string").alias("last")), duck_with() + f"SELECT state_name, count(*) AS n, CAST(min(arrival_at) AS VARCHAR) AS first, CAST(max(arrival_at) AS VARCHAR) AS last {_LIST(('state',), "arrival_at BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31 23:59:59'")} GROUP BY 1"),
    "list_search": (lambda s, d: searched(hospitals(s, d), "hospital_name", "R#00000000").select("hospital_id", "hospital_name"), duck_with() + "SELECT hospital_id, hospital_name FROM hospital WHERE hospital_name ILIKE '%r#00000000%'"),
    "export_allocations": (lambda s, d: export(s, d, ListFilter(hospital_ids=(1, 2, 3), arrival=RANGE)).withColumn("arrival_at", F.col("arrival_at").cast("string")), duck_with() + f"SELECT fact_key, CAST(arrival_at AS VARCHAR) AS arrival_at, hospital_name, {', '.join(f'{k}_name' for k in EXPORTED)}, age, urgency_code {_LIST(EXPORTED, "hospital_id IN (1, 2, 3) AND arrival_at BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31 23:59:59'")}"),
    "export_count": (lambda s, d: listed(s, d, ListFilter(arrival=RANGE), ()).agg(F.count(F.lit(1)).alias("n")), duck_with() + f"SELECT count(*) AS n {_LIST((), "arrival_at BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31 23:59:59'")}"),
    "export_cells": (lambda s, d: csv_cells(hospitals(s, d).select("hospital_id", F.concat(F.lit("="), "hospital_name").alias("name"), (F.col("beds") / 8).alias("share"), F.when(F.col("participating"), F.lit('a "b", c')).alias("note"))), duck_with() + f"SELECT concat_ws(',', CAST(hospital_id AS VARCHAR), '''=' || hospital_name, {_FMT('beds / 8.0::DOUBLE')}, CASE WHEN participating THEN '\"a \"\"b\"\", c\"' ELSE '' END) AS line FROM hospital"),
    "export_explorer": (lambda s, d: explorer_export(facts(s, d).groupBy(F.col("gender_code").cast("string").alias("bucket"), F.col("urgency_code").cast("string").alias("series")).agg(F.count(F.lit(1)).alias("count")).where("bucket IS NOT NULL")), duck_with("c AS (SELECT CAST(gender_code AS VARCHAR) AS b, CAST(urgency_code AS VARCHAR) AS s, count(*) AS n FROM fact WHERE gender_code IS NOT NULL GROUP BY 1, 2)") + f"SELECT concat_ws(',', b, s, CAST(n AS VARCHAR), {_FMT('round(100 * n::DOUBLE / sum(n) OVER (), 2)')}, {_FMT('round(100 * n::DOUBLE / sum(n) OVER (PARTITION BY b), 2)')}) AS line FROM c UNION ALL SELECT concat_ws(',', 'Total', '', CAST(sum(n) AS VARCHAR), '100', '') FROM c"),
    "top_groups": (top_groups, duck_with(_GROUPS) + "SELECT group_id, count(*) AS n FROM fact JOIN g USING (indication_id) GROUP BY 1 ORDER BY n DESC, group_id LIMIT 10"),
    "filter_group": (lambda s, d: group_filter(s, d, 12), duck_with(_GROUPS) + "SELECT urgency_code, count(*) AS n FROM fact WHERE indication_id IN (SELECT indication_id FROM g WHERE group_id = 12) GROUP BY 1"),
    "filter_group_empty": (lambda s, d: group_filter(s, d, 99), duck_with() + "SELECT urgency_code, count(*) AS n FROM fact WHERE indication_id IN (-1) GROUP BY 1"),
    "scope_by_state": (lambda s, d: restricted(facts(s, d), resolved_scope("state", facts(s, d), hospitals(s, d), 2).sql()).groupBy("urgency_code").agg(F.count(F.lit(1)).alias("n")), duck_with() + "SELECT urgency_code, count(*) AS n FROM fact JOIN hospital USING (hospital_id) WHERE hospital_state_id = 2 GROUP BY 1"),
    "scope_by_cohort": (lambda s, d: restricted(facts(s, d), resolved_scope("cohort", facts(s, d), hospitals(s, d), "mixed_full").sql()).groupBy("urgency_code").agg(F.count(F.lit(1)).alias("n")), duck_with() + "SELECT urgency_code, count(*) AS n FROM fact WHERE location_code = 2 AND tier_code = 3 GROUP BY 1"),
    "scope_of_nobody_known": (lambda s, d: restricted(facts(s, d), resolved_scope("state", facts(s, d), hospitals(s, d), 77).sql()).groupBy("urgency_code").agg(F.count(F.lit(1)).alias("n")), duck_with() + "SELECT urgency_code, count(*) AS n FROM fact GROUP BY 1"),
    "scope_mine_empty": (lambda s, d: restricted(facts(s, d), resolved_scope("mine", facts(s, d), hospitals(s, d)).sql()).groupBy("urgency_code").agg(F.count(F.lit(1)).alias("n")), duck_with() + "SELECT urgency_code, count(*) AS n FROM fact WHERE FALSE GROUP BY 1"),
    "scope_hospitals_of_area": (lambda s, d: hospitals_in_scope(hospitals(s, d), facts(s, d), Scope(dispatch_area_id=3, tiers=(1, 2))).select("hospital_id", "beds"), duck_with() + "SELECT hospital_id, beds FROM hospital h WHERE tier_code IN (1, 2) AND EXISTS (SELECT 1 FROM fact f WHERE f.hospital_id = h.hospital_id AND f.dispatch_area_id = 3)"),
    "names_of_departments": (lambda s, d: named(facts(s, d).groupBy("department_id", "speciality_id").agg(F.count(F.lit(1)).alias("n")), s, d, ("department", "speciality")), duck_with("c AS (SELECT department_id, speciality_id, count(*) AS n FROM fact GROUP BY 1, 2)") + "SELECT department_id, speciality_id, n, n_name AS department_name, r_name AS speciality_name FROM c LEFT JOIN nation ON n_nationkey = department_id LEFT JOIN region ON r_regionkey = speciality_id"),
    "list_dominant_cohort": (lambda s, d: facts(s, d).where("location_code IS NOT NULL AND tier_code IS NOT NULL").groupBy("state_id", "location_code", "tier_code").agg(F.count(F.lit(1)).alias("n")).groupBy("state_id").agg(F.max_by(F.struct("location_code", "tier_code", "n"), F.struct("n", -F.col("location_code"), -F.col("tier_code"))).alias("m")).select("state_id", "m.*"), duck_with("c AS (SELECT state_id, location_code, tier_code, count(*) AS n FROM fact WHERE tier_code IS NOT NULL GROUP BY ALL)") + "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY n DESC, location_code, tier_code) AS r FROM c) WHERE r = 1"),
    "list_raw_by_use": (lambda s, d: raw_by_use(s, d), duck_with() + "SELECT raw_id, (SELECT count(*) FROM fact WHERE indication_raw_id = raw_id) AS n FROM (SELECT CAST(unnest(range(160)) AS INTEGER) AS raw_id) ORDER BY n DESC, raw_id LIMIT 20"),
}


def raw_by_use(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """Raw indications in order of their use: the count is joined once instead of being looked up for each row."""
    n = facts(spark, d).groupBy("indication_raw_id").agg(F.count(F.lit(1)).alias("n"))
    known = spark.range(160).select(F.col("id").cast("int").alias("raw_id"))
    return known.join(n, known["raw_id"] == n["indication_raw_id"], "left").select("raw_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy(F.desc("n"), "raw_id").limit(k)
