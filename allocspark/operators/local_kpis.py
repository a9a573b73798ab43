"""Daily figures of imports by local days, kept by recomputing the days that late rows touch; months of a report by the same calendar; views and derived tables in one store."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.local_days import local_day, local_month, today, within
from ..session import shared_dir
from ..sources.binding import CREATED, SPARK, duck_with, facts
from .aggregates import Pair
from .store import Store, dropped_import, refreshed_views, replaced_import

#: States of imports that have ended, and those that count as successful.
FINAL, SUCCESSFUL = ("completed", "partial", "failed", "cancelled"), ("completed", "partial")
#: The table of daily figures in a store; its parts are months.
KPIS = "kpi_days"


def by_local_day(log: DataFrame) -> DataFrame:
    """Figures of each local day and hospital, and of all hospitals of a day (hospital_id null). log: created_at, hospital_id, status, n_rows, n_rejected. A day without ended imports has no row."""
    ended = log.where(F.col("status").isin(*FINAL)).withColumn("day", local_day("created_at"))
    return ended.groupingSets([["day", "hospital_id"], ["day"]], "day", "hospital_id").agg(
        F.count(F.lit(1)).alias("imports"),
        F.count_if(F.col("status").isin(*SUCCESSFUL)).alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n_rejected"), F.lit(0)).alias("n_rejected"),
    )


def _month(day: Column | str) -> Column:
    return F.date_format(day, "yyyy-MM")


def aggregated(store: Store, log: DataFrame) -> None:
    """All days, in one change."""
    with store.change() as change:
        change.replace_by(KPIS, _month("day"), by_local_day(log))


def recomputed(store: Store, log: DataFrame, late: DataFrame, now: dt.datetime, days: int = 2) -> list[dt.date]:
    """Replace the figures of those of the last ``days`` local days (today among them) on which late rows fall; the days.

    The log is read for these days only, and only their months are written. Late rows of
    earlier days change nothing. A day that has lost its ended imports goes.
    """
    last = today(now)
    first = last - dt.timedelta(days=days - 1)
    touched = sorted(r[0] for r in late.where(within("created_at", first, last)).select(local_day("created_at")).distinct().collect())  # as many as ``days`` at most
    if not touched:
        return []
    ranges = " OR ".join(f"({within('created_at', d, d)})" for d in touched)
    fresh = by_local_day(log.where(ranges))
    months = sorted({f"{d:%Y-%m}" for d in touched})
    with store.change() as change:
        for month in months:
            old = store.read(KPIS, [month])
            rows = fresh.where(_month("day") == month)
            if old is not None:
                rows = rows.unionByName(old.where(~F.col("day").isin(touched)).select(*rows.columns))
            change.replace(KPIS, month, rows)
    return touched


def local_months(rows: DataFrame) -> DataFrame:
    """Allocations of each local month, and the change in percent from the month and the year before: null without any there."""
    n = rows.groupBy(local_month("created_at").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    other = lambda months, name: n.select(F.add_months("month", months).cast("date").alias("month"), F.col("n").alias(name))
    both = n.join(other(1, "before"), "month", "left").join(other(12, "year_before"), "month", "left")
    change = lambda c: F.round(100 * (F.col("n") - F.col(c)).cast("double") / F.col(c), 1)
    return both.select("month", "n", change("before").alias("mom"), change("year_before").alias("yoy"))


def import_log(spark: SparkSession, d: str) -> DataFrame:
    """The bound log of imports: one for each order, at its instant of creation."""
    status = "CASE o_orderkey % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'running' WHEN 3 THEN 'cancelled' ELSE 'completed' END"
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumn("created_at", F.expr(CREATED[SPARK].replace("l_orderkey", "o_orderkey")))
    return orders.select("created_at", F.expr("o_custkey % 10").alias("hospital_id"), F.expr(status).alias("status"), F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END").alias("n_rows"), F.expr("o_orderkey % 7").alias("n_rejected"), (F.col("o_orderkey") % 3 == 0).alias("late"))


def _store(spark: SparkSession, name: str) -> Store:
    return Store(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


#: An instant on the day after clocks went forward, and one on the day on which they went back.
SPRING, AUTUMN = dt.datetime(1997, 3, 31, 12), dt.datetime(1997, 10, 26, 23, 30)


def _recomputed(spark: SparkSession, d: str) -> DataFrame:
    """All days without late rows, then the two days up to each instant with them; late rows of other days stay out."""
    log, store = import_log(spark, d), _store(spark, "kpis")
    late = F.col("late")
    in_time = [within("created_at", today(now) - dt.timedelta(days=1), today(now)) for now in (SPRING, AUTUMN)]
    known = log.where(~late | F.expr(f"NOT ({in_time[0]}) AND NOT ({in_time[1]})"))
    aggregated(store, known)
    for now in (SPRING, AUTUMN):
        recomputed(store, log, log.where(late), now)
    return store.read(KPIS)


def _transaction(spark: SparkSession, d: str) -> DataFrame:
    """Three derived tables by import; one import is replaced and one dropped in all of them, and a change that fails halfway leaves no trace."""
    rows, store = facts(spark, d), _store(spark, "derived")
    months = lambda x: x.groupBy("import_id", "hospital_id").agg(F.count(F.lit(1)).alias("n"))
    tables = {"facts": rows.select("import_id", "fact_key", "hospital_id"), "notes": rows.where("notes <> ''").select("import_id", "fact_key", "notes"), "hospitals": months(rows)}
    with store.change() as change:
        for name, frame in tables.items():
            change.replace_by(name, F.col("import_id"), frame)
    kept = {name: frame.where("import_id = 199605 AND hospital_id % 2 = 0") for name, frame in tables.items()}
    replaced_import(store, 199605, kept)
    dropped_import(store, 199606)
    try:
        with store.change() as change:
            change.drop("facts", 199607)
            change.replace("notes", 199607, tables["notes"].where("import_id = 199607").select("*", F.assert_true(F.lit(False)).alias("never")))
    except Exception:  # noqa: BLE001 - any failure of the job must leave the tables as they were
        store.recovered()
    store.retired()
    counted = [store.read(name).groupBy("import_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name in tables]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _views(spark: SparkSession, d: str) -> DataFrame:
    """Views of part of the allocations, a reader of them, and a refresh over all, in which one view fails."""
    rows, store = facts(spark, d), _store(spark, "views")
    view = lambda frame, *keys: lambda: frame.dropna(subset=list(keys)).select(*keys, "hospital_id").distinct()
    first = rows.where("created_year < 1995")
    refreshed_views(store, {"by_state": view(first, "state_id"), "by_area": view(first, "dispatch_area_id")})
    readers = {name: store.read(name) for name in ("by_state", "by_area")}
    broken = lambda: rows.select("state_id", F.col("hospital_id"), F.raise_error(F.lit("no such source")).alias("x"))
    told = refreshed_views(store, {"by_state": broken, "by_area": view(rows, "dispatch_area_id")})
    size = lambda frame: frame.agg(F.count(F.lit(1)).alias("n"))
    out = [size(readers[name]).select(F.lit(name).alias("name"), F.lit(told[name].split(":")[0]).alias("told"), F.col("n").alias("n_before")).join(size(store.read(name)).select(F.col("n").alias("n_after"))) for name in readers]  # one row each
    return out[0].unionByName(out[1])


_ENDED = "count(*) AS imports, count(*) FILTER (WHERE status = 'completed' OR status = 'partial') AS successful, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(coalesce(sum(n_rows), 0) AS BIGINT) AS n_rows, CAST(coalesce(sum(n_rejected), 0) AS BIGINT) AS n_rejected"
_LOG = """WITH log AS (SELECT CAST((o_orderdate + to_minutes(o_orderkey * 37 % 1440)) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin' AS DATE) AS day, o_custkey % 10 AS hospital_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'running' WHEN 3 THEN 'cancelled' ELSE 'completed' END AS status,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END AS n_rows, o_orderkey % 7 AS n_rejected FROM orders), f AS (SELECT * FROM log WHERE status <> 'running')"""
QUERIES: dict[str, Pair] = {
    "kpi_local_days": (_recomputed, f"{_LOG} SELECT day, hospital_id, {_ENDED} FROM f GROUP BY 1, 2 UNION ALL SELECT day, NULL, {_ENDED} FROM f GROUP BY 1"),
    "report_local_months": (
        lambda s, d: local_months(facts(s, d)),
        duck_with("m AS (SELECT CAST(date_trunc('month', created_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin') AS DATE) AS month, count(*) AS n FROM fact GROUP BY 1)")
        + "SELECT a.month, a.n, round(100 * (a.n - b.n)::DOUBLE / b.n, 1) AS mom, round(100 * (a.n - c.n)::DOUBLE / c.n, 1) AS yoy FROM m a LEFT JOIN m b ON a.month = b.month + INTERVAL 1 MONTH LEFT JOIN m c ON a.month = c.month + INTERVAL 1 YEAR",
    ),
    "upkeep_transaction": (
        _transaction,
        duck_with("k AS (SELECT * FROM fact WHERE import_id <> 199606 AND (import_id <> 199605 OR hospital_id % 2 = 0))")
        + "SELECT import_id, count(*) AS n, 'facts' AS name FROM k GROUP BY 1 UNION ALL SELECT import_id, count(*), 'notes' FROM k WHERE notes <> '' GROUP BY 1 UNION ALL SELECT import_id, count(DISTINCT hospital_id), 'hospitals' FROM k GROUP BY 1",
    ),
    "upkeep_view_versions": (
        _views,
        duck_with("s AS (SELECT count(DISTINCT (state_id, hospital_id)) AS n FROM fact WHERE created_year < 1995)", "a AS (SELECT count(DISTINCT (dispatch_area_id, hospital_id)) FILTER (WHERE created_year < 1995) AS n, count(DISTINCT (dispatch_area_id, hospital_id)) AS m FROM fact)")
        + "SELECT 'by_state' AS name, 'failed' AS told, n AS n_before, n AS n_after FROM s UNION ALL SELECT 'by_area', 'refreshed', n, m FROM a",
    ),
}
