"""Deduplication import by import, against a kept index of cases.

The index has the row that stands for each case, in parts by the month of its event. Copies
of a case have the same event, so a new import meets only the parts of its own months; the
rows of earlier imports are not read. The outcome is that of ranking all rows at once: the
newest import wins, then the most complete row, then the least key (``ranked_copies``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .aggregates import Pair
from .maintenance import DEDUP, _repeated, cased
from .store import Change, Store

#: Tables of the index: rows that stand for cases, by month; removed rows, by the import that removed them.
CASES, REMOVED = "cases", "removed"


def entries(rows: DataFrame) -> DataFrame:
    """What the index knows of rows."""
    return cased(rows).select("case_key", F.date_format("created_at", "yyyy-MM").alias("month"), "import_id", "complete", "fact_key", "hospital_id", F.col("case_id").isNotNull().alias("by_case_id"), "assessment_id")


def _ranked(rows: DataFrame) -> DataFrame:
    order = (F.desc("import_id"), F.desc("complete"), "fact_key")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("month", "case_key").orderBy(*order)))


def built(store: Store, rows: DataFrame) -> None:
    """The index of all rows, from nothing."""
    with store.change() as change:
        _put_cases(change, rows)


def _put_cases(change: Change, rows: DataFrame) -> None:
    """The cases of all months that rows hold. They are moved once, to ranges of months and cases, in which they are both ranked and written."""
    change.replace_by(CASES, F.col("month"), _ranked(entries(rows).repartitionByRange("month", "case_key")).where("rn = 1").drop("rn"), laid=True)


def applied(store: Store, import_id: int, rows: DataFrame) -> dict[str, int]:
    """Take an import that the index doesn't know into it; rows that it removed: of itself (``current``) and of other imports (``other``).

    Reads the import and the index of its months, and rewrites those months.
    """
    new = entries(rows.where(F.col("import_id") == import_id)).withColumn("fresh", F.lit(True))
    months = sorted(r[0] for r in new.select("month").distinct().collect())  # months of one import
    if not months:
        return {"current": 0, "other": 0}
    known = store.read(CASES, months)
    both = new if known is None else new.unionByName(known.withColumn("fresh", F.lit(False)))
    ranked = _ranked(both).persist()
    try:
        gone = ranked.where("rn > 1").select("fact_key", "import_id", "hospital_id", "by_case_id", "assessment_id", F.when(F.col("fresh"), "current").otherwise("other").alias("attribution"))
        counts = {r["attribution"]: r["n"] for r in gone.groupBy("attribution").agg(F.count(F.lit(1)).alias("n")).collect()}
        with store.change() as change:
            change.replace_by(CASES, F.col("month"), ranked.where("rn = 1").drop("rn", "fresh"))
            change.replace(REMOVED, import_id, gone)
    finally:
        ranked.unpersist()
    return {"current": 0, "other": 0} | counts


def withdrawn(store: Store, import_id: int, rows: DataFrame) -> list[str]:
    """Take an import out: cases that it stood for, or whose rows it removed, are ranked anew among the other imports' rows (``rows``, of which only the months concerned are read). The months."""
    gone = store.read(REMOVED, [import_id])
    own = store.read(CASES)
    months = sorted(r[0] for r in own.where(F.col("import_id") == import_id).select("month").distinct().collect()) if own is not None else []
    left = rows.where(F.col("import_id") != import_id).where(F.date_format("created_at", "yyyy-MM").isin(months))
    with store.change() as change:
        for month in months:
            change.drop(CASES, month)
        if months:
            _put_cases(change, left)
        if gone is not None:
            change.drop(REMOVED, import_id)
    return months


def kept(rows: DataFrame, store: Store) -> DataFrame:
    """The rows that stand for their cases; others are orphans of the projection."""
    return rows.join(store.read(CASES).select("fact_key"), "fact_key", "left_semi")


def orphaned_assessments(store: Store) -> DataFrame:
    """Assessments of removed rows that no row refers to any more."""
    return store.read(REMOVED).where("assessment_id IS NOT NULL").select("assessment_id").distinct().join(store.read(CASES).select("assessment_id"), "assessment_id", "left_anti")


#: Imports that come one by one after all earlier ones.
LATE = (200105, 200106, 200107, 200108)


def _incremental(spark: SparkSession, d: str) -> DataFrame:
    rows, store = _repeated(spark, d), Store(spark, f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}")
    built(store, rows.where(F.col("import_id") < LATE[0]))
    for import_id in (*LATE, LATE[-1] + 1):
        applied(store, import_id, rows)
    standing = store.read(CASES).groupBy("import_id").agg(F.count(F.lit(1)).alias("n")).select("import_id", F.lit("kept").alias("part"), "n")
    removed = [store.read(REMOVED, [i]).groupBy("attribution").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("import_id"), F.col("attribution").alias("part"), "n") for i in store.parts(REMOVED)]
    for r in removed:
        standing = standing.unionByName(r.withColumn("import_id", F.col("import_id").cast("int")))
    return standing


_BY_CASE = DEDUP[: DEDUP.rindex("SELECT import_id")]
QUERIES: dict[str, Pair] = {
    "dedup_incremental": (
        _incremental,
        _BY_CASE + f", c AS (SELECT case_key, import_id, count(*) AS n, min(min(import_id)) OVER (PARTITION BY case_key) AS first FROM k GROUP BY 1, 2), z AS (SELECT * FROM c WHERE import_id >= {LATE[0]}) "
        "SELECT import_id, 'kept' AS part, count(*) AS n FROM r WHERE rn = 1 GROUP BY 1 UNION ALL SELECT import_id, 'current', CAST(sum(n - 1) AS BIGINT) FROM z WHERE n > 1 GROUP BY 1 UNION ALL SELECT import_id, 'other', count(*) FROM z WHERE first < import_id GROUP BY 1",
    ),
}
