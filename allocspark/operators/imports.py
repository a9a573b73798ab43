"""The import of CSV exports on a bound export: one row of text cells for each order, in every spelling that rules know."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import csv_import as C
from .aggregates import Pair

#: Columns of the export: header and SQL (for both engines) over orders joined with customer.
EXPORT = {
    "Krankenhaus-Kurzname": "CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE concat('KH ', o_custkey % 10) END",
    "Zuweisung durch": "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Koordinierungsstelle Nord' ELSE concat('Leitstelle Ort', o_custkey % 4, ' (alt)') END",
    "Versorgungsbereich": "concat('Kreis Feld', o_custkey % 3)",
    "Datum (Erstellungsdatum)": "CASE WHEN o_orderkey % 47 = 0 THEN 'gestern' ELSE concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '.', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS STRING) ELSE substring(CAST(year(o_orderdate) AS STRING), 3, 2) END) END",
    "Uhrzeit (Erstellungsdatum)": "'11:36'",
    "Datum (Eintreffzeit)": "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '.', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', CAST(year(o_orderdate) AS STRING))",
    "Uhrzeit (Eintreffzeit)": "CASE WHEN o_orderkey % 53 = 0 THEN '09:00:00' ELSE '14:52:38' END",
    "Geschlecht": "CASE o_orderkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'W' WHEN 2 THEN 'F' ELSE '' END",
    "Alter": "CASE WHEN o_custkey % 19 = 0 THEN 'alt' ELSE CAST(o_custkey % 103 AS STRING) END",
    "Transportmittel": "CASE o_orderkey % 6 WHEN 0 THEN 'Boden' WHEN 1 THEN 'RTW' WHEN 2 THEN 'LUFT' WHEN 3 THEN 'Bodenlos' ELSE 'naw' END",
    "PZC": "CASE WHEN o_orderkey % 29 = 0 THEN '12' ELSE concat(CAST(100 + o_custkey % 900 AS STRING), '4', CAST(o_orderkey % 5 AS STRING), CAST(o_custkey % 4 AS STRING)) END",
    "PZC und Text": "concat(CAST(100 + o_custkey % 900 AS STRING), ' Fall  Nr', o_custkey % 20)",
    "Neben-PZC": "CASE WHEN o_orderkey % 3 = 0 THEN '223741' ELSE '' END",
    "Neben-PZC Text": "CASE WHEN o_orderkey % 6 = 0 THEN 'Sturz' ELSE '' END",
    "Fachgebiet": "CASE WHEN o_custkey % 23 = 0 THEN '' ELSE 'Innere  Medizin' END",
    "Fachbereich": "CASE o_orderkey % 3 WHEN 0 THEN 'Geburtsklinik' WHEN 1 THEN 'KARDIOLOGIE' ELSE 'Unbekannt' END",
    "Grund": "'Patient'",
    "Schockraum": "CASE o_orderkey % 4 WHEN 0 THEN 'S+' WHEN 1 THEN 'S-' WHEN 2 THEN '' ELSE 'ja' END",
    "Beatmet": "CASE WHEN o_orderkey % 41 = 0 THEN 'vielleicht' ELSE 'nein' END",
    "Ansteckungsfähig": "CASE o_orderkey % 3 WHEN 0 THEN 'Keine' WHEN 1 THEN 'k.A.' ELSE 'Noro' END",
    "Airway": "CASE o_orderkey % 4 WHEN 0 THEN 'A-frei' WHEN 1 THEN 'a-Krit.' WHEN 2 THEN 'Tubus' ELSE '' END",
    "Disability": "CASE o_orderkey % 3 WHEN 0 THEN 'D-GCS < 9' WHEN 1 THEN 'wach' ELSE 'D-' END",
    "ENR": "concat('E-', o_orderkey % 100)",
    "MANV": "CASE WHEN o_orderkey % 37 = 0 THEN 'Zug' ELSE '' END",
}


def export(spark: SparkSession, d: str) -> DataFrame:
    """The bound export under its headers."""
    return spark.read.parquet(f"{d}/orders.parquet").select(*[F.expr(e).alias(n) for n, e in EXPORT.items()])


_exports: dict[tuple[str, str], str] = {}


def written_export(spark: SparkSession, d: str) -> str:
    """The bound export as CSV files of two encodings, in a folder that all executors see; written once an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _exports:
        path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
        rows = export(spark, d)
        odd = F.col("Versorgungsbereich") == "Kreis Feld0"
        for encoding, part in (("UTF-8", rows.where(odd)), ("ISO-8859-1", rows.where(~odd))):
            part.write.mode("append").csv(path, header=True, sep=";", encoding=encoding, emptyValue="", escape="\\")
        _exports[key] = path
    return _exports[key]


_typed: dict[tuple[str, str], str] = {}


def typed(spark: SparkSession, d: str) -> DataFrame:
    """The export's allocations with typed cells, written once an application as an import would leave them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _typed:
        path = f"{shared_dir(spark)}/typed-{uuid.uuid4().hex}"
        C.allocations(C.routed(C.read_rows(spark, written_export(spark, d)))["allocations"]).write.parquet(path)
        _typed[key] = path
    return spark.read.parquet(_typed[key])


def _routes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("type", C.row_type(rows))


def departments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "Geburtshilfe"), (2, "Kardiologie")], "id int, name string")


def _rejected(spark: SparkSession, d: str) -> DataFrame:
    """Messages of rows that break a rule, and of those whose department nobody knows."""
    valid, rejects = C.validated(typed(spark, d))
    _, lost = C.referenced(valid, {"department": (departments(spark), C.DEPARTMENT_ALIASES)})
    return C.reject_groups(rejects.unionByName(lost)).select("field", "value", "reason", "n")


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = C.validated(typed(spark, d))
    rows, _ = C.referenced(valid, {"department": (departments(spark), C.DEPARTMENT_ALIASES)})
    keys = ("gender", "transport_type", "urgency", "dispatch_area", "infection", "department_id", "requires_resus", "assessment_airway", "assessment_disability")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("age").alias("ages"), F.min("created_at").cast("string").alias("first"))


def _indications(spark: SparkSession, d: str) -> DataFrame:
    """New raw indications beside one that is known, and rows with its normalised id."""
    valid, _ = C.validated(typed(spark, d))
    known = valid.where("secondary_indication = 'Sturz'").limit(1).select(C.indication_key(F.col("secondary_code"), F.col("secondary_indication")).alias("raw_key"), F.lit(5).alias("normalized_id"))
    rows, new = C.with_raw_indications(valid, known)
    return new.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).unionByName(rows.agg(F.lit(-1).alias("code"), F.count_if(F.col("secondary_indication_id") == 5).alias("n"), F.lit("known").alias("name")))


_CELLS = ", ".join(f'{e} AS "{n}"' for n, e in EXPORT.items())
_SRC = f"WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, {_CELLS} FROM orders), a AS (SELECT * FROM x WHERE k % 37 <> 0)"
_TYPED = _SRC + """, t AS (SELECT k, c, nullif("Krankenhaus-Kurzname", '') AS hospital,
  CASE WHEN k % 5 < 2 THEN 'Feld' || c % 3 ELSE 'Ort' || c % 4 END AS dispatch_area,
  CASE WHEN k % 47 <> 0 THEN strptime("Datum (Eintreffzeit)" || ' 11:36', '%d.%m.%Y %H:%M') END AS created_at,
  strptime("Datum (Eintreffzeit)" || ' ' || substr("Uhrzeit (Eintreffzeit)", 1, 5), '%d.%m.%Y %H:%M') AS arrival_at,
  CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS gender, CASE WHEN c % 19 <> 0 THEN c % 103 END AS age,
  CASE k % 6 WHEN 2 THEN 'A' WHEN 3 THEN NULL ELSE 'G' END AS transport_type,
  CASE WHEN k % 29 <> 0 AND c % 4 > 0 THEN c % 4 END AS urgency, CASE WHEN k % 29 <> 0 THEN 100 + c % 900 END AS code, 'Fall  Nr' || c % 20 AS indication,
  CASE WHEN k % 3 = 0 THEN 223 END AS secondary_code, CASE WHEN k % 6 = 0 THEN 'Sturz' END AS secondary_indication,
  CASE WHEN c % 23 <> 0 THEN 'x' END AS speciality, CASE k % 3 WHEN 2 THEN 'Noro' END AS infection,
  CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS department_id, k % 4 IN (0, 3) AS requires_resus, k % 41 = 0 AS odd_flag,
  CASE k % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'critical' WHEN 2 THEN 'Tubus' END AS assessment_airway, CASE k % 3 WHEN 0 THEN 'gcs_below_9' WHEN 1 THEN 'awake' END AS assessment_disability FROM a),
bad AS (SELECT k, 'hospital' AS field, NULL AS value, 'must not be blank' AS reason FROM t WHERE hospital IS NULL
  UNION ALL SELECT k, 'created_at', NULL, 'must be a date and a time' FROM t WHERE created_at IS NULL
  UNION ALL SELECT k, 'arrival_at', CAST(arrival_at AS VARCHAR), 'must not be before created_at' FROM t WHERE arrival_at < created_at
  UNION ALL SELECT k, 'age', CAST(age AS VARCHAR), 'must be between 1 and 99' FROM t WHERE age IS NULL OR age < 1 OR age > 99
  UNION ALL SELECT k, 'urgency', NULL, 'must be between 1 and 3' FROM t WHERE urgency IS NULL
  UNION ALL SELECT k, 'code', NULL, 'must be between 100 and 999' FROM t WHERE code IS NULL
  UNION ALL SELECT k, 'speciality', NULL, 'must not be blank' FROM t WHERE speciality IS NULL
  UNION ALL SELECT k, 'is_ventilated', NULL, 'must be yes or no' FROM t WHERE odd_flag),
good AS (SELECT * FROM t WHERE k NOT IN (SELECT k FROM bad))"""
QUERIES: dict[str, Pair] = {
    "import_routes": (lambda s, d: _routes(C.read_rows(s, written_export(s, d))).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ansteckungsfaehig") == "Noro").alias("noro")), _SRC + " SELECT CASE WHEN k % 37 = 0 THEN 'MCI_CASE' ELSE 'ALLOCATION' END AS type, count(*) AS n, count(*) FILTER (WHERE k % 3 = 2) AS noro FROM x GROUP BY 1"),
    "import_rejects": (_rejected, _TYPED + " SELECT field, value, reason, count(*) AS n FROM bad GROUP BY 1, 2, 3 UNION ALL SELECT 'department', 'Unbekannt', 'is not known', count(*) FROM good WHERE department_id IS NULL"),
    "import_accepted": (_accepted, _TYPED + " SELECT gender, transport_type, urgency, dispatch_area, infection, department_id, requires_resus, assessment_airway, assessment_disability, count(*) AS n, CAST(sum(age) AS BIGINT) AS ages, CAST(min(created_at) AS VARCHAR) AS first FROM good WHERE department_id IS NOT NULL GROUP BY ALL"),
    "import_raw_indications": (_indications, _TYPED + ", r AS (SELECT DISTINCT code, regexp_replace(indication, '\\s+', ' ', 'g') AS s, indication AS name FROM good) SELECT code, count(*) AS n, min(name) AS name FROM r GROUP BY 1 UNION ALL SELECT -1, count(*), 'known' FROM good WHERE k % 6 = 0"),
    "import_mass_casualties": (lambda s, d: C.mass_casualties(C.routed(C.read_rows(s, written_export(s, d)))["mass_casualties"]).groupBy("mci_title", "gender", "requires_resus").agg(F.count(F.lit(1)).alias("n"), F.sum("age").alias("ages")), _SRC + " SELECT 'Zug' AS mci_title, CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'X' END AS gender, CASE k % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN TRUE END AS requires_resus, count(*) AS n, CAST(sum(CASE WHEN c % 19 <> 0 THEN c % 103 END) AS BIGINT) AS ages FROM x WHERE k % 37 = 0 GROUP BY ALL"),
    "import_outcome": (lambda s, d: _outcome(s, d), _TYPED + " SELECT count(*) AS total, (SELECT count(DISTINCT k) FROM bad) AS rejected, CASE WHEN (SELECT count(DISTINCT k) FROM bad)::DOUBLE / count(*) >= 0.35 THEN 'failed' WHEN (SELECT count(DISTINCT k) FROM bad)::DOUBLE / count(*) < 0.05 THEN 'completed' ELSE 'partial' END AS outcome FROM t"),
}


def _outcome(spark: SparkSession, d: str) -> DataFrame:
    valid, rejects = C.validated(typed(spark, d))
    n = valid.agg(F.count(F.lit(1)).alias("v")).crossJoin(rejects.agg(F.count(F.lit(1)).alias("rejected")))  # one row each
    share = F.col("rejected") / F.col("total")
    return n.select((F.col("v") + F.col("rejected")).alias("total"), "rejected").withColumn("outcome", F.when((F.col("total") == 0) | (share >= 0.35), "failed").when(share < 0.05, "completed").otherwise("partial"))
