"""Reports: one period beside another, a month with its tables, distribution patterns, and what may be shown on a map."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..plans.analysis import restricted
from ..plans.spec import Period
from ..sources.binding import duck_with, facts
from .aggregates import CLINICAL, NIGHT, Pair, count
from .upkeep import import_log

#: Cases under which a feature of the map shows nothing; rows of a month's tables.
MIN_CASES, TOP = 10, 5
#: Conditions whose rates a report compares.
RATES = {"resus": CLINICAL["resus"], "cpr": CLINICAL["cpr"], "night": NIGHT, "urgent": "urgency_code = 1"}
#: Dimensions of a distribution pattern: code columns.
PATTERN = {"gender": "gender_code", "urgency": "urgency_code", "transport_type": "transport_type_code", "infection": "infection_id", "occasion": "occasion_id"}


def relative(now: Column, before: Column) -> Column:
    """Change in percent to one decimal; 0 of nothing to nothing, null of nothing to something."""
    return F.when(before > 0, F.round(100 * (now - before).cast("double") / before, 1)).when(now == 0, F.lit(0.0))


def months_before(first: dt.datetime, n: int) -> dt.datetime:
    month = first.year * 12 + first.month - 1 - n
    return dt.datetime(month // 12, month % 12 + 1, 1)


def period_over_period(rows: DataFrame, periods: dict[str, Period]) -> DataFrame:
    """Cases and rates of ``now`` beside each other period, from one pass: name, days, cases a day, change in percent, and changes of rates in points."""
    sides = {name: " AND ".join(p.sql()) for name, p in periods.items()}
    wanted = {"cases": "TRUE", **RATES}
    one = rows.where(" OR ".join(f"({c})" for c in sides.values())).agg(*[F.expr(count(f"({c}) AND ({side})")).alias(f"{name}__{k}") for name, side in sides.items() for k, c in wanted.items()])
    share = lambda name, k: F.when(F.col(f"{name}__cases") > 0, 100 * F.col(f"{name}__{k}").cast("double") / F.col(f"{name}__cases")).otherwise(F.lit(0.0))
    parts = [F.struct(F.lit(name).alias("name"), F.lit((p.end - p.start).days).alias("days"), F.col(f"{name}__cases").alias("cases"), F.round(F.col(f"{name}__cases").cast("double") / (p.end - p.start).days, 2).alias("per_day"), relative(F.col("now__cases"), F.col(f"{name}__cases")).alias("change"), *[F.round(share("now", k) - share(name, k), 1).alias(f"{k}_points") for k in RATES]) for name, p in periods.items()]
    return one.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def report_periods(first: dt.datetime) -> dict[str, Period]:
    """A month, the month before, and the same month of the year before."""
    month = lambda n: Period(months_before(first, n), months_before(first, n - 1))
    return {"now": month(0), "previous": month(1), "year_before": month(12)}


def last_completed_month(now: dt.datetime, year: int, month: int) -> dt.datetime:
    """The first day of a month, or of the last completed one if that isn't over."""
    return min(dt.datetime(year, month, 1), months_before(now, 1))


def month_tables(rows: DataFrame, period: Period) -> DataFrame:
    """The five most frequent departments, indications and origins of a period (ties by id), counted in one pass."""
    live = restricted(rows, period.sql())
    pairs = ", ".join(f"'{n}', CAST({c} AS BIGINT)" for n, c in (("department", "department_id"), ("indication", "indication_id"), ("origin", "dispatch_area_id")))
    n = live.select(F.expr(f"stack(3, {pairs}) AS (kind, id)")).where("id IS NOT NULL").groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("position", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "id"))).where(F.col("position") <= TOP)


def filled(counts: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Counts over a fixed set of keys; missing ones are 0."""
    return keys.join(counts, on, "left").na.fill(0)


def month_days(rows: DataFrame, period: Period) -> DataFrame:
    """Each day of a period, also without cases."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    n = restricted(rows, period.sql()).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.range((period.end - period.start).days).select(F.date_format(F.date_add(F.lit(period.start.date()), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    return filled(n, spine, "day")


def rejection_rates(log: DataFrame) -> DataFrame:
    """Share of rejected rows of final imports by month, and how far it is from the month before in points."""
    final = log.where("status <> 'running'").groupBy(F.substring("day", 1, 7).alias("month")).agg(F.sum(F.coalesce("n_rows", F.lit(0))).alias("n_rows"), F.sum("n_rejected").alias("n_rejected"), F.count(F.lit(1)).alias("imports"), F.count_if(F.col("status") == "failed").alias("failed"))
    rate = F.when(F.col("n_rows") > 0, 100 * F.col("n_rejected").cast("double") / F.col("n_rows")).otherwise(F.lit(0.0))
    w = Window.partitionBy(F.lit(1)).orderBy("month")  # a row a month
    return final.withColumn("rate", rate).select("month", "imports", "failed", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.lag("rate").over(w), 6).alias("points"))


def pattern(rows: DataFrame) -> DataFrame:
    """For each tier and location: relative frequencies of codes (among rows that have one), how often there is one, probabilities of flags, and hours; kind, key, p."""
    keys = ("tier_code", "location_code")
    n = rows.groupBy(*keys, *PATTERN.values(), "created_hour").agg(F.count(F.lit(1)).alias("n"))  # a row for each combination of codes
    kinds = {**PATTERN, "hour": "created_hour"}
    long = n.select(*keys, "n", F.expr(f"stack({len(kinds)}, {', '.join(f"'{k}', CAST({c} AS STRING)" for k, c in kinds.items())}) AS (kind, key)"))
    cells = long.groupBy(*keys, "kind", "key").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "kind")
    some, every = F.sum(F.when(F.col("key").isNotNull(), F.col("n"))).over(w), F.sum("n").over(w)
    shares = cells.withColumns({"some": some, "every": every})
    of_codes = shares.where("key IS NOT NULL").select(*keys, "kind", "key", F.round(F.col("n").cast("double") / F.col("some"), 6).alias("p"))
    present = shares.select(*keys, F.concat("kind", F.lit("_present")).alias("kind"), F.lit("true").alias("key"), F.round(F.coalesce("some", F.lit(0)).cast("double") / F.col("every"), 6).alias("p")).distinct()
    flags = rows.groupBy(*keys).agg(*[F.expr(f"round(CAST(count(CASE WHEN {c} THEN 1 END) AS DOUBLE) / count(*), 6)").alias(k) for k, c in CLINICAL.items()])
    of_flags = flags.select(*keys, F.expr(f"stack({len(CLINICAL)}, {', '.join(f"'{k}', 'true', {k}" for k in CLINICAL)}) AS (kind, key, p)"))
    return of_codes.unionByName(present).unionByName(of_flags)


def pattern_lines(rows: DataFrame) -> DataFrame:
    """A pattern as lines of its file format, in order: a head, then one block for each kind."""
    keyed = rows.withColumn("at", F.struct("tier_code", "location_code", "kind", "key"))
    line = F.concat(F.lit("  "), F.col("kind"), F.lit("/"), F.col("key"), F.lit(": "), F.format_string("%.6f", "p"))
    name = F.concat_ws("-", F.coalesce(F.expr(S.coded("location_code", S.LOCATION)), F.lit("unknown")), F.coalesce(F.expr(S.coded("tier_code", S.TIER)), F.lit("unknown")))
    return keyed.select(name.alias("name"), "at", line.alias("line")).groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body")).select("name", F.concat(F.lit("format: distribution-pattern/v1\nvalues:\n"), F.col("body")).alias("text"))


def map_features(rows: DataFrame) -> DataFrame:
    """Origins for a map: under ten cases a feature is there with nothing to show."""
    n = rows.groupBy("dispatch_area_id").agg(F.count(F.lit(1)).alias("cases"), F.expr(count("urgency_code = 1")).alias("urgent"))
    seen = F.col("cases") >= MIN_CASES
    return n.select("dispatch_area_id", F.when(seen, F.col("cases")).otherwise(0).alias("cases"), F.when(seen, F.col("urgent")).otherwise(0).alias("urgent"), (~seen).alias("hidden"))


def hospital_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids of the hospitals with allocations of each state, area or cohort, where there are two or more."""
    return rows.select(key, "hospital_id").distinct().groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("hospital_id")), ",").alias("ids"), F.count(F.lit(1)).alias("n")).where("n >= 2")


MONTH = dt.datetime(1997, 3, 1)
_PERIODS = report_periods(MONTH)
_RANGE = {"now": ("1997-03-01", "1997-04-01", 31), "previous": ("1997-02-01", "1997-03-01", 28), "year_before": ("1996-03-01", "1996-04-01", 31)}
_IN = lambda k: f"created_at >= TIMESTAMP '{_RANGE[k][0]}' AND created_at < TIMESTAMP '{_RANGE[k][1]}'"
_SIDE = lambda k: f"SELECT '{k}' AS name, {_RANGE[k][2]} AS days, count(*) AS cases, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {r}" for r, c in RATES.items()) + f" FROM fact WHERE {_IN(k)}"
_KEYS = "tier_code, location_code"
_CODES = " UNION ALL ".join(f"SELECT {_KEYS}, '{k}' AS kind, CAST({c} AS VARCHAR) AS key, count(*) AS n FROM fact GROUP BY ALL" for k, c in {**PATTERN, "hour": "created_hour"}.items())
_FLAGS = " UNION ALL ".join(f"SELECT {_KEYS}, '{k}' AS kind, 'true' AS key, round(count(*) FILTER (WHERE {c})::DOUBLE / count(*), 6) AS p FROM fact GROUP BY 1, 2" for k, c in CLINICAL.items())
_LOG = "log AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey % 9 AS s, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END, 0) AS n_rows, o_orderkey % 7 AS bad FROM orders WHERE o_orderkey % 9 <> 2)"
QUERIES: dict[str, Pair] = {
    "report_periods": (lambda s, d: period_over_period(facts(s, d), _PERIODS), duck_with("x AS (" + " UNION ALL ".join(map(_SIDE, _RANGE)) + ")", "n AS (SELECT * FROM x WHERE name = 'now')") + "SELECT x.name, x.days, x.cases, round(x.cases::DOUBLE / x.days, 2) AS per_day, CASE WHEN x.cases > 0 THEN round(100 * (n.cases - x.cases)::DOUBLE / x.cases, 1) WHEN n.cases = 0 THEN 0 END AS change, " + ", ".join(f"round(100 * n.{k}::DOUBLE / n.cases - 100 * x.{k}::DOUBLE / x.cases, 1) AS {k}_points" for k in RATES) + " FROM x, n"),
    "report_tables": (lambda s, d: month_tables(facts(s, d), _PERIODS["now"]), duck_with("t AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({c} AS BIGINT) AS id, count(*) AS n FROM fact WHERE {_IN('now')} AND {c} IS NOT NULL GROUP BY 2" for k, c in (("department", "department_id"), ("indication", "indication_id"), ("origin", "dispatch_area_id"))) + ")") + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, id) AS INTEGER) AS position FROM t) WHERE position <= 5"),
    "report_days": (lambda s, d: month_days(facts(s, d), _PERIODS["now"]), duck_with("s AS (SELECT strftime(unnest(generate_series(DATE '1997-03-01', DATE '1997-03-31', INTERVAL 1 DAY)), '%Y-%m-%d') AS day)", f"c AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM fact WHERE {_IN('now')} GROUP BY 1)") + "SELECT day, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (day)"),
    "report_rejection_rates": (lambda s, d: rejection_rates(import_log(s, d)), f"WITH {_LOG}, m AS (SELECT month, count(*) AS imports, count(*) FILTER (WHERE s = 0) AS failed, CASE WHEN sum(n_rows) > 0 THEN 100 * sum(bad)::DOUBLE / sum(n_rows) ELSE 0 END AS r FROM log GROUP BY 1) SELECT month, imports, failed, round(r, 6) AS rate, round(r - lag(r) OVER (ORDER BY month), 6) AS points FROM m"),
    "report_imports_by_month": (lambda s, d: import_log(s, d).groupBy(F.substring("day", 1, 7).alias("month"), "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hospital_id").alias("hospitals")), "SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE o_orderkey % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'running' ELSE 'completed' END AS status, count(*) AS n, count(DISTINCT o_custkey % 10) AS hospitals FROM orders GROUP BY 1, 2"),
    "pattern": (lambda s, d: pattern(facts(s, d)), duck_with(f"c AS ({_CODES})", f"t AS (SELECT {_KEYS}, kind, sum(n) AS every, sum(n) FILTER (WHERE key IS NOT NULL) AS filled FROM c GROUP BY ALL)") + f"SELECT c.tier_code, c.location_code, c.kind, key, round(n::DOUBLE / filled, 6) AS p FROM c JOIN t ON c.kind = t.kind AND c.location_code = t.location_code AND c.tier_code IS NOT DISTINCT FROM t.tier_code WHERE key IS NOT NULL UNION ALL SELECT {_KEYS}, kind || '_present', 'true', round(coalesce(filled, 0)::DOUBLE / every, 6) FROM t UNION ALL {_FLAGS}"),
    "pattern_files": (lambda s, d: pattern_lines(pattern(facts(s, d))).select("name", F.md5(F.col("text").cast("binary")).alias("digest"), F.size(F.split("text", "\n")).alias("n_lines")), None),
    "map_features": (lambda s, d: map_features(facts(s, d).where("created_year = 1995 AND created_month = 1 AND department_id < 3")), duck_with("c AS (SELECT dispatch_area_id, count(*) AS n, count(*) FILTER (WHERE urgency_code = 1) AS u FROM fact WHERE created_year = 1995 AND created_month = 1 AND department_id < 3 GROUP BY 1)") + "SELECT dispatch_area_id, CASE WHEN n < 10 THEN 0 ELSE n END AS cases, CASE WHEN n < 10 THEN 0 ELSE u END AS urgent, n < 10 AS hidden FROM c"),
    **{f"hospital_ids_by_{n}": (lambda s, d, k=k: hospital_ids(facts(s, d), k), duck_with() + f"SELECT {k}, string_agg(CAST(hospital_id AS VARCHAR), ',' ORDER BY hospital_id) AS ids, count(*) AS n FROM (SELECT DISTINCT {k}, hospital_id FROM fact) GROUP BY 1 HAVING count(*) >= 2") for n, k in (("state", "state_id"), ("area", "dispatch_area_id"), ("tier", "tier_code"))},
}

_NAME = f"coalesce({S.coded('location_code', S.LOCATION)}, 'unknown') || '-' || coalesce({S.coded('tier_code', S.TIER)}, 'unknown')"
QUERIES["pattern_files"] = (QUERIES["pattern_files"][0], f"SELECT name, md5('format: distribution-pattern/v1' || chr(10) || 'values:' || chr(10) || string_agg('  ' || kind || '/' || key || ': ' || printf('%.6f', p), chr(10) ORDER BY kind, key)) AS digest, CAST(count(*) + 2 AS INTEGER) AS n_lines FROM (SELECT {_NAME} AS name, kind, key, p FROM ({QUERIES['pattern'][1]})) GROUP BY 1")
