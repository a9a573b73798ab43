"""What follows from two sides' counts: shares, deltas and ratios, heat maps of differences, indication mixes, and ranked insights.

Facts are aggregated in one pass; all arithmetic is on the few rows that come of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.binding import duck_with, facts
from .aggregates import CLINICAL, COMPARISON, NIGHT, PRIMARY, WEEKEND, Pair, count
from .insights import OLD, YOUNG, benchmark_sql, evaluated, of_sides

#: Cases under which ratios are withheld, and under which a side is insufficient (first, second side).
RATIO_CASES, ENOUGH = 20, (100, 500)

def two_sides(rows: DataFrame, primary: str, comparison: str, conditions: dict[str, str]) -> DataFrame:
    """name, n1, total1, n2, total2 of each condition, from one aggregation."""
    both = {f"{k}_{s}": F.expr(count(f"({c}) AND ({side})")) for s, side in ((1, primary), (2, comparison)) for k, c in {"total": "TRUE", **conditions}.items()}
    one = rows.where(f"({primary}) OR ({comparison})").agg(*[v.alias(k) for k, v in both.items()])
    cells = ", ".join(f"'{k}', {k}_1, total_1, {k}_2, total_2" for k in conditions)
    return one.select(F.expr(f"stack({len(conditions)}, {cells}) AS (name, n1, total1, n2, total2)"))


def share(n: Column, total: Column) -> Column:
    """Percent, 0 of nothing."""
    return F.when(total > 0, 100 * n.cast("double") / total).otherwise(F.lit(0.0))


def compared(sides: DataFrame) -> DataFrame:
    """Shares of both sides, their difference, difference in percent and ratio (0 without a comparison); null where a side has too few cases for ratios."""
    s = sides.withColumns({"share1": share(F.col("n1"), F.col("total1")), "share2": share(F.col("n2"), F.col("total2"))})
    shown = (F.col("total1") >= RATIO_CASES) & (F.col("total2") >= RATIO_CASES)
    over = lambda x: F.when(F.col("share2") > 0, x).otherwise(F.lit(0.0))
    return s.select("name", "n1", "n2", F.round("share1", 6).alias("share1"), F.round("share2", 6).alias("share2"), F.round(F.col("share1") - F.col("share2"), 6).alias("delta"), F.when(shown, F.round(over(100 * (F.col("share1") - F.col("share2")) / F.col("share2")), 6)).alias("relative"), F.when(shown, F.round(over(F.col("share1") / F.col("share2")), 6)).alias("ratio"), ((F.col("total1") < ENOUGH[0]) | (F.col("total2") < ENOUGH[1])).alias("insufficient"))


def delta_heatmap(rows: DataFrame, primary: str, comparison: str, column: str, codes: tuple[int, ...]) -> DataFrame:
    """Each weekday's and bucket's shares (one decimal) of both sides and their difference; cells without cases are there."""
    live = rows.where(f"({primary}) OR ({comparison})")
    cells = live.groupBy(F.col("created_weekday").cast("int").alias("weekday"), F.col(column).cast("int").alias("code")).agg(F.expr(count(primary)).alias("n1"), F.expr(count(comparison)).alias("n2"))
    total = cells.agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    spine = live.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("weekday"), F.explode(F.array(*[F.lit(c) for c in codes])).alias("code"))
    full = spine.join(cells, ["weekday", "code"], "left").na.fill(0, ["n1", "n2"]).crossJoin(total)  # one row of totals
    out = full.select("weekday", "code", F.round(share(F.col("n1"), F.col("t1")), 1).alias("share1"), F.round(share(F.col("n2"), F.col("t2")), 1).alias("share2"))
    return out.withColumn("delta", F.round(F.col("share1") - F.col("share2"), 1))


def insights(sides: DataFrame) -> DataFrame:
    """What stands out most between two sides, rates only, of rows (name, n1, total1, n2, total2): see ``insights.evaluated``, which takes medians too."""
    measures = sides.select(F.lit("sides").alias("subject"), "name", *[F.col(c).cast("double").alias(c) for c in ("n1", "total1", "n2", "total2")], F.col("total1").alias("size1"), F.col("total2").alias("size2"))
    return ranked(measures)


def ranked(measures: DataFrame) -> DataFrame:
    """The insights of the benchmark page's only subject."""
    return evaluated(measures, "benchmark").select("name", "direction", "severity", "ratio", F.col("value1").alias("rate1"), F.col("value2").alias("rate2"), "score")


def mix_lists(rows: DataFrame, primary: str, comparison: str) -> DataFrame:
    """Indications with enough cases on both sides whose shares differ: the ten of largest ratio from 1.1 on, and of those up to 0.9 the ten that come first in falling order, shown rising."""
    from pyspark.sql import Window

    n = rows.where(f"({primary}) OR ({comparison})").groupBy("indication_id").agg(F.expr(count(primary)).alias("n1"), F.expr(count(comparison)).alias("n2"))
    total = n.agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    kept = n.where("indication_id IS NOT NULL AND n1 >= 20 AND n2 >= 50").crossJoin(total).select("indication_id", ((F.col("n1").cast("double") / F.col("t1")) / (F.col("n2").cast("double") / F.col("t2"))).alias("ratio"))
    side = F.when(F.col("ratio") >= 1.1, "over").when(F.col("ratio") <= 0.9, "under")
    ranked = kept.withColumn("list", side).where("list IS NOT NULL").withColumn("at", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("ratio"), "indication_id"))).where("at <= 10")
    back = F.row_number().over(Window.partitionBy("list").orderBy("ratio", "indication_id"))
    return ranked.withColumn("rising", back).select("list", F.when(F.col("list") == "over", F.col("at")).otherwise(F.col("rising")).alias("position"), "indication_id", F.round("ratio", 6).alias("ratio"))


def profile_shares(rows: DataFrame) -> DataFrame:
    """Each transport-time bucket beside all: percent of physicians, difference in points, small samples, and a class of heat from 0 to 4 by the size of the difference."""
    bucket = F.expr(S.minute_buckets())
    n = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.expr(count("is_with_physician")).alias("with_physician"))
    known = n.where(f"bucket <> '{S.UNKNOWN}'")
    total = known.agg(F.sum("n").alias("t"), F.sum("with_physician").alias("tp"))
    s = known.crossJoin(total).select("bucket", "n", F.round(share(F.col("with_physician"), F.col("n")), 1).alias("percent"), F.round(share(F.col("tp"), F.col("t")), 1).alias("of_all"))
    s = s.withColumn("delta", F.round(F.col("percent") - F.col("of_all"), 1)).withColumn("small", F.col("n") < 10)
    heat = F.expr("CASE WHEN abs(delta) < 1 THEN 0 WHEN abs(delta) < 3 THEN 1 WHEN abs(delta) < 5 THEN 2 WHEN abs(delta) < 10 THEN 3 ELSE 4 END")
    return s.withColumn("heat", F.when(F.col("small"), F.lit(0)).otherwise(heat))


SIDES = {"resus": CLINICAL["resus"], "cpr": CLINICAL["cpr"], "night": NIGHT, "weekend": WEEKEND, "urgent": "urgency_code = 1", "shock": CLINICAL["shock"]}
FEW = "hospital_id = 3 AND created_year = 1995 AND created_month = 1 AND department_id = 4"


def _sides_sql(primary: str, comparison: str, conditions: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE p AND ({c})) AS n1, count(*) FILTER (WHERE p) AS total1, count(*) FILTER (WHERE q AND ({c})) AS n2, count(*) FILTER (WHERE q) AS total2 FROM x" for k, c in conditions.items())
    return f"x AS (SELECT *, coalesce({primary}, FALSE) AS p, coalesce({comparison}, FALSE) AS q FROM fact), sides AS ({parts})"


def _compared_sql(primary: str, comparison: str) -> str:
    return duck_with(_sides_sql(primary, comparison, SIDES), "r AS (SELECT *, CASE WHEN total1 > 0 THEN 100 * n1::DOUBLE / total1 ELSE 0 END AS a, CASE WHEN total2 > 0 THEN 100 * n2::DOUBLE / total2 ELSE 0 END AS b, total1 < 20 OR total2 < 20 AS few FROM sides)") + "SELECT name, n1, n2, round(a, 6) AS share1, round(b, 6) AS share2, round(a - b, 6) AS delta, CASE WHEN few THEN NULL WHEN b > 0 THEN round((a - b) / b * 100, 6) ELSE 0 END AS relative, CASE WHEN few THEN NULL WHEN b > 0 THEN round(a / b, 6) ELSE 0 END AS ratio, total1 < 100 OR total2 < 500 AS insufficient FROM r"


def _heat_sql(column: str, last: int) -> str:
    return duck_with("s AS (SELECT unnest(range(1, 8)) AS weekday)", f"c AS (SELECT unnest(range(1, {last + 1})) AS code)", f"n AS (SELECT created_weekday AS weekday, {column} AS code, count(*) FILTER (WHERE {PRIMARY}) AS n1, count(*) FILTER (WHERE {COMPARISON}) AS n2 FROM fact GROUP BY 1, 2)", "t AS (SELECT sum(n1) AS t1, sum(n2) AS t2 FROM n)", "h AS (SELECT s.weekday, c.code, round(100 * coalesce(n1, 0)::DOUBLE / t1, 1) AS share1, round(100 * coalesce(n2, 0)::DOUBLE / t2, 1) AS share2 FROM s CROSS JOIN c CROSS JOIN t LEFT JOIN n ON n.weekday = s.weekday AND n.code = c.code)") + "SELECT CAST(weekday AS INTEGER) AS weekday, CAST(code AS INTEGER) AS code, share1, share2, round(share1 - share2, 1) AS delta FROM h"


_MIX = ("hospital_id % 3 = 0", "hospital_id % 3 <> 0")
QUERIES: dict[str, Pair] = {
    "benchmark_compared": (lambda s, d: compared(two_sides(facts(s, d), PRIMARY, COMPARISON, SIDES)), _compared_sql(PRIMARY, COMPARISON)),
    "benchmark_compared_few": (lambda s, d: compared(two_sides(facts(s, d), FEW, COMPARISON, SIDES)), _compared_sql(FEW, COMPARISON)),
    "benchmark_heat_day_time": (lambda s, d: delta_heatmap(facts(s, d), PRIMARY, COMPARISON, "day_time_code", (1, 2, 3, 4)), _heat_sql("day_time_code", 4)),
    "benchmark_heat_shift": (lambda s, d: delta_heatmap(facts(s, d), PRIMARY, COMPARISON, "shift_code", (1, 2, 3)), _heat_sql("shift_code", 3)),
    "benchmark_insights": (
        lambda s, d: ranked(of_sides(facts(s, d), OLD, YOUNG)),
        f"SELECT name, direction, severity, ratio, value1 AS rate1, value2 AS rate2, score FROM ({benchmark_sql()})",
    ),
    "benchmark_mix_lists": (lambda s, d: mix_lists(facts(s, d), *_MIX), duck_with(f"n AS (SELECT indication_id, count(*) FILTER (WHERE {_MIX[0]}) AS n1, count(*) FILTER (WHERE {_MIX[1]}) AS n2 FROM fact GROUP BY 1)", "r AS (SELECT indication_id, (n1::DOUBLE / (SELECT sum(n1) FROM n)) / (n2::DOUBLE / (SELECT sum(n2) FROM n)) AS q FROM n WHERE indication_id IS NOT NULL AND n1 >= 20 AND n2 >= 50)", "o AS (SELECT 'over' AS list, * FROM r WHERE q >= 1.1 ORDER BY q DESC, indication_id LIMIT 10)", "u AS (SELECT 'under' AS list, * FROM r WHERE q <= 0.9 ORDER BY q DESC, indication_id LIMIT 10)") + "SELECT list, CAST(row_number() OVER (ORDER BY q DESC, indication_id) AS INTEGER) AS position, indication_id, round(q, 6) AS ratio FROM o UNION ALL SELECT list, CAST(row_number() OVER (ORDER BY q, indication_id) AS INTEGER), indication_id, round(q, 6) FROM u"),
    "profile_shares": (lambda s, d: profile_shares(facts(s, d)), duck_with(f"b AS (SELECT {S.minute_buckets()} AS bucket, is_with_physician AS p FROM fact)", "n AS (SELECT bucket, count(*) AS n, count(*) FILTER (WHERE p) AS w FROM b WHERE bucket <> 'unknown' GROUP BY 1)", "x AS (SELECT bucket, n, round(100 * w::DOUBLE / n, 1) AS percent, round(100 * (SELECT sum(w) FROM n)::DOUBLE / (SELECT sum(n) FROM n), 1) AS of_all FROM n)", "y AS (SELECT *, round(percent - of_all, 1) AS delta, n < 10 AS small FROM x)") + "SELECT *, CASE WHEN small OR abs(delta) < 1 THEN 0 WHEN abs(delta) < 3 THEN 1 WHEN abs(delta) < 5 THEN 2 WHEN abs(delta) < 10 THEN 3 ELSE 4 END AS heat FROM y"),
}
