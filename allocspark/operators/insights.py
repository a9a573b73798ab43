"""Insights: what stands out between two sides, by one table of rules for all pages.

A page's subjects (a hospital, an indication, a pair of them, two chosen sides) are measured
in one aggregation of the fact: counts for rates, and histograms for medians. Measures are
rows (subject, name, n1, total1, n2, total2), or (subject, name, n1, n2) for values; they
meet the page's rules by name, one expression evaluates each kind of rule, and windows rank
what is left of each subject. So all subjects of a page cost one pass over the fact.

Kinds: ``rate`` compares shares, ``dominance`` does where a share is large by itself,
``difference`` and ``quotient`` compare values, ``share``, ``excess`` and ``rise`` look at
one side beside a baseline. Ties of scores keep the order of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.histogram import counted, percentiles
from ..plans.sides import Side, by_side, masked
from ..sources.binding import duck_with, facts, hospitals
from .aggregates import Pair, count

#: What rates count: name and condition on the fact.
MEASURES = {
    "physician": "is_with_physician", "resus": "requires_resus", "cathlab": "requires_cathlab", "urgency_emergency": "urgency_code = 1",
    "age_80_plus": "age >= 80", "night_daytime": "day_time_code = 1", "weekend": "created_weekday IN (6, 7)", "infectious": "infection_id IS NOT NULL",
    "cpr": "is_cpr", "ventilation": "is_ventilated", "shock": "is_shock",
    "male": "gender_code = 1", "female": "gender_code = 2",
}
SIZES = {"total": "TRUE", "gendered": "gender_code IN (1, 2)"}

#: Rate, priority, least ratio, medically critical.
RATES = (
    ("physician", 100, 1.5, True),
    ("resus", 95, 1.5, True),
    ("cathlab", 90, 1.5, True),
    ("urgency_emergency", 85, 1.3, True),
    ("age_80_plus", 70, 1.5, False),
    ("night_daytime", 60, 1.5, False),
    ("weekend", 55, 1.3, False),
    ("infectious", 45, 1.5, False),
    ("cpr", 75, 1.5, False),
    ("ventilation", 72, 1.5, False),
    ("shock", 70, 1.5, False),
)


@dataclass(frozen=True)
class Rule:
    """kind, measure, priority (or the whole score of a value's insight), edge that must be reached, whether it is medically critical, and the insight's name."""

    kind: str
    measure: str
    priority: float
    edge: float
    critical: bool = False
    name: str = ""


@dataclass(frozen=True)
class Page:
    """Cases that either side needs, ratios that count as neutral, least difference of rates, whether low rates are told, insights shown, and when a neutral one is: never, always, or alone."""

    enough: tuple[int, int]
    neutral: tuple[float, float]
    delta: float
    low: bool
    shown: int
    neutral_shown: str
    rules: tuple[Rule, ...]
    age_ratio: str = "difference"


def _rates(*without: str) -> tuple[Rule, ...]:
    return tuple(Rule("rate", name, priority, edge, critical, name) for name, priority, edge, critical in RATES if name not in without)


def _medians(long: int, short: int) -> tuple[Rule, ...]:
    """Median ages ten years apart, median transport times by a fifth."""
    return (
        Rule("difference", "median_age", 65, -10, name="age_young"),
        Rule("difference", "median_age", 65, 10, name="age_old"),
        Rule("quotient", "median_minutes", long, 1.2, name="transport_time_long"),
        Rule("quotient", "median_minutes", short, 0.8, name="transport_time_short"),
    )


#: Fixed values of each page.
PAGES = {
    "benchmark": Page((100, 500), (0.90, 1.10), 0.03, True, 4, "never", _rates("infectious") + _medians(50, 45), age_ratio="ratio"),
    "indication": Page((30, 100), (0.85, 1.15), 0.0, False, 6, "always", (*_rates(), Rule("dominance", "male", 50, 0.65, name="gender_male_dominant"), Rule("dominance", "female", 50, 0.65, name="gender_female_dominant"), *_medians(40, 35))),
    "compare": Page((30, 30), (0.85, 1.15), 0.03, False, 4, "alone", _rates() + _medians(40, 35)),
    "case_flow_hospital": Page((30, 0), (1, 1), 0.0, False, 4, "never", (
        Rule("share", "regional", 1.0, 70, name="predominantly_regional"),
        Rule("excess", "full_tier", 1.5, 45, name="high_centralization"),
        Rule("rise", "mean_minutes", 50, 1.2, name="elevated_transport_time"),
        Rule("share", "urgent_origin", 1.2, 40, name="urgency_concentration_origin"),
    )),
}
PAGES["case_flow_system"] = Page((100, 0), *[getattr(PAGES["case_flow_hospital"], f) for f in ("neutral", "delta", "low", "shown", "neutral_shown", "rules")])
#: Least ratio of dominance; gendered cases that either side needs for it; a full tier's share over its baseline; emergencies of an origin that is named.
DOMINANT, GENDERED, CENTRAL, NAMED = 1.3, (10, 50), 1.3, 10
MEASURED = "subject string, name string, n1 double, total1 double, n2 double, total2 double, size1 long, size2 long"


def evaluated(measures: DataFrame, page: str) -> DataFrame:
    """subject, position, name, direction, severity, ratio, value1, value2 and score of a page's insights."""
    p = PAGES[page]
    rules = measures.sparkSession.createDataFrame([(r.kind, r.measure, float(r.priority), float(r.edge), r.critical, r.name, i) for i, r in enumerate(p.rules)], "kind string, measure string, priority double, edge double, critical boolean, insight string, at int")
    m = measures.where((F.col("size1") >= p.enough[0]) & (F.col("size2") >= p.enough[1])).withColumnRenamed("name", "measure").join(F.broadcast(rules), "measure")
    kind = lambda k: F.col("kind") == k
    rated = F.col("kind").isin("rate", "dominance", "share", "excess")
    part = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(F.lit(0.0))
    m = m.withColumns({"x": F.when(rated, part("n1", "total1")).otherwise(F.col("n1")), "y": F.when(rated, part("n2", "total2")).otherwise(F.col("n2"))}).withColumn("ratio", F.when(F.col("y") > 0, F.col("x") / F.col("y")))
    ratio, x, y, edge = (F.col(c) for c in ("ratio", "x", "y", "edge"))
    neutral = ratio.between(*p.neutral)
    apart = F.abs(x - y) >= p.delta
    inverse = y / F.greatest(x, F.lit(0.00001))
    below = (ratio < 1) & F.lit(p.low)
    percent = 100 * x
    gendered = (F.col("total1") >= GENDERED[0]) & (F.col("total2") >= GENDERED[1]) & ((F.col("measure") == "male") | (F.col("n2") < F.col("total2")))
    holds = (
        F.when(kind("rate"), F.when(neutral, (F.col("measure") == "physician") & F.lit(p.neutral_shown != "never")).otherwise(apart & F.when(below, inverse >= edge).otherwise(ratio >= edge)))
        .when(kind("dominance"), gendered & (x >= edge) & (ratio >= DOMINANT))
        .when(kind("difference"), F.when(edge < 0, x - y <= edge).otherwise(x - y >= edge) & (F.lit(p.age_ratio == "difference") | ((x > 0) & (y > 0))))
        .when(kind("quotient"), F.when(edge < 1, ratio <= edge).otherwise(ratio >= edge))
        .when(kind("share"), percent >= edge)
        .when(kind("excess"), (percent >= edge) & ((y <= 0) | (x >= CENTRAL * y)))
        .when(kind("rise"), ratio >= edge)
    )
    is_neutral = kind("rate") & neutral
    strength = F.least(F.when(below, inverse).otherwise(ratio), F.lit(5.0))
    score = (
        F.when(is_neutral, F.col("priority") * 0.5)
        .when(kind("rate"), F.col("priority") * strength * F.log(F.greatest("size1", F.lit(2)).cast("double")))
        .when(kind("dominance"), F.col("priority") * strength)
        .when(kind("share") | kind("excess"), percent * F.col("priority"))
        .when(kind("rise"), ratio * F.col("priority"))
        .otherwise(F.col("priority"))
    )
    high = F.when((ratio >= 2.5) | F.col("critical") & (ratio >= 2.0), "critical").when(ratio >= 1.5, "elevated").otherwise("neutral")
    low = F.when(ratio <= 0.5, "critical").when(ratio <= 0.8, "elevated").otherwise("neutral")
    severity = F.when(is_neutral, "neutral").when(kind("rate") & below, low).when(kind("rate") | kind("dominance"), high).when(F.col("measure") == "regional", "info").otherwise("elevated")
    years = F.when(F.lit(p.age_ratio == "ratio"), ratio).when(edge < 0, F.round(F.abs(x - y), 1)).otherwise(F.round((x - y) / F.greatest(y, F.lit(1.0)), 1))
    shown = F.when(kind("difference"), years).when(is_neutral, ratio if page == "indication" else F.round(ratio, 1)).otherwise(F.round(ratio, 1))
    low_ones = (kind("rate") & below) | (kind("difference") & (edge < 0)) | (kind("quotient") & (edge < 1))
    direction = F.when(is_neutral, "neutral").when(low_ones, "below").otherwise("above")
    value = lambda v: F.when(rated, F.round(100 * v, 1)).otherwise(F.round(v, 6))
    name = F.when(is_neutral, F.concat("insight", F.lit("_neutral"))).when(kind("rate") & below, F.concat("insight", F.lit("_low"))).otherwise(F.col("insight"))
    found = m.where(holds).select("subject", name.alias("name"), direction.alias("direction"), severity.alias("severity"), F.round(shown, 6).alias("ratio"), value(x).alias("value1"), value(y).alias("value2"), F.round(score).cast("int").alias("score"), is_neutral.alias("neutral"), "at")
    own = Window.partitionBy("subject")
    if p.neutral_shown == "alone":
        found = found.withColumn("others", F.max((~F.col("neutral")).cast("int")).over(own)).where("NOT neutral OR others = 0").drop("others")
    ranked = found.withColumn("position", F.row_number().over(own.orderBy(F.desc("score"), "at")))
    return ranked.where(F.col("position") <= p.shown).select("subject", "position", "name", "direction", "severity", "ratio", "value1", "value2", "score")


def counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: sizes and the counts of all measures."""
    return rows.groupBy(*keys).agg(*[F.expr(count(c)).alias(k) for k, c in (SIZES | MEASURES).items()])


def _long(wide: DataFrame, first: str, second: str) -> DataFrame:
    """Measures of rows with columns of both sides (prefixes): rates and medians."""
    size = lambda k, side: F.col(f"{side}{'gendered' if k in ('male', 'female') else 'total'}").cast("double")
    rates = [F.struct(F.lit(k).alias("name"), F.col(f"{first}{k}").cast("double").alias("n1"), size(k, first).alias("total1"), F.col(f"{second}{k}").cast("double").alias("n2"), size(k, second).alias("total2")) for k in MEASURES]
    none = F.lit(None).cast("double")
    values = [F.struct(F.lit(k).alias("name"), F.col(f"{first}{k}").alias("n1"), none.alias("total1"), F.col(f"{second}{k}").alias("n2"), none.alias("total2")) for k in ("median_age", "median_minutes")]
    return wide.select(F.col("subject").cast("string").alias("subject"), F.explode(F.array(*rates, *values)).alias("m"), F.col(f"{first}total").alias("size1"), F.col(f"{second}total").alias("size2")).select("subject", "m.*", "size1", "size2")


def _renamed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keep])


def _with_medians(sized: DataFrame, ages: DataFrame, minutes: DataFrame, keys: list[str]) -> DataFrame:
    for histogram, name in ((ages, "median_age"), (minutes, "median_minutes")):
        sized = sized.join(percentiles(histogram, keys, {name: 0.5}), keys, "left")
    return sized


def of_sides(rows: DataFrame, primary: Side, comparison: Side) -> DataFrame:
    """Measures of two sides of the fact; the only subject is ``sides``."""
    sides = {"a": primary, "b": comparison}
    live = masked(rows, sides)
    sized = by_side(counts(live, ["mask"]), sides, [], [*SIZES, *MEASURES])
    ages, minutes = (by_side(counted(live, ["mask"], c), sides, ["value"], ["n"]) for c in ("age", "minutes"))
    both = _with_medians(sized, ages, minutes, ["side"])
    a, b = (_renamed(both.where(F.col("side") == s).drop("side").withColumn("subject", F.lit("sides")), s, "subject") for s in sides)
    return _long(a.join(b, "subject"), "a", "b")


def of_subjects(rows: DataFrame, key: str) -> DataFrame:
    """Measures of each value of a key beside all other rows, null keys among them.

    The others' counts and histograms are those of all rows less the subject's own.
    """
    own = counts(rows, [key])
    whole = own.agg(*[F.sum(c).alias(f"all_{c}") for c in (SIZES | MEASURES)])
    subjects = own.where(F.col(key).isNotNull())
    ages, minutes = (counted(rows, [key], c) for c in ("age", "minutes"))

    def others(histogram: DataFrame) -> DataFrame:
        """Subjects x distinct values: both are few beside the rows, and don't grow with them."""
        every = subjects.select(key).join(histogram.groupBy("value").agg(F.sum("n").alias("all_n")))
        return every.join(histogram.where(F.col(key).isNotNull()), [key, "value"], "left").select(key, "value", (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"))

    mine = _with_medians(subjects, ages.where(F.col(key).isNotNull()), minutes.where(F.col(key).isNotNull()), [key])
    rest = subjects.join(whole).select(key, *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in (SIZES | MEASURES)])  # one row of sums
    rest = _with_medians(rest, others(ages), others(minutes), [key])
    named = lambda df, side: _renamed(df.withColumnRenamed(key, "subject"), side, "subject")
    return _long(named(mine, "a").join(named(rest, "b"), "subject"), "a", "b")


def of_pairs(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Measures of pairs (a, b) of a key's values; a pair's subject is a:b."""
    each = _with_medians(counts(rows.where(F.col(key).isNotNull()), [key]), *(counted(rows.where(F.col(key).isNotNull()), [key], c) for c in ("age", "minutes")), [key])
    a, b = (_renamed(each.withColumnRenamed(key, f"key_{s}"), s, f"key_{s}") for s in "ab")
    joined = pairs.select(F.col("a").alias("key_a"), F.col("b").alias("key_b")).join(a, "key_a").join(b, "key_b")
    return _long(joined.withColumn("subject", F.concat_ws(":", "key_a", "key_b")), "a", "b")


def of_case_flow(rows: DataFrame, homes: DataFrame, by_hospital: bool) -> DataFrame:
    """Measures of case flows, of each hospital or of the whole system, beside all cases: regional ones, those of full tier, mean minutes, and the first origin, by cases, that holds much of the emergencies.

    homes: hospital_id, area_id.
    """
    key = F.col("hospital_id").cast("string") if by_hospital else F.lit("system")
    per = rows.withColumn("subject", key).groupBy("subject", "hospital_id", "dispatch_area_id").agg(F.count(F.lit(1)).alias("n"), F.expr(count("tier_code = 3")).alias("full"), F.expr(count("urgency_code = 1")).alias("urgent"), F.count("minutes").alias("timed"), F.sum(F.col("minutes").cast("decimal(20,6)")).alias("minutes"))
    per = per.join(homes, "hospital_id", "left")
    sums = [F.sum("n").cast("double").alias("n"), F.sum("full").cast("double").alias("full"), (F.sum("minutes").cast("double") / F.sum("timed")).alias("mean")]
    whole = per.agg(*[c.alias(f"all_{k}") for k, c in zip(("n", "full", "mean"), sums, strict=True)])
    own = per.groupBy("subject").agg(*sums, F.sum(F.when(F.col("dispatch_area_id") == F.col("area_id"), F.col("n")).otherwise(0)).cast("double").alias("regional"), F.sum("urgent").cast("double").alias("urgent")).join(whole)  # one row
    origin = per.groupBy("subject", "dispatch_area_id").agg(F.sum("urgent").cast("double").alias("here"), F.sum("n").alias("cases")).where(F.col("here") >= NAMED)
    total = own.select("subject", "urgent")
    first = origin.join(total, "subject").where("100 * here / urgent >= 40").groupBy("subject").agg(F.max_by("here", F.struct("cases", -F.col("dispatch_area_id"))).alias("here"))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    cell = lambda name, n1, t1, n2, t2: F.struct(F.lit(name).alias("name"), n1.alias("n1"), t1.alias("total1"), n2.alias("n2"), t2.alias("total2"))
    cells = [
        cell("regional", F.col("regional"), F.col("n"), zero, zero), cell("full_tier", F.col("full"), F.col("n"), F.col("all_full"), F.col("all_n")),
        cell("mean_minutes", F.col("mean"), none, F.col("all_mean"), none), cell("urgent_origin", F.coalesce("here", zero), F.col("urgent"), zero, zero),
    ]
    return own.join(first, "subject", "left").select("subject", F.explode(F.array(*cells)).alias("m"), F.col("n").cast("long").alias("size1"), F.lit(0).cast("long").alias("size2")).select("subject", "m.*", "size1", "size2")


#: Sides that differ on purpose, so that insights are found.
OLD, YOUNG = Side(conditions=("age >= 60 AND urgency_code <= 2",)), Side(conditions=("age < 60 OR age IS NULL OR urgency_code = 3",))


def _pairs(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Each indication and the next one."""
    ids = rows.where("indication_id IS NOT NULL").select(F.col("indication_id").alias("a")).distinct()
    return ids.select("a", (F.col("a") + 1).alias("b"))


# --- the DuckDB side, written from the definitions of the pages and not from the tables above ---

_FLAGS = """is_with_physician AS physician, requires_resus AS resus, requires_cathlab AS cathlab, urgency_code = 1 AS emergency, age > 79 AS elderly,
  created_hour < 6 AS night, dayofweek(created_at) IN (0, 6) AS weekend, infection_id IS NOT NULL AS infectious, is_cpr AS cpr, is_ventilated AS ventilation, is_shock AS shock"""
_TAKEN = ("physician", "resus", "cathlab", "emergency", "elderly", "night", "weekend", "infectious", "cpr", "ventilation", "shock")
_SHOWN = {"emergency": "urgency_emergency", "elderly": "age_80_plus", "night": "night_daytime"}


def _side_sql(name: str, where: str, key: str) -> str:
    sums = ", ".join(f"count(*) FILTER (WHERE {f})::DOUBLE AS {f}" for f in _TAKEN)
    return f"{name} AS (SELECT {key} AS subject, count(*)::DOUBLE AS total, {sums}, count(*) FILTER (WHERE gender_code = 1)::DOUBLE AS male, count(*) FILTER (WHERE gender_code = 2)::DOUBLE AS female, quantile_cont(age, 0.5) AS years, quantile_cont(minutes, 0.5) AS mins FROM flagged{where} GROUP BY 1)"


def _candidates_sql(rate: str, values: str) -> str:
    """One row for each rate of joined sides a and b, then the rows of values."""
    weights = {"physician": (100, 1.5, 1), "resus": (95, 1.5, 1), "cathlab": (90, 1.5, 1), "emergency": (85, 1.3, 1), "elderly": (70, 1.5, 0), "night": (60, 1.5, 0), "weekend": (55, 1.3, 0), "infectious": (45, 1.5, 0), "cpr": (75, 1.5, 0), "ventilation": (72, 1.5, 0), "shock": (70, 1.5, 0)}
    rows = " UNION ALL ".join(f"SELECT a.subject, '{_SHOWN.get(f, f)}' AS id, {i} AS o, {w} AS w, {least} AS least_q, {c} = 1 AS crit, a.{f} / a.total AS x, b.{f} / b.total AS y, a.total AS t FROM a JOIN b ON a.subject = b.subject WHERE {rate}" for i, (f, (w, least, c)) in enumerate(weights.items()))
    return f"r AS ({rows}), q AS (SELECT *, x / y AS q FROM r WHERE y > 0), v AS ({values})"


_HIGH = "CASE WHEN q >= 2.5 OR (crit AND q >= 2) THEN 'critical' WHEN q >= 1.5 THEN 'elevated' ELSE 'neutral' END"
_RATE = "subject, id AS name, 'above' AS direction, " + _HIGH + " AS severity, round(q, 1) AS ratio, round(100 * x, 1) AS value1, round(100 * y, 1) AS value2, CAST(round(w * least(q, 5) * ln(greatest(t, 2))) AS INTEGER) AS score, o"
_VALUE = "subject, {name} AS name, {direction} AS direction, 'elevated' AS severity, {ratio} AS ratio, round({v}, 6) AS value1, round({u}, 6) AS value2, {score} AS score, {o} AS o"


def _values_sql(long: int, short: int, age: str, positive: str) -> str:
    """Ages and minutes of joined sides a and b."""
    base = "FROM a JOIN b ON a.subject = b.subject WHERE a.total >= {n1} AND b.total >= {n2} AND "
    one = lambda cond, **k: "SELECT a.subject AS subject, " + _VALUE.format(**k)[len("subject, ") :] + " " + base + cond
    return " UNION ALL ".join((
        one(f"a.years - b.years <= -10{positive}", name="'age_young'", direction="'below'", ratio=age.split("|")[0], v="a.years", u="b.years", score=65, o=20),
        one(f"a.years - b.years >= 10{positive}", name="'age_old'", direction="'above'", ratio=age.split("|")[1], v="a.years", u="b.years", score=65, o=21),
        one("b.mins > 0 AND a.mins / b.mins >= 1.2", name="'transport_time_long'", direction="'above'", ratio="round(a.mins / b.mins, 1)", v="a.mins", u="b.mins", score=long, o=22),
        one("b.mins > 0 AND a.mins / b.mins <= 0.8", name="'transport_time_short'", direction="'below'", ratio="round(a.mins / b.mins, 1)", v="a.mins", u="b.mins", score=short, o=23),
    ))


_APART = "round(b.years - a.years, 1)|round((a.years - b.years) / greatest(b.years, 1), 1)"
_RATIO = "round(a.years / b.years, 6)|round(a.years / b.years, 6)"
_TOP = "SELECT subject, CAST(p AS INTEGER) AS position, name, direction, severity, round(ratio, 6) AS ratio, value1, value2, score FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, o) AS p FROM f) WHERE p <= {shown}"
_FLAGGED = f"flagged AS (SELECT *, {_FLAGS} FROM fact)"


def benchmark_sql() -> str:
    sides = (_side_sql("a", " WHERE age >= 60 AND urgency_code <= 2", "'sides'"), _side_sql("b", " WHERE age < 60 OR age IS NULL OR urgency_code = 3", "'sides'"))
    low = "SELECT subject, id || '_low' AS name, 'below' AS direction, CASE WHEN q <= 0.5 THEN 'critical' WHEN q <= 0.8 THEN 'elevated' ELSE 'neutral' END AS severity, round(q, 1) AS ratio, round(100 * x, 1) AS value1, round(100 * y, 1) AS value2, CAST(round(w * least(y / greatest(x, 0.00001), 5) * ln(greatest(t, 2))) AS INTEGER) AS score, o FROM q WHERE q < 0.9 AND y - x >= 0.03 AND y / greatest(x, 0.00001) >= least_q"
    found = f"f AS (SELECT {_RATE} FROM q WHERE q > 1.1 AND x - y >= 0.03 AND q >= least_q UNION ALL {low} UNION ALL SELECT * FROM v)"
    rates = _candidates_sql("a.total >= 100 AND b.total >= 500", _values_sql(50, 45, _RATIO, " AND a.years > 0 AND b.years > 0").replace("{n1}", "100").replace("{n2}", "500"))
    return duck_with(_FLAGGED, *sides, rates.replace("q AS (SELECT *, x / y AS q FROM r WHERE y > 0)", "q AS (SELECT *, x / y AS q FROM r WHERE y > 0 AND id <> 'infectious')"), found) + _TOP.format(shown=4)


def _indication_sql() -> str:
    known = "FROM a JOIN b ON a.subject = b.subject WHERE a.total >= 30 AND b.total >= 100 AND a.male + a.female >= 10 AND b.male + b.female >= 50 AND b.male > 0 AND b.female > 0"
    dominant = " UNION ALL ".join(f"SELECT subject, 'gender_{g}_dominant' AS name, 'above' AS direction, CASE WHEN q >= 2.5 THEN 'critical' WHEN q >= 1.5 THEN 'elevated' ELSE 'neutral' END AS severity, round(q, 1) AS ratio, round(100 * x, 1) AS value1, round(100 * y, 1) AS value2, CAST(round(50 * least(q, 5)) AS INTEGER) AS score, {o} AS o FROM (SELECT a.subject, a.{g} / (a.male + a.female) AS x, b.{g} / (b.male + b.female) AS y, a.{g} / (a.male + a.female) / (b.{g} / (b.male + b.female)) AS q {known}) WHERE x >= 0.65 AND q >= 1.3" for g, o in (("male", 12), ("female", 13)))
    neutral = "SELECT subject, 'physician_neutral' AS name, 'neutral' AS direction, 'neutral' AS severity, q AS ratio, round(100 * x, 1) AS value1, round(100 * y, 1) AS value2, 50 AS score, o FROM q WHERE id = 'physician' AND q BETWEEN 0.85 AND 1.15"
    pairs = "i AS (SELECT DISTINCT indication_id AS k FROM fact WHERE indication_id IS NOT NULL)"
    sums = ", ".join(f"count(*) FILTER (WHERE {f})::DOUBLE AS {f}" for f in _TAKEN)
    rest = f"b AS (SELECT CAST(k AS VARCHAR) AS subject, count(*)::DOUBLE AS total, {sums}, count(*) FILTER (WHERE gender_code = 1)::DOUBLE AS male, count(*) FILTER (WHERE gender_code = 2)::DOUBLE AS female, quantile_cont(age, 0.5) AS years, quantile_cont(minutes, 0.5) AS mins FROM i JOIN flagged ON indication_id IS DISTINCT FROM k GROUP BY 1)"
    found = f"f AS (SELECT {_RATE} FROM q WHERE NOT q BETWEEN 0.85 AND 1.15 AND q >= least_q UNION ALL {neutral} UNION ALL {dominant} UNION ALL SELECT * FROM v)"
    return duck_with(_FLAGGED, pairs, _side_sql("a", " WHERE indication_id IS NOT NULL", "CAST(indication_id AS VARCHAR)"), rest, _candidates_sql("a.total >= 30 AND b.total >= 100", _values_sql(40, 35, _APART, "").replace("{n1}", "30").replace("{n2}", "100")), found) + _TOP.format(shown=6)


def _compare_sql() -> str:
    shift = "a AS (SELECT s.* REPLACE (s.subject || ':' || (CAST(s.subject AS BIGINT) + 1) AS subject) FROM s), b AS (SELECT s.* REPLACE ((CAST(s.subject AS BIGINT) - 1) || ':' || s.subject AS subject) FROM s)"
    neutral = "SELECT subject, 'physician_neutral' AS name, 'neutral' AS direction, 'neutral' AS severity, round(q, 1) AS ratio, round(100 * x, 1) AS value1, round(100 * y, 1) AS value2, 50 AS score, o FROM q WHERE id = 'physician' AND q BETWEEN 0.85 AND 1.15"
    found = f"g AS (SELECT {_RATE} FROM q WHERE NOT q BETWEEN 0.85 AND 1.15 AND abs(x - y) >= 0.03 AND q >= least_q UNION ALL SELECT * FROM v), f AS (SELECT * FROM g UNION ALL SELECT * FROM ({neutral}) WHERE subject NOT IN (SELECT subject FROM g))"
    return duck_with(_FLAGGED, _side_sql("s", " WHERE indication_id IS NOT NULL", "CAST(indication_id AS VARCHAR)"), shift, _candidates_sql("a.total >= 30 AND b.total >= 30", _values_sql(40, 35, _APART, "").replace("{n1}", "30").replace("{n2}", "30")), found) + _TOP.format(shown=4)


def _case_flow_sql(subject: str, least: int) -> str:
    d = "CAST(minutes AS DECIMAL(20,6))"
    return duck_with(
        f"c AS (SELECT {subject} AS subject, f.*, h.area_id FROM fact f LEFT JOIN hospital h USING (hospital_id))",
        f"s AS (SELECT subject, count(*)::DOUBLE AS n, 100 * count(*) FILTER (WHERE dispatch_area_id = area_id)::DOUBLE / count(*) AS regional, 100 * count(*) FILTER (WHERE tier_code = 3)::DOUBLE / count(*) AS central, sum({d})::DOUBLE / count(minutes) AS mean, count(*) FILTER (WHERE urgency_code = 1)::DOUBLE AS urgent FROM c GROUP BY 1 HAVING count(*) >= {least})",
        f"z AS (SELECT 100 * count(*) FILTER (WHERE tier_code = 3)::DOUBLE / count(*) AS central, sum({d})::DOUBLE / count(minutes) AS mean FROM fact)",
        "o AS (SELECT subject, dispatch_area_id, count(*) AS cases, count(*) FILTER (WHERE urgency_code = 1)::DOUBLE AS here FROM c GROUP BY 1, 2)",
        "p AS (SELECT subject, 100 * here / urgent AS origin FROM (SELECT o.*, urgent, row_number() OVER (PARTITION BY o.subject ORDER BY cases DESC, dispatch_area_id) AS r FROM o JOIN s USING (subject) WHERE here >= 10 AND 100 * here / urgent >= 40) WHERE r = 1)",
        "f AS (SELECT subject, 'predominantly_regional' AS name, 'above' AS direction, 'info' AS severity, NULL::DOUBLE AS ratio, round(regional, 1) AS value1, 0.0::DOUBLE AS value2, CAST(round(regional) AS INTEGER) AS score, 0 AS o FROM s WHERE regional >= 70 UNION ALL SELECT subject, 'high_centralization', 'above', 'elevated', CASE WHEN z.central > 0 THEN round(s.central / z.central, 1) END, round(s.central, 1), round(z.central, 1), CAST(round(1.5 * s.central) AS INTEGER), 1 FROM s, z WHERE s.central >= 45 AND (z.central <= 0 OR s.central >= 1.3 * z.central) UNION ALL SELECT subject, 'elevated_transport_time', 'above', 'elevated', round(s.mean / z.mean, 1), round(s.mean, 6), round(z.mean, 6), CAST(round(50 * s.mean / z.mean) AS INTEGER), 2 FROM s, z WHERE z.mean > 0 AND s.mean >= 1.2 * z.mean UNION ALL SELECT subject, 'urgency_concentration_origin', 'above', 'elevated', NULL, round(origin, 1), 0.0, CAST(round(1.2 * origin) AS INTEGER), 3 FROM p)",
    ) + _TOP.format(shown=4)


QUERIES: dict[str, Pair] = {
    "insights_benchmark": (lambda s, d: evaluated(of_sides(facts(s, d), OLD, YOUNG), "benchmark"), benchmark_sql()),
    "insights_indications": (lambda s, d: evaluated(of_subjects(facts(s, d), "indication_id"), "indication"), _indication_sql()),
    "insights_compare": (lambda s, d: evaluated(of_pairs(facts(s, d), "indication_id", _pairs(s, facts(s, d))), "compare"), _compare_sql()),
    "insights_case_flow_hospitals": (lambda s, d: evaluated(of_case_flow(facts(s, d), hospitals(s, d).select("hospital_id", "area_id"), True), "case_flow_hospital"), _case_flow_sql("CAST(f.hospital_id AS VARCHAR)", 30)),
    "insights_case_flow_system": (lambda s, d: evaluated(of_case_flow(facts(s, d), hospitals(s, d).select("hospital_id", "area_id"), False), "case_flow_system"), _case_flow_sql("'system'", 100)),
}
