"""Usage analytics over the event log: sessions, transitions, funnels, retention.

A session is one user's day, a route an event type, ``value`` the duration, ``props`` JSON.
``NOW`` is a parameter of every query that looks back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .aggregates import Pair

NOW = "2024-01-20 00:00:00"
_STAMP = f"CAST('{NOW}' AS TIMESTAMP_NTZ)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumn("session", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd"))).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


DUCK = "WITH log AS (SELECT *, concat_ws('-', user_id, strftime(ts, '%Y-%m-%d')) AS session, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def recent(spark: SparkSession, d: str) -> DataFrame:
    """Requests and distinct users of the last day, week and month. A row for each session, then for each user: no row is copied for the distinct counts."""
    age = F.expr(f"ceil(timestampdiff(MICROSECOND, ts, {_STAMP}) / 1000000D)") / 86400  # whole seconds of the clock, so parts of ts's second count
    rows = log(spark, d).withColumn("age", age).where("age > 0 AND age <= 30")
    per = rows.groupBy("user_id", "session").agg(F.min("age").alias("age"), *[F.count_if(F.col("age") <= n).alias(f"r{n}") for n in (1, 7, 30)])
    users = per.groupBy("user_id").agg(F.min("age").alias("age"), *[F.sum(f"r{n}").alias(f"r{n}") for n in (1, 7, 30)], F.count_if(F.col("age") <= 7).alias("s7"))
    return users.agg(*[F.sum(f"r{n}").alias(f"requests_{n}d") for n in (1, 7, 30)], *[F.count_if(F.col("age") <= n).alias(f"users_{n}d") for n in (1, 7, 30)], F.sum("s7").alias("sessions_7d"))


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Requests, users, mean and 95th percentile of durations, and error rate of each route."""
    return log(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"), F.expr("round(percentile(value, 0.95), 6)").alias("p95"), F.round(F.avg(F.col("k") % 13), 6).alias("mean_queries"), F.expr("round(CAST(100 AS DOUBLE) * count(CASE WHEN k < 5 THEN 1 END) / count(*), 6)").alias("error_rate"))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Steps from one route to another within a session; staying on a route is none."""
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    steps = log(spark, d).select(F.col("event_type").alias("origin"), F.lead("event_type").over(w).alias("target"))
    return steps.where("target IS NOT NULL AND target <> origin").groupBy("origin", "target").agg(F.count(F.lit(1)).alias("n"))


def ends(spark: SparkSession, d: str) -> DataFrame:
    """First and last routes of sessions."""
    key = F.struct("ts", "event_id")
    s = log(spark, d).groupBy("session").agg(F.min_by("event_type", key).alias("entry"), F.max_by("event_type", key).alias("exit"))
    return s.select(F.expr("stack(2, 'entry', entry, 'exit', exit) AS (kind, event_type)")).groupBy("kind", "event_type").agg(F.count(F.lit(1)).alias("n"))


def parameters(spark: SparkSession, d: str) -> DataFrame:
    """Names used in the JSON properties."""
    names = F.explode(F.expr("json_object_keys(props)"))
    return log(spark, d).select(names.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def filter_share(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("event_type").agg(F.expr("count(CASE WHEN k >= 50 THEN 1 END)").alias("with_filter"), F.expr("count(CASE WHEN k < 50 THEN 1 END)").alias("without_filter"))


def slowest(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).where("n >= 10")


def depth(spark: SparkSession, d: str) -> DataFrame:
    """Users by the deepest level that they reached."""
    level = F.expr("CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END")
    return log(spark, d).groupBy("user_id").agg(F.max(level).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("users"))


def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users of each step and the share of the step before; steps need no order in time. A row for each user comes first."""
    least = log(spark, d).groupBy("user_id").agg(F.min("k").alias("k"))
    n = least.agg(*[F.count_if(F.col("k") < b).alias(f"s{i}") for i, b in enumerate((60, 40, 10), 1)])
    long = n.select(F.expr("stack(3, 1, s1, CAST(NULL AS BIGINT), 2, s2, s1, 3, s3, s2) AS (step, users, previous)"))
    return long.select("step", "users", F.when(F.col("previous") > 0, F.round(100 * F.col("users").cast("double") / F.col("previous"), 2)).alias("conversion"))


#: Bound columns: a user's role, an area, and JSON of used filters (arrays, other JSON, and none).
ROLE = "CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' WHEN 2 THEN 'user' END"
AREA = "CASE WHEN event_type IN ('view', 'click') THEN 'explore' WHEN event_type = 'error' THEN 'system' ELSE 'account' END"
FILTERS = """CASE k % 5 WHEN 0 THEN '["age","gender"]' WHEN 1 THEN '["age"]' WHEN 2 THEN '[]' WHEN 3 THEN '{"age":1}' END"""


def bound(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).withColumns({"role": F.expr(ROLE), "area": F.expr(AREA), "filters": F.expr(FILTERS)})


def areas(spark: SparkSession, d: str) -> DataFrame:
    """Requests by area, by signed-in or not, and by both role and area, from one pass."""
    rows = bound(spark, d).withColumn("signed_in", F.col("role").isNotNull())
    return rows.groupingSets([["area"], ["signed_in"], ["role", "area"]], "area", "signed_in", "role").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def used_filters(spark: SparkSession, d: str) -> DataFrame:
    """Names in the arrays of used filters; other JSON has none."""
    known = F.when(F.col("filters").startswith("["), F.from_json("filters", "array<string>"))
    return bound(spark, d).select(F.explode(known).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def filtered_share(spark: SparkSession, d: str) -> DataFrame:
    """By area, requests with any filter and without."""
    n = F.size(F.coalesce(F.when(F.col("filters").startswith("["), F.from_json("filters", "array<string>")), F.array().cast("array<string>")))
    return bound(spark, d).groupBy("area").agg(F.count_if(n > 0).alias("with_filter"), F.count_if(n == 0).alias("without_filter"))


def depth_of_both(spark: SparkSession, d: str) -> DataFrame:
    """Users by the deepest level that they reached in either of two logs."""
    rows = bound(spark, d)
    pages = rows.where("k < 50").select("user_id", F.expr("CASE area WHEN 'explore' THEN 2 ELSE 1 END").alias("level"))
    events = rows.where("k >= 50").select("user_id", F.expr("CASE event_type WHEN 'purchase' THEN 3 ELSE 2 END").alias("level"))
    return pages.unionByName(events).groupBy("user_id").agg(F.max("level").alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("users"))


def top_events(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    """The most frequent events, their users, and how often each role (from the JSON context) had them."""
    context = F.to_json(F.struct(F.col("role").alias("user_role")))
    rows = bound(spark, d).withColumn("user_role", F.coalesce(F.get_json_object(context, "$.user_role"), F.lit("anonymous")))
    per = rows.groupBy("event_type", "user_id", "user_role").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("event_type").agg(F.sum("n").alias("n"), F.countDistinct("user_id").alias("users"), *[F.sum(F.when(F.col("user_role") == r, F.col("n")).otherwise(0)).alias(f"by_{r}") for r in ("admin", "editor", "user", "anonymous")])
    return out.orderBy(F.desc("n"), "event_type").limit(k)


def time_to_target(spark: SparkSession, d: str) -> DataFrame:
    """Median days from a user's first event to the first target at or after it."""
    per = log(spark, d).groupBy("user_id").agg(F.min("ts").alias("first"), F.min(F.when(F.col("k") >= 95, F.col("ts"))).alias("target")).where("target >= first")
    return per.agg(F.count(F.lit(1)).alias("users"), F.expr("round(percentile(timestampdiff(SECOND, first, target) / 86400D, 0.5), 1)").alias("median_days"))


def daily(spark: SparkSession, d: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A dense series of days: requests and the running total of seven days (those before the first day count), zero where nothing happened. Without a range, from the first event's day to the last one's."""
    counts = log(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.coalesce(F.lit(first).cast("date"), F.min("day")).alias("a"), F.coalesce(F.lit(last).cast("date"), F.max("day")).alias("z")).where("a <= z")
    spine = ends.select("a", F.explode(F.sequence(F.date_sub("a", 6), "z")).alias("day"))
    dense = spine.join(counts, "day", "left").select("a", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    week = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(-6, 0)
    return dense.withColumn("week", F.sum("n").over(week)).where("day >= a").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "week")


_BOUND = f"{DUCK}, b AS (SELECT *, {ROLE} AS role, {AREA} AS area, {FILTERS} AS filters FROM log)"
QUERIES: dict[str, Pair] = {
    "usage_areas": (areas, f"{_BOUND} SELECT area, NULL AS signed_in, NULL AS role, count(*) AS n, 3 AS level FROM b GROUP BY area UNION ALL SELECT NULL, role IS NOT NULL, NULL, count(*), 5 FROM b GROUP BY role IS NOT NULL UNION ALL SELECT area, NULL, role, count(*), 2 FROM b GROUP BY area, role"),
    "usage_used_filters": (used_filters, f"{_BOUND} SELECT name, count(*) AS n FROM (SELECT unnest(CAST(filters AS VARCHAR[])) AS name FROM (SELECT CAST(json(filters) AS VARCHAR[]) AS filters FROM b WHERE json_type(filters) = 'ARRAY')) GROUP BY 1"),
    "usage_filtered_share": (filtered_share, f"{_BOUND} SELECT area, count(*) FILTER (WHERE json_type(filters) = 'ARRAY' AND json_array_length(filters) > 0) AS with_filter, count(*) FILTER (WHERE filters IS NULL OR json_type(filters) <> 'ARRAY' OR json_array_length(filters) = 0) AS without_filter FROM b GROUP BY 1"),
    "usage_depth_of_both": (depth_of_both, f"{_BOUND}, u AS (SELECT user_id, max(CASE WHEN k >= 50 THEN CASE event_type WHEN 'purchase' THEN 3 ELSE 2 END WHEN area = 'explore' THEN 2 ELSE 1 END) AS level FROM b GROUP BY 1) SELECT level, count(*) AS users FROM u GROUP BY 1"),
    "usage_top_events": (top_events, f"{_BOUND} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE role = 'admin') AS by_admin, count(*) FILTER (WHERE role = 'editor') AS by_editor, count(*) FILTER (WHERE role = 'user') AS by_user, count(*) FILTER (WHERE role IS NULL) AS by_anonymous FROM b GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3"),
    "usage_recent": (recent, f"{DUCK}, a AS (SELECT *, floor(date_diff('second', ts, TIMESTAMP '{NOW}')) / 86400 AS age FROM log) SELECT " + ", ".join(f"count(CASE WHEN age <= {n} THEN 1 END) AS requests_{n}d, count(DISTINCT CASE WHEN age <= {n} THEN user_id END) AS users_{n}d" for n in (1, 7, 30)) + ", count(DISTINCT CASE WHEN age <= 7 THEN session END) AS sessions_7d FROM a WHERE age > 0 AND age <= 30"),
    "usage_routes": (routes, f"{DUCK} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(k % 13), 6) AS mean_queries, round(100.0::DOUBLE * count(CASE WHEN k < 5 THEN 1 END) / count(*), 6) AS error_rate FROM log GROUP BY 1"),
    "usage_transitions": (transitions, f"{DUCK}, t AS (SELECT event_type AS origin, lead(event_type) OVER (PARTITION BY session ORDER BY ts, event_id) AS target FROM log) SELECT origin, target, count(*) AS n FROM t WHERE target <> origin GROUP BY 1, 2"),
    "usage_session_ends": (ends, f"{DUCK}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS z FROM log) SELECT 'entry' AS kind, event_type, count(*) AS n FROM r WHERE a = 1 GROUP BY 2 UNION ALL SELECT 'exit', event_type, count(*) FROM r WHERE z = 1 GROUP BY 2"),
    "usage_parameters": (parameters, f"{DUCK} SELECT unnest(json_keys(props)) AS name, count(*) AS n FROM log GROUP BY 1"),
    "usage_filter_share": (filter_share, f"{DUCK} SELECT event_type, count(CASE WHEN k >= 50 THEN 1 END) AS with_filter, count(CASE WHEN k < 50 THEN 1 END) AS without_filter FROM log GROUP BY 1"),
    "usage_slowest": (slowest, f"{DUCK} SELECT event_type, k, count(*) AS n, round(avg(value), 6) AS mean_value FROM log GROUP BY 1, 2 HAVING count(*) >= 10"),
    "usage_depth": (depth, f"{DUCK}, u AS (SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS level FROM log GROUP BY 1) SELECT level, count(*) AS users FROM u GROUP BY 1"),
    "usage_funnel": (funnel, f"{DUCK}, n AS (SELECT 1 AS step, count(DISTINCT user_id) AS users FROM log WHERE k < 60 UNION ALL SELECT 2, count(DISTINCT user_id) FROM log WHERE k < 40 UNION ALL SELECT 3, count(DISTINCT user_id) FROM log WHERE k < 10) SELECT step, users, round(100.0::DOUBLE * users / nullif(lag(users) OVER (ORDER BY step), 0), 2) AS conversion FROM n"),
    "usage_time_to_target": (time_to_target, f"{DUCK}, p AS (SELECT user_id, min(ts) AS a, min(CASE WHEN k >= 95 THEN ts END) AS z FROM log GROUP BY 1) SELECT count(*) AS users, round(quantile_cont(date_diff('second', a, z) / 86400.0::DOUBLE, 0.5), 1) AS median_days FROM p WHERE z >= a"),
    "usage_daily": (daily, f"{DUCK}, c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM log GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day), x AS (SELECT s.day, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (day)) SELECT strftime(day, '%Y-%m-%d') AS day, n, CAST(sum(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM x"),
}
