"""Exact percentiles from counts by value.

A histogram (keys, value, n) is additive: parts of a table are counted where they lie, added
up, and taken away again, and memory is bounded by distinct values, not by rows. Percentiles
are read from running counts, interpolated as SQL's PERCENTILE_CONT does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n) of the rows that have a value."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(histogram: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """The percentiles of each group of a histogram, by name; groups without rows (n = 0) are left out."""
    own = Window.partitionBy(*keys)
    running = histogram.where("n > 0").withColumns({"upto": F.sum("n").over(own.orderBy("value")), "total": F.sum("n").over(own)})
    first = lambda place: F.min(F.when(F.col("upto") > place, F.col("value").cast("double")))
    places = {name: F.lit(p) * (F.col("total") - 1) for name, p in shares.items()}
    ends = [c.alias(f"{name}_{end}") for name, at in places.items() for end, c in (("low", first(F.floor(at))), ("high", first(F.ceil(at))))]
    found = running.groupBy(*keys, "total").agg(*ends)
    between = {name: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at - F.floor(at)) for name, at in places.items()}
    return found.select(*keys, *[v.alias(k) for k, v in between.items()])
