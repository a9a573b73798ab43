"""Sides of a comparison as data: each row is classified once, into one mask of bits.

A side is a period, a scope and further conditions. Any number of sides, which may overlap,
becomes one column; an aggregation by that column serves them all, and the mask's bits give
each side its share of the few rows that come of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spec import Period, Scope


@dataclass(frozen=True)
class Side:
    """What a side holds: everything where nothing restricts it, nothing where its scope is empty."""

    period: Period = field(default_factory=Period)
    scope: Scope = field(default_factory=Scope)
    conditions: tuple[str, ...] = ()

    def sql(self) -> str:
        if self.scope.empty:
            return "FALSE"
        return " AND ".join(f"({c})" for c in [*self.period.sql(), *self.scope.sql(), *self.conditions]) or "TRUE"


def masked(rows: DataFrame, sides: dict[str, Side]) -> DataFrame:
    """The rows of any side, with ``mask``: bit i is set for those of side i. A condition that is null doesn't hold."""
    if len(sides) > 62:
        raise ValueError("a mask has room for 62 sides")
    conditions = [s.sql() for s in sides.values()]
    live = rows.where(" OR ".join(f"({c})" for c in conditions) or "FALSE")
    bits = [F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)]
    return live.withColumn("mask", sum(bits[1:], bits[0]).cast("long") if bits else F.lit(0).cast("long"))


def by_side(aggregated: DataFrame, sides: dict[str, Side], keys: list[str], sums: list[str]) -> DataFrame:
    """Rows by mask (and keys) added up for each side, with ``side``: its name."""
    named = F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(name)) for i, name in enumerate(sides)])
    spread = aggregated.withColumn("side", F.explode(F.filter(named, lambda s: s.isNotNull())))
    return spread.groupBy("side", *keys).agg(*[F.sum(c).alias(c) for c in sums])
